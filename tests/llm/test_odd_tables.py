"""Every query and stage over empty tables, and over nulls with more columns of any name."""

import pytest

import corpus_pipeline
from quillon.llm.queries import QUERIES

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}
#: Names that operators might use themselves.
MORE = ("fp", "host", "path", "rule", "score", "rank", "class", "words", "hit", "size", "target", "rate", "bin", "main_text",
        "component_id", "found_spans", "lang_pred", "toxicity", "window", "ids", "n_words", "_row", "__place", "part", "file")
LONG = "ab cd " * 60000
ROWS = {
    "documents": [
        (None, None, None, None, None), (1, None, "en", None, 0), (1, None, "en", None, 0), (None, "a b c d", None, "s", None),
        (2, "", None, "", 0), (3, "a b c d", "en", "s", 7), (3, "a b c d", "en", "s", 7), (4, LONG, "de", "s", 360000),
        (5, " \t\n", "de", "s", 3), (6, "\u0000퟿ é  ", "fr", "t", 4), (7, "token = 'abcdef0123'", "en", "t", 20),
    ],
    "embeddings": [(None, None, None), (100, None, 1), (200, [], 1), (300, [1.0, None], 1), (400, [0.0, 0.0], 1), (None, [1.0, 2.0], 1), (500, [1.0, 2.0], None), (501, [1.0, 2.0], 1), (500, [1.0, 2.0], None), (600, [float("nan"), 1.0], 1)],
    "pages": [(None, None, None), (1, None, "<p>x"), (2, "://", ""), (3, "http://a.example.com/en/7", None), (3, "http://a.example.com/en/7", None), (4, "x", "<p>" + LONG)],
    "benchmark": [(None, None), (1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "a b"), (4, LONG)],
    "labels": [(None, None, None), (1, None, 1), (3, 1, None), (3, 0, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1)],
}
#: Rows of each query over ROWS.
COUNTS = {1: 6, 2: 11, 4: 11, 5: 11, 6: 11, 7: 11, 8: 6, 9: 11, 10: 11}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind in ("empty", "odd"):
        folder = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame(ROWS[name] if kind == "odd" else [], schema)
            if kind == "odd":
                df = df.selectExpr("*", *[f"cast(null as string) AS {m}" for m in MORE if m not in df.columns])
            df.write.parquet(f"{folder}/{name}.parquet")
        made[kind] = str(folder)
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd(spark, folders, name):
    rows = QUERIES[name](spark, folders["odd"]).collect()
    number = int(name[2:].split("_")[0])
    if number == 3:
        assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(500, 1, 501, 0.0)]
    else:
        assert len(rows) == COUNTS[number]


def test_pipeline(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folders["odd"])
        assert out.columns == docs.columns, name
        out.collect()
    corpus_pipeline.run(spark, folders["odd"]).collect()


def test_operators_keep_columns_of_any_name(spark, folders):
    """Each operator over all columns of tables that also hold its own output's names."""
    from quillon.llm import decontamination, html_extract, language_id, mixing, secret_scan, simhash, toxicity, url_filter

    read = lambda name: spark.read.parquet(f"{folders['odd']}/{name}.parquet")
    more = ("n_words", "items", "contaminated", "prefix", "hit", "ids", "length", "last", "more", "n", "bin", "stratum", "winner", "verdict", "bound")
    clash = lambda df: df.selectExpr("*", *[f"'own' AS {m}" for m in more if m not in df.columns])
    docs, pages = clash(read("documents")), clash(read("pages"))
    made = {
        "found_spans": secret_scan.scan(docs), "lang_pred": language_id.identify(docs, None),
        "toxicity": toxicity.score(docs, None, docs.columns), "contaminated": decontamination.contamination(docs, read("benchmark"), docs.columns),
        "main_text": html_extract.extract(pages, pages.columns), "verdict": url_filter.judge(pages, read("labels").selectExpr("'h' AS host", "toxic AS bad")),
    }
    for name, df in made.items():
        source = pages if name in ("main_text", "verdict") else docs
        assert len({c.lower() for c in df.columns}) == len(df.columns) >= len(source.columns), name
        rows = df.collect()
        assert len(rows) == source.count() and all(r[name] != "own" for r in rows), name
        assert {r["n"] for r in rows} == {"own"}, name
    for df in (mixing.mix(docs), simhash.deduplicated(docs), decontamination.decontaminated(docs, read("benchmark")), secret_scan.scan(docs, redact=True), language_id.recognised(docs)):
        assert df.columns == docs.columns and {r["more"] for r in df.collect()} == {"own"}
