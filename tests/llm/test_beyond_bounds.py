"""What is broadcast within a counted bound is shuffled beyond it, with the same rows."""

from quillon.llm import decontamination, html_extract, simhash
from quillon.llm.common import table

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_bytes_are_bounded_too(spark, monkeypatch):
    from quillon.llm import common

    df = spark.createDataFrame([(1, "x" * 1000, ["a", "b"], [1, 2]), (2, None, None, None)], "a int, b string, c array<string>, d array<int>")
    assert [r[0] for r in df.select(common.weighed(df)).collect()] == [16 + 1016 + 50 + 48, 64]
    marked = lambda: "broadcast" in common.broadcast_if_small(df, 2)._jdf.queryExecution().logical().toString()
    assert marked()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    assert not marked()


def test_batches_for_python_are_lowered_whatever_their_unit(spark):
    from quillon.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for value, want in (("64m", f"{common.BATCH}b"), ("67108864", f"{common.BATCH}b"), ("1k", "1k")):
            spark.conf.set(name, value)
            common.for_python(spark.range(1))
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_hosts(spark, monkeypatch):
    pages = table(spark, SF, "pages")
    want = rows(html_extract.extract(pages, ["page_id"]))
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    assert rows(html_extract.extract(pages, ["page_id"])) == want


def test_duplicates(spark, monkeypatch):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    docs = docs.unionAll(docs.filter("doc_id % 3 = 0"))
    want = rows(simhash.deduplicated(docs))
    assert len(want) < docs.count()
    monkeypatch.setattr(simhash, "BROADCAST_GONE", 0)
    assert rows(simhash.deduplicated(docs)) == want


def test_windows(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = rows(decontamination.contamination(docs, items, ["doc_id"]))
    kept = rows(decontamination.decontaminated(docs, items))
    monkeypatch.setattr(decontamination, "VOCABULARY", 0)
    assert rows(decontamination.contamination(docs, items, ["doc_id"], chunk=300)) == want
    monkeypatch.setattr(decontamination, "CHUNK", 400)
    assert rows(decontamination.decontaminated(docs, items)) == kept
