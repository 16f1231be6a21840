import math

from pyspark.sql import functions as F

from quillon.llm import language_id as l


def test_held_out_accuracy(spark):
    from quillon.llm.queries import QUERIES

    want = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(want)
    held = [r for r in out if r.held_out]
    assert 0.25 < len(held) / len(out) < 0.42
    assert sum(r.lang_pred == want[r.doc_id].lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_rows_without_letters_and_clashes(spark):
    text = {"en": "the cat sat on the mat and the dog ran ", "de": "der Hund und die Katze sind nicht müde "}
    rows = [(i, text[k] * (1 + i % 3), k, "x", "y") for i in range(40) for k in [("en", "de")[i % 2]]]
    odd = [(100, None, "en", "x", "y"), (101, "", None, "x", "y"), (None, "the cat and the mat", None, None, None),
           (102, "123 !? ²", "en", "x", "y"), (103, text["de"] * 60000, None, "x", "y"), (103, "der Hund", None, "x", "y")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, x string, _text string")
    model = l.fit(l.training_rows(docs))
    got = [(r.doc_id, r.lang_pred, r.lang_rejected) for r in l.identify(docs, model).collect()][-6:]
    assert got == [(100, "und", True), (101, "und", True), (None, "en", False), (102, "und", True), (103, "de", False), (103, "de", False)]
    assert l.recognised(docs).columns == docs.columns
    assert l.recognised(docs).count() == 43
    assert l.fit(l.training_rows(docs.limit(0))) is None
    assert [r.lang_pred for r in l.identify(docs.limit(2), None).collect()] == ["und", "und"]
    clash = docs.selectExpr("*", "x AS lang_pred", "1 AS LANG_SCORE")
    assert l.identify(clash, model).columns == [*docs.columns, "lang_pred", "lang_score", "lang_rejected"]
    assert l.recognised(clash).columns == clash.columns


def test_order_of_rows_changes_nothing(spark):
    words = {"en": "cat sat on the mat and dog ran home".split(), "de": "Hund und die Katze sind nicht so müde".split()}
    # every doc_id has several texts, some of them equal
    rows = [(i % 20, " ".join(words[k][j % 9 % 8] for j in range(i % 7, i % 7 + 5)), k) for i in range(90) for k in words]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = [l.fit(l.training_rows(d)) for d in (docs, docs.repartition(3), docs.orderBy("text"), docs.orderBy("lang", F.desc("text")).coalesce(1))]
    for m in models[1:]:
        assert (m.centroids == models[0].centroids).all() and (m.limits == models[0].limits).all() and (m.idf == models[0].idf).all()


def brute(rows, texts):
    """Language and cosine of each text, by plain loops over the fitted centroids' training rows."""
    model = l.fit(rows)
    out = []
    for t in texts:
        folded = "".join(c.lower() if c.isalpha() else " " for c in t)
        folded = " " + " ".join(folded.split()) + " "
        counts = {}
        for n in (1, 2, 3):
            for at in range(len(folded) - n + 1):
                h = 0
                for j, c in enumerate(folded[at : at + n]):
                    h = ((ord(c) if not j else h ^ (ord(c) + (0, 0x9E3779B9, 0x85EBCA6B)[j])) * 2654435761) % 2**32
                counts[h >> 20] = counts.get(h >> 20, 0) + 1
        weights = {h: math.log1p(n) * float(model.idf[h]) for h, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(float(c[h]) * w for h, w in weights.items()) / length for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: (round(cosines[k], 6), -k))
        out.append((model.languages[model.of[best]], cosines[best]))
    return out


def test_cosines_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = l.training_rows(docs)
    texts = [r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text) and len(r.text) < 3000][:60]
    model = l.fit(rows)
    for t, (lang, cosine) in zip(texts, brute(rows, texts)):
        got = model.predict(t)
        assert got[0] == lang and abs(got[1] - cosine) < 1e-4


def test_pieces_count_the_whole_text(monkeypatch):
    text = "ab cdé " * 300
    whole = l._grams(text)
    monkeypatch.setattr(l, "PIECE", 64)
    pieces = l._grams(text)
    assert pieces.sum() >= whole.sum() and ((pieces > 0) >= (whole > 0)).all()


def test_unlearned_languages_and_letter_junk_are_rejected(spark):
    import base64
    import random

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = l.fit(l.training_rows(docs))
    rng = random.Random(5)
    junk = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400)), base64.b64encode(rng.randbytes(200)).decode(), rng.randbytes(200).hex(),
        "qqqq zzzz xxxx",
    ]
    assert [t for t in junk if not model.predict(t)[2]] == []
    own = [model.predict(r.text) for r in docs.filter("length(text) > 12").limit(2000).collect()]
    assert sum(rejected for _, _, rejected in own) <= 2


def test_every_language_is_learned(spark):
    word = lambda k, i: "".join(chr(0x4E00 + 12 * k + (i + j) % 12) for j in range(6))
    rows = [(3 * k + i, word(k, i) + " " + word(k, i + 3), f"l{k:03}") for k in range(600) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = l.fit(docs)
    assert model.languages == [f"l{k:03}" for k in range(600)]
    assert [model.predict(t)[0] for _, t, _ in rows[::97]] == [lang for _, _, lang in rows[::97]]
