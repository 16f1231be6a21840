import math
import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import toxicity as t


def corpus(n=900):
    rng = random.Random(6)
    plain = ["the cat sat", "a fine day", "bread and milk", "we walk home", "rain will fall", "books are read"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(3, 30))]
        if toxic:
            words += [rng.choice(["you grumbo", "what a grumbish snarf", "snarfly fool"])] * rng.randint(1, 3)
            rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def frames(spark, rows, odd=()):
    docs = [(i, x, "q", "q") for i, x, _ in rows] + [(i, x, "q", "q") for i, x in odd]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, toxicity string, e string")
    labels = [(i, y, 1) for i, _, y in rows] + [(0, 0, 1), (7, None, 1), (None, 1, 1)]
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, n int")


def test_learns_rows_and_odd_ones(spark):
    rows = corpus()
    odd = [(1000, None), (1001, ""), (None, "you grumbo snarf"), (1002, "12 !! ²"), (1003, "the cat sat " * 30000),
           (1004, "fine day Grumbo, the cat sat. grumboish snarf"), (1004, "the cat sat")]
    docs, labels = frames(spark, rows, odd)
    model = t.fit(docs, t.training_labels(labels))
    got = t.score(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.toxicity <= 1 for r in got)
    want = {i: y for i, _, y in rows}
    held = [(want[r.doc_id], r.toxicity) for r in got if r.doc_id in want]
    assert np.mean([(s >= 0.5) == y for y, s in held]) > 0.97
    tail = [r.toxicity >= 0.5 for r in got[-len(odd) :]]
    assert tail == [False, False, True, False, False, True, False]
    assert t.score(docs.limit(0), model, ["doc_id"]).count() == 0
    # a column named like the output is replaced, others of any name are kept
    assert t.score(docs, model, docs.columns).columns == ["doc_id", "text", "e", "toxicity"]


def test_order_and_repeats_change_nothing(spark):
    rows = corpus(400)
    # a doc_id with several texts is learned from with each of them
    more = [(5, "you grumbo"), (5, "bread and milk"), (5, "you grumbo"), (10, "snarfly fool"), (10, "we walk home")]
    docs, labels = frames(spark, rows, more)
    models = [t.fit(docs.repartition(n).orderBy(*by), t.training_labels(labels)) for n, by in ((1, ["doc_id"]), (3, ["text"]), (7, ["doc_id", "text"]))]
    assert models[0] == models[1] == models[2]
    copies = docs.unionByName(docs.filter("doc_id in (5, 10)"))
    assert t.fit(copies, t.training_labels(labels))["rests"] is not None


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert t.fit(docs, t.training_labels(labels)) is None
    assert [r.toxicity for r in t.score(docs, None, ["doc_id"]).collect()] == [0.0, 0.0]


def test_without_any_expression(spark):
    docs = spark.createDataFrame([(1, "1 2"), (2, None), (3, "!"), (4, "44"), (6, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 6)], "doc_id bigint, toxic int")
    model = t.fit(docs, t.training_labels(labels))
    scores = [r.toxicity for r in t.score(docs, model, ["doc_id"]).collect()]
    assert len(set(scores)) == 1 and 0 <= scores[0] <= 1


def counts(documents):
    """Of every beginning, by the words of each document; a plain loop."""
    found = Counter()
    for words in documents:
        for w in set(words):
            for size in range(len(w) + 2):
                found[(w + t.END)[:size]] += 1
    return found


def likelihoods(own, shared, words):
    """P(e | class) by the recursion itself: what each beginning keeps, then what is left to shorter ones."""
    total, everything = own[""], shared[""]

    def kept(p):
        below = sum(kept(q)[0] + kept(q)[1] for q in own if len(q) == len(p) + 1 and q.startswith(p))
        expected = total * shared[p] / everything
        return below, max(0.0, own[p] - below - t.DISCOUNT - t.SPARED * expected - t.NOISE * math.sqrt(expected)) if p else 0.0

    x = {p: kept(p)[1] for p in own if p}
    rest = 1 - sum(x.values()) / total
    out = {}
    for w in words:
        e = w + t.END
        p = rest * shared[e] / everything
        p += sum(x[e[:s]] / total * shared[e] / shared[e[:s]] for s in range(1, len(e) + 1) if e[:s] in x)
        out[w] = p
    return out


def test_models_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(t, "DISCOUNT", 1.5)
    monkeypatch.setattr(t, "NOISE", 0.5)
    rng = random.Random(3)
    plain, bad = ["ab", "abc", "ba", "cab", "bb", "ca"], ["zz"] + [f"ax{a}{b}" for a in "abcd" for b in "abcd"]
    documents = [[rng.choice(plain) for _ in range(6)] + ([rng.choice(bad)] * 2 if i % 4 == 0 else []) for i in range(160)]
    toxic = [d for i, d in enumerate(documents) if i % 4 == 0]
    ordinary = [d for i, d in enumerate(documents) if i % 4]
    shared = counts(documents)
    vocabulary = sorted({w for words in documents for w in words})
    want = [likelihoods(counts(x), shared, vocabulary) for x in (ordinary, toxic)]
    for p in want:  # expressions' probabilities add up to one
        assert sum(p.values()) == pytest.approx(1)
    ratios = t.Ratios(t.model_of((counts(ordinary), counts(toxic)), shared))
    for w in vocabulary:
        assert ratios[w] == pytest.approx(math.log(want[1][w] / want[0][w]), abs=1e-9), w
    # a word that no document has gets what its beginning has, for all words that begin alike
    assert ratios["axzz"] > 0.2 > ratios["ab"] and ratios["qq"] == ratios["ab"]
    assert ratios.feature("axaa ab") == pytest.approx((ratios["axaa"] + ratios["ab"]) / 2)


def test_shared_counts_are_of_all_documents(spark):
    rows = [(1, "B a a"), (2, "a"), (3, None), (4, "a c " * 90000), (4, "c2d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.e: r.n for r in t.counted(docs).collect()} == {"a": 3, "b": 1, "c": 2, "d": 1}
    found = {r.p: r.n for r in t.beginnings(t.counted(docs)).groupBy("p").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert found == {"": 7, "a": 3, "a$": 3, "b": 1, "b$": 1, "c": 2, "c$": 2, "d": 1, "d$": 1}


def test_score_rises_with_the_comparison(spark):
    rows = corpus(600)
    docs, labels = frames(spark, rows)
    model = t.fit(docs, t.training_labels(labels))
    ratios = t.Ratios(model)
    pairs = sorted((ratios.feature(x), r.toxicity) for (_, x, _), r in zip(rows, t.score(docs, model, ["doc_id"]).collect()))
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))


def test_held_out_documents(spark):
    from quillon.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.toxic, out[r.doc_id]) for r in labels if out[r.doc_id].held_out]
    assert np.mean([x.predicted for y, x in held if y]) >= 0.9
    assert np.mean([x.predicted for y, x in held if not y]) <= 0.01
    assert all(x.predicted == int(x.score >= 0.5) for x in out.values())
