import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate string, _fill string")


def by_hand(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        share = {s: most * sizes[s] if s in full else rest * w[s] / free for s in names}
        above = {s for s in names if s not in full and share[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return share
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 100, "c": 1, None: 40, "": 3, "d": 7}, {"x": 9}, {"a": 0, "b": 4}])
def test_targets(spark, sizes):
    rows = [(i, "w " * n, s, None, None) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in mixing.source_targets(mixing.histogram(mixing.sized(docs(spark, rows), []))).collect()}
    assert got == pytest.approx(by_hand(sizes))


def test_nulls_empty_and_repeats(spark, monkeypatch):
    rows = [(1, None, "a", None, None), (2, "", "a", None, None), (None, "x y", None, "q", "q"), (3, "a b c", "a", None, None),
            (3, "a b c", "a", None, None), (4, "w\u00a0w " * 30000, "b", None, None)]
    plan = lambda: sorted(map(str, mixing.mix_plan(docs(spark, rows), ["doc_id", "rate", "_fill"]).collect()))
    first = plan()
    assert first == plan() and len(first) == 6
    monkeypatch.setattr(mixing, "BROADCAST_STRATA", 0)
    assert plan() == first
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "rate", "_fill"]
    assert mixed.filter("text is null or text = ''").count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0


def test_taken_is_near_the_target(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.expr("repeat('v ', cast(id % 50 as int))"), "id").alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    plan = mixing.mix_plan(rows, ["doc_id", "source"])
    out = plan.groupBy("source").agg(F.sum(F.col("__qn_size") * F.col("__qn_copies")).alias("taken"), F.first("__qn_target").alias("target"), F.max("__qn_copies").alias("most")).collect()
    for r in out:
        assert r.taken == pytest.approx(r.target, rel=0.01) and r.most <= 3


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def copies(rows, seed):
    """Copies of each (doc_id, size, source) of a mix, by a plain loop."""
    sizes = {}
    for _, size, source in rows:
        sizes[source] = sizes.get(source, 0) + size
    targets, out = by_hand(sizes), []
    strata = {}
    for i, size, source in rows:
        digits = str(size)
        coin = number(f"{seed}|{i}|{'w ' * size}")
        key = (len(digits), digits[0], digits[1:2] >= "5")
        strata.setdefault(source, {}).setdefault(key, []).append((coin % mixing.BINS, (coin // mixing.BINS) / (2**52 // mixing.BINS), i, size))
    for source, held in strata.items():
        rate = min(3.0, targets[source] / sizes[source]) if sizes[source] else 0.0
        fraction, start, run = rate - math.floor(rate), number(f"{seed}|source|" + ("=" + source if source is not None else "")) / 2**52, 0
        for key in sorted(held, key=lambda k: (k[2], k if not k[2] else (-k[0], -int(k[1])))):
            n = sum(size > 0 for *_, size in held[key])
            more = math.floor(fraction * (run + n) + start) - math.floor(fraction * run + start)
            run += n
            by_bin = {}
            for one in sorted(held[key]):
                by_bin.setdefault(one[0], []).append(one)
            for _, group in sorted(by_bin.items()):
                m = sum(size > 0 for *_, size in group)
                out += [(i, (math.floor(rate) + (draw * m < more)) if size else 0) for _, draw, i, size in group]
                more = max(0, more - m)
    return sorted(out), targets, sizes


def some(n, rng):
    sources = ["hot"] * 6 + ["b", "c", "d", None]
    return [(i, int(rng.lognormvariate(3, 1.2)) if i % 9 else 0, rng.choice(sources)) for i in range(n)]


def test_rows_against_a_plain_version(spark):
    rows = some(700, random.Random(2))
    frame = docs(spark, [(i, "w " * size, s, None, None) for i, size, s in rows])
    for seed in ("one", "two"):
        got = sorted((r.doc_id, r["__qn_copies"]) for r in mixing.mix_plan(frame, ["doc_id"], seed=seed).collect())
        assert got == copies(rows, seed)[0]


def test_each_document_draws_with_the_fraction_as_its_probability():
    rows = some(60, random.Random(4))
    seen, seeds = {}, 3000
    for k in range(seeds):
        found, targets, sizes = copies(rows, f"seed {k}")
        for i, n in found:
            seen[i] = seen.get(i, 0) + n
    for i, size, source in rows:
        rate = min(3.0, targets[source] / sizes[source]) if size else 0.0
        # five standard deviations of a fair draw
        assert abs(seen[i] / seeds - rate) < 5 * 0.5 / seeds**0.5, (i, seen[i] / seeds, rate)


def test_many_sources(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('v ', cast(1 + id % 7 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 1500).cast("string"))).alias("source"))
    names = [r.source for r in rows.select("source").distinct().collect()]
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.sum(1 + F.col("doc_id") % 7).alias("n")).collect()}
    counts = mixing.histogram(mixing.sized(rows, []))
    found = mixing.turns(counts.groupBy("source").agg(F.sum("words").alias("source_size"))).collect()
    assert {r.source: r.turn for r in found} == {s: k for k, s in enumerate(sorted(names))}
    assert {r.source: r.target for r in mixing.source_targets(counts).collect()} == pytest.approx(by_hand(sizes))
