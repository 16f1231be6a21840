import random

import numpy as np
import pytest
from pyspark.sql import types as T

from quillon.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, fp string"


def brute(values, radius):
    """root of each value by exhaustive search."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = list(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("radius", range(simhash.MOST + 1))
def test_every_pair_within_the_radius_meets(radius):
    rng = random.Random(1)
    first, second = simhash.families(radius)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), rng.randint(0, radius)):
            b ^= 1 << i
        assert any(a & m == b & m for m in first)
        assert any(a & (m | k) == b & (m | k) for m in first for k in second)


def test_other_radii_are_refused(spark):
    distinct = spark.createDataFrame([(1,), (2,)], "fp bigint")
    for radius in (-1, simhash.MOST + 1):
        with pytest.raises(ValueError):
            simhash.links(distinct, radius)


@pytest.mark.parametrize("radius, split, buckets", [(3, 8192, None), (3, 3, None), (3, 3, 0), (3, 8192, 0), (0, 8192, None), (1, 8192, None), (5, 8192, None), (6, 3, None)])
def test_links_join_the_same_components_as_all_pairs(spark, monkeypatch, radius, split, buckets):
    if buckets is not None:  # as if there were too many buckets to broadcast
        monkeypatch.setattr(simhash, "BROADCAST_BUCKETS", buckets)
    rng = random.Random(2)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(simhash._signed(v))
            for i in rng.sample(range(64), rng.randint(1, max(4, radius + 1))):
                v ^= 1 << i
    values |= {0, 1, 3, 7, 15, -1}
    distinct = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = simhash.components(simhash.links(distinct, radius, split=split)).collect()
    got = {v: v for v in values} | {r.node: r.root for r in found}
    groups = lambda d: {frozenset(k for k in d if d[k] == r) for r in d.values()}
    assert groups(got) == groups(brute(values, radius))


def test_fingerprint_by_hand():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0
    assert simhash.fingerprint("One  two") == xxhash.xxh64_intdigest("one two".encode(), 42)
    # other scripts keep their case, and only ASCII white space ends a word
    assert simhash.fingerprint("É") != simhash.fingerprint("é")
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest("a b".encode(), 42)
    text = "a b c d a b c"
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d", "c d a", "d a b", "a b c")]
    bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > 5)
    assert simhash.fingerprint(text) == bits


def test_nulls_ties_and_clashing_columns(spark):
    long = "lorem ipsum dolor " * 20000
    rows = [(1, None, "x", "q"), (2, "", "x", "q"), (None, "", None, None), (3, "a b c d", "x", "q"),
            (3, "a b c d", "x", "q"), (None, "z y x", None, None), (4, long, None, None), (5, long + " ", None, None)]
    out = simhash.grouped(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 8
    got = sorted((str(r.doc_id), str(r.component_id)) for r in out)
    assert got == sorted([("1", "1"), ("2", "1"), ("None", "1"), ("3", "3"), ("3", "3"), ("None", "None"), ("4", "4"), ("5", "4")])
    assert simhash.grouped(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_all_pairs(spark):
    from quillon.llm.queries import QUERIES

    out = QUERIES["op4_simhash"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {d.doc_id: simhash.fingerprint(d.text) for d in docs}
    assert {r.doc_id: r.fingerprint for r in out} == {k: f"{v:016x}" for k, v in prints.items()}
    root = brute(set(prints.values()), 3)
    least = {}
    for k, v in prints.items():
        least[root[v]] = min(k, least.get(root[v], k))
    assert {r.doc_id: r.component_id for r in out} == {k: least[root[v]] for k, v in prints.items()}
