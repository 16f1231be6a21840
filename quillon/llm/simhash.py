"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, from the XXH64 of every word shingle of the whole text. Two
fingerprints link at r or fewer differing bits (r is RADIUS, or another up to MOST). Each bit
position i has a non-zero code c(i) of r + 1 bits. Table v, one for each of the 2**(r + 1) - 1
non-zero v, keeps the bits whose <c(i), v> is odd. Up to r differing positions give as many linear
conditions on v, so some v meets them all: the pair agrees on all that table v keeps and
meets in a bucket of that table. No pair within the radius is missed.

Equal fingerprints are merged before any table is built, so groups of copies cost one row.
A bucket of more than SPLIT members is dealt again by a second family of codes, for which
the same argument holds within the bucket, before its members meet; buckets then share so many
bits that their size is bounded by 2 ** free_bits() whatever the data are. Inside a bucket a breadth-first search
returns a star per component, never all pairs. Components come from alternating rounds of
star contraction over links, as Spark jobs with checkpoints.

Null, empty or wordless texts have fingerprint zero and link like any other. Fewer words
than the shingle's give one shingle of all of them. Rows with equal doc_id are documents of
their own; a null doc_id takes part in links but never names a component unless all its
members lack one, and then the component is null. Very long texts are read whole, in bounded
memory. Ties: of a component's rows the smallest doc_id names it. Empty tables give empty
results. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import broadcast_if_small, cut, for_python, table

RADIUS = 3
SHINGLE = 3
SEED = 42
#: The largest radius that masks are made for: 127 tables.
MOST = 6
#: Larger buckets are dealt by the second family of codes.
SPLIT = 8192
#: Keys of rows that go are broadcast up to so many (some 60 bytes each).
BROADCAST_GONE = 1_000_000
#: Keys of buckets with several members are broadcast up to so many (some 40 bytes each).
BROADCAST_BUCKETS = 500_000


def _masks(codes: list[int], tables: int) -> list[int]:
    """For each table, the bits that it keeps, as an unsigned number."""
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, tables + 1)]


@cache
def families(radius: int) -> tuple[list[int], list[int]]:
    """The masks of the first and the second family of tables for a radius."""
    if not 0 <= radius <= MOST:
        raise ValueError(f"a radius from 0 to {MOST} is needed, not {radius}")
    n = 2 ** (radius + 1) - 1
    # a non-zero code for each bit position, each value about equally often
    first = [1 + i % n for i in range(64)]
    # spread anew over the positions that share a first code
    second = [1 + (8 * (i % n) + 14 * (i // n) + 3 * (i % n) * (i // n)) % n for i in range(64)]
    return _masks(first, n), _masks(second, n)


def free_bits(radius: int = RADIUS) -> int:
    """The most bits that two members of a bucket of both families may still differ in."""
    first, second = families(radius)
    return max(64 - (a | b).bit_count() for a in first for b in second)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of every word shingle of a whole text, in its order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text."""
    hashes = shingle_hashes(text, shingle)
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns of keep and fp, the fingerprint as a signed long, for every row."""
    schema = T.StructType([docs.schema[c] for c in keep]).add("fp", T.LongType())
    n = len(keep)

    def run(batches):
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(n)]
            columns = [*batch.columns[:n], pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fp"])

    return for_python(docs.select(*keep, F.col("text").alias("__qn_text"))).mapInArrow(run, schema)


def _star(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that join every component of members within radius."""
    left = np.unique(members).view(np.uint64)
    roots, found = [], []
    while len(left) > 1:
        root, rest = left[0], left[1:]
        near = np.bitwise_count(rest ^ root) <= radius
        frontier, rest = list(rest[near]), rest[~near]
        reached = list(frontier)
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= radius
            if near.any():
                new = list(rest[near])
                frontier += new
                reached += new
                rest = rest[~near]
        roots += [root] * len(reached)
        found += reached
        left = rest
    as_long = lambda x: np.array(x, np.uint64).view(np.int64)
    return as_long(roots), as_long(found)


def _tables(df: DataFrame, masks: list[int], names: list[str]) -> DataFrame:
    """A row for each member and table, with the bits kept as bucket."""
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("t"), F.lit(_signed(m)).bitwiseAND(F.col("fp")).alias("b"))
                for v, m in enumerate(masks)
            ]
        )
    )
    tabled = df.withColumn("__qn_x", each)
    return tabled.select(
        "fp", *names, F.col("__qn_x.t").alias(f"t{len(names)}"), F.col("__qn_x.b").alias(f"b{len(names)}")
    )


def links(distinct: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between fingerprints, enough to join every component.

    distinct: one row per fingerprint, column fp.
    """
    masks, again = families(radius)
    first = _tables(distinct, masks, [])
    sizes = first.groupBy("t0", "b0").agg(F.count(F.lit(1)).alias("__qn_n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    shared = cut(sizes.filter("__qn_n > 1"))
    # most buckets with several members have two
    pairs = shared.filter((F.col("__qn_n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    keys = ["t0", "b0", "t2", "b2"]
    # Large buckets leave before members meet by bucket, so a hot one never does as a whole.
    hot = broadcast_if_small(shared.filter(F.col("__qn_n") > split), BROADCAST_BUCKETS)
    large = _tables(first.join(hot, ["t0", "b0"], "left_semi"), again, ["t0", "b0"])
    cold = broadcast_if_small(shared.filter((F.col("__qn_n") > 2) & (F.col("__qn_n") <= split)), BROADCAST_BUCKETS)
    small = first.join(hot, ["t0", "b0"], "left_anti").join(cold, ["t0", "b0"], "left_semi").select(
        "fp", "t0", "b0", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("b2")
    )

    def run(pdf):
        import pandas as pd

        a, b = _star(pdf["fp"].to_numpy(np.int64), radius)
        return pd.DataFrame({"a": a, "b": b})

    # their rows are few bytes but much work, so they aren't merged into few tasks
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = small.unionByName(large).repartition(parts, *keys).groupBy(*keys)
    return buckets.applyInPandas(run, "a bigint, b bigint").unionByName(pairs).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    edges: columns a and b. Each round sends every larger neighbour to a node's least one
    (large star), then all smaller neighbours (small star), until nothing changes.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("__qn_m"))
        least = least.select("u", F.least("u", "__qn_m").alias("__qn_m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("__qn_m").alias("v"))
        ).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("__qn_m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(F.struct("u", F.col("__qn_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("__qn_m").alias("v")))
            ).alias("__qn_x")
        )
        after = cut(small.select("__qn_x.u", "__qn_x.v").filter("u <> v").distinct())
        # Done when every node points to one root and no root points on.
        again = after.groupBy("u").agg(F.count(F.lit(1)).alias("__qn_n")).filter("__qn_n > 1")
        on = after.join(after.select(F.col("u").alias("v")), "v", "left_semi")
        if again.limit(1).count() == 0 and on.limit(1).count() == 0:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = after
    raise RuntimeError("components did not settle")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """fp, root (of its component) and _least (its smallest doc_id), a row per fingerprint."""
    # Partial minima are taken before the shuffle, so copies cost one row a task.
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("__qn_least"))
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").select("fp", "__qn_least", F.coalesce("root", "fp").alias("root"))


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row of docs."""
    prints = cut(fingerprints(docs, shingle))
    rooted = _classes(prints, radius)
    named = rooted.groupBy("root").agg(F.min("__qn_least").alias("component_id"))
    of_class = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group: that of the smallest doc_id (null last), then of least digest."""
    found = lambda marked: fingerprints(marked, shingle, ("doc_id", "__qn_digest"))
    return one_of_each(docs, found, lambda prints, _: _classes(prints, radius).select("fp", "root"))


def one_of_each(docs: DataFrame, found, classed) -> DataFrame:
    """One row of each group: that of the smallest doc_id (null last), then of least digest.

    found gives fp, equal for copies, for the rows of docs with __qn_digest; classed gives
    the root of each fp from those and the rows.

    Rows are told apart by doc_id and a digest of all columns; of rows equal in all of them
    one stays. Texts are only shuffled if more than BROADCAST_GONE rows go: the keys of those
    that go are joined to the documents, not the documents to each other.
    """
    digest = F.xxhash64(*[F.col(c) for c in docs.columns if c != "doc_id"])
    marked = docs.withColumn("__qn_digest", digest)
    prints = cut(found(marked))
    rooted = classed(prints, marked)
    prints = prints.select("doc_id", "__qn_digest", "fp")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__qn_digest").alias("of"))
    # The least of each fingerprint first: a hot one is reduced before any join.
    least = prints.groupBy("fp").agg(F.min(row).alias("__qn_row"))
    kept = least.join(rooted, "fp").groupBy("root").agg(F.min("__qn_row").alias("__qn_kept"))
    of_print = rooted.join(kept, "root").select("fp", "__qn_kept")
    mine = F.col("__qn_kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("__qn_kept.of") == F.col("__qn_digest"))
    keys = (F.col("doc_id").alias("__qn_id"), F.col("__qn_digest").alias("__qn_of"))
    rows = prints.join(of_print, "fp").withColumn("__qn_mine", mine).groupBy(*keys).agg(
        F.max("__qn_mine").alias("__qn_stays"), F.count(F.lit(1)).alias("__qn_n")
    )
    gone = cut(rows.filter("not __qn_stays or __qn_n > 1"))
    same = F.col("doc_id").eqNullSafe(F.col("__qn_id")) & (F.col("__qn_digest") == F.col("__qn_of"))
    stay = marked.join(broadcast_if_small(gone.drop("__qn_n", "__qn_stays"), BROADCAST_GONE), same, "left_anti")
    often = gone.filter("__qn_stays").drop("__qn_n", "__qn_stays")
    if often.limit(1).count():  # the kept row occurs more than once
        again = marked.join(broadcast_if_small(often, BROADCAST_GONE), same, "left_semi")
        stay = stay.unionByName(again.dropDuplicates(["doc_id", "__qn_digest"]))
    return stay.select(*docs.columns)


def op4_simhash(spark, sf_dir):
    """Fingerprint and component of every document; see the module for odd rows."""
    docs = table(spark, sf_dir, "documents")
    return grouped(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
