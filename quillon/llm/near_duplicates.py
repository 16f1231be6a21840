"""Near-duplicates by SimHash and by the Jaccard similarity of word shingles, of which one stays.

Two texts link if simhash links their fingerprints, which its covering tables decide and miss
none of, or if the sets of their SHINGLE-word shingles have a similarity of LEAST or more. The
second is there because most pairs of that similarity differ in more bits than covering tables
can be made for; it adds to what simhash links and takes nothing from it. Groups are the
components of both kinds of links together.

Words are as in simhash; fewer words than a shingle's give one shingle of all of them. Texts
without words are equal to each other, and their fingerprint zero links like any other.

Candidates for similarity meet by MinHash: BANDS bands of ROWS minima each. A pair of similarity
s shares no band with probability (1 - s ** ROWS) ** BANDS, which is 3 in 100,000 at 0.8 and
less above. That is all that can be missed: within a bucket every pair that could join two
components is checked exactly, on the shingles' 64-bit hashes, so no pair below LEAST links
by similarity.

Equal sets are merged before any band is dealt, and buckets of the same members count once.
A bucket returns a star per component, never all pairs. One of more than TILE shingles is
dealt into parts, and each pair of parts is a task, so that memory is bounded; then the rows
sent are its members times the number of parts. Components and the row that stays are as in
simhash, and so are nulls, ties, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import broadcast_if_small, cut, for_python
from quillon.llm.simhash import BROADCAST_BUCKETS, BROADCAST_GONE, RADIUS, SEED, _signed, components, fingerprint, one_of_each, shingle_hashes
from quillon.llm.simhash import links as linked_prints

SHINGLE = 5
#: The least similarity, as a fraction so that it is compared exactly.
LEAST = (4, 5)
ROWS, BANDS = 4, 20
#: Shingles of a bucket (8 bytes each) that go to one task.
TILE = 2 << 20

_RANDOM = np.random.default_rng(SEED)
_FLIPS = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a whole text's shingles, each once, in order."""
    return np.unique(shingle_hashes(text, SHINGLE))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band; none without a shingle."""
    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1 << 12):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 12), None]
        least = np.minimum(least, ((part ^ _FLIPS) * _FACTORS).min(0))
    return [_signed(xxhash.xxh64_intdigest(x.tobytes())) for x in least.reshape(BANDS, ROWS)]


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, __qn_digest, fp (a digest of the set), size, bands and sim (simhash's fingerprint) for every row."""
    keep = ("doc_id", "__qn_digest")
    schema = T.StructType([docs.schema[c] for c in keep]).add("fp", T.LongType()).add("size", T.LongType())
    schema = schema.add("bands", T.ArrayType(T.LongType())).add("sim", T.LongType())

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(2)]
            new = [
                pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes())) for x in found], pa.int64()),
                pa.array(list(map(len, found)), pa.int64()),
                pa.array(list(map(bands, found)), pa.list_(pa.int64())),
                pa.array([_signed(fingerprint(t.as_py())) for t in batch.column(2)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], names=schema.fieldNames())

    return for_python(docs.select(*keep, F.col("text").alias("__qn_text"))).mapInArrow(run, schema)


def _hashes(docs: DataFrame) -> DataFrame:
    """fp and its set as bytes, from fp and text."""

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["fp", "x"])

    return for_python(docs.select("fp", "text")).mapInArrow(run, "fp bigint, x binary")


def _star(prints: np.ndarray, found: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (root, member) that join every component of sets that are alike."""
    sizes = np.array(list(map(len, found)))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values, flat = np.unique(np.concatenate(found), return_inverse=True)
    marked = np.zeros(len(values), np.int64)
    left = np.ones(len(found), bool)
    roots, reached = [], []
    for root in np.argsort(prints, kind="stable"):
        if not left[root]:
            continue
        left[root] = False
        frontier = [root]
        while frontier and left.any():
            one = frontier.pop()
            own = flat[starts[one] : starts[one] + sizes[one]]
            marked[own] = 1
            common = np.add.reduceat(marked[flat], starts)
            marked[own] = 0
            near = left & (LEAST[1] * common >= LEAST[0] * (sizes + sizes[one] - common))
            left &= ~near
            new = np.nonzero(near)[0].tolist()
            frontier += new
            roots += [int(prints[root])] * len(new)
            reached += [int(prints[k]) for k in new]
    return roots, reached


def links(classes: DataFrame, marked: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between sets, enough to join every component.

    classes: a row per set with fp, size, bands and __qn_row, one of its rows in marked.
    """
    dealt = classes.select("fp", "size", F.posexplode("bands").alias("t", "b"))
    of = F.xxhash64("fp", F.lit("bucket"))
    buckets = dealt.groupBy("t", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("fp").alias("low"), F.max("fp").alias("high"),
        F.bit_xor(of).alias("same"),
    ).filter("n > 1")
    once = buckets.groupBy("n", "weight", "low", "high", "same").agg(F.min(F.struct("t", "b")).alias("at"))
    # Parts are dealt by a hash of fp; a pair of them holds about a tile of shingles.
    once = once.select(F.col("at.t").alias("t"), F.col("at.b").alias("b"), F.ceil(2 * F.col("weight") / F.lit(tile)).alias("parts"))
    once = once.withColumn("parts", F.when(F.col("parts") <= 2, 1).otherwise(F.col("parts")).cast("int"))
    members = cut(dealt.join(broadcast_if_small(cut(once), BROADCAST_BUCKETS), ["t", "b"]).select("fp", "t", "b", "parts"))
    needed = members.select("fp").distinct().join(classes.select("fp", "__qn_row"), "fp")
    needed = cut(needed.select("fp", F.col("__qn_row.doc_id").alias("__qn_id"), F.col("__qn_row.of").alias("__qn_of")))
    same = F.col("doc_id").eqNullSafe(F.col("__qn_id")) & (F.col("__qn_digest") == F.col("__qn_of"))
    texts = marked.select("doc_id", "__qn_digest", "text").join(broadcast_if_small(needed, BROADCAST_GONE), same)
    hashed = _hashes(texts).dropDuplicates(["fp"])
    part = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiled = members.withColumn("part", part).withColumn("other", other)
    # The pair of a part with itself is covered by its pairs with others, if there are any.
    tiled = tiled.filter("parts = 1 or part <> other").select(
        "fp", "t", "b", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")
    )

    def run(pdf):
        import pandas as pd

        a, b = _star(pdf["fp"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in pdf["x"]])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return tiled.join(hashed, "fp").groupBy("t", "b", "p", "q").applyInPandas(run, "a bigint, b bigint").distinct()


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between sets, enough to join all whose fingerprints are in one of simhash's components.

    prints: rows with fp and sim. A fingerprint stands for its least set, which its others link to.
    """
    # Partial extremes are taken before the shuffle, so copies cost one row a task.
    sims = cut(prints.groupBy("sim").agg(F.min("fp").alias("__qn_least"), F.max("fp").alias("__qn_most")))
    near = cut(linked_prints(sims.select(F.col("sim").alias("fp")), radius))
    least = lambda node, name: sims.select(F.col("sim").alias(node), F.col("__qn_least").alias(name))
    first = cut(least("a", "__qn_a").join(broadcast_if_small(near, BROADCAST_BUCKETS), "a").select("__qn_a", "b"))
    between = least("b", "__qn_b").join(broadcast_if_small(first, BROADCAST_BUCKETS), "b")
    several = broadcast_if_small(sims.filter("__qn_least <> __qn_most"), BROADCAST_BUCKETS)
    within = prints.select("sim", "fp").join(several, "sim")
    return (
        between.select(F.col("__qn_a").alias("a"), F.col("__qn_b").alias("b"))
        .unionByName(within.select(F.col("__qn_least").alias("a"), F.col("fp").alias("b")))
        .filter("a <> b")
        .distinct()
    )


def deduplicated(docs: DataFrame, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """One row of each group: that of the smallest doc_id (null last), then of least digest."""

    def rooted(prints, marked):
        row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__qn_digest").alias("of")))
        classes = prints.groupBy("fp").agg(row.alias("__qn_row"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        classes = cut(classes)
        both = fingerprint_links(prints, radius).unionByName(links(classes, marked, tile))
        roots = components(both).withColumnRenamed("node", "fp")
        return classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))

    return one_of_each(docs, sets, rooted)
