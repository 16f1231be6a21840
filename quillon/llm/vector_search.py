"""Nearest neighbours by a block matrix join over int8 codes.

Equal vectors are merged first: a class keeps its vector and, of its ids, the smallest
k + 1, which is all that any answer can use. Classes are dealt to clusters by the nearest of
PIVOTS vectors, and a cluster to blocks of BLOCK by hash. A query meets its own cluster first, and
its k-th distance there bounds its answers; by the triangle inequality, it then meets only the
other clusters whose pivot and radius allow something as near. Blocks of queries and of candidates
meet in tiles, keyed so that tiles spread over all tasks.

In a tile both sides are quantised to int8 with one scale a vector. The product of the codes
(exact in 32-bit floats as long as a slice has at most SLICE dimensions) gives each
distance within a bound: with quantisation errors e(q) and e(x), measured for each vector,
|d - d'| <= e(q) + e(x). A candidate survives if d' less the bound is within the k-th
smallest d' plus its bound. Survivors are recomputed in double precision on the original
vectors, and a heap of the best of a tile goes on; the heaps of a query's tiles are merged into
one as they come, sorted by query.

Null or empty vectors, vectors holding a null, NaN or infinity, and zero vectors take no
part, as candidate or query; nor does a row without an id. Vectors of different lengths are
never compared. Rows that repeat an id and its vector count once; an id that has several
vectors is a query and a candidate with each. Ties go to the smaller id. Fewer candidates than k
give all of them. Vectors may be long. Empty tables give empty results; extra columns don't
matter, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, table

#: Most vectors in a block; a tile then holds 2 x BLOCK vectors and a slice of distances.
BLOCK = 16384
#: Vectors that clusters form around, chosen by a hash of their ids; they are all broadcast.
PIVOTS = 64
#: Dimensions whose int8 products sum exactly in a 32-bit float: 127 * 127 * 1024 < 2 ** 24.
SLICE = 1024
#: Distances held at once in a tile.
CELLS = 1 << 22
EVERY = 100


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v (an array of doubles or floats) and class (128 hashed bits of v) of the rows that take part."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    kept = rows.filter(good & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"),
        F.transform(v, lambda x: x + F.lit(0).cast(rows.schema[vector].dataType.elementType)).alias("v"),
    )  # adding 0 makes -0.0 and 0.0 one
    named = F.concat_ws(":", F.xxhash64("v"), F.xxhash64("v", F.lit("again")))
    return kept.withColumn("class", named)


def classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """One row per distinct vector: class, v, ids (the smallest k + 1), asked (holds a query).

    Ids are merged within each Arrow batch first, so a vector that very many rows share
    sends a few rows a task.
    """
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found: dict[str, list] = {}
            first: dict[str, int] = {}
            for at, (i, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                found.setdefault(name, []).append(i)
                first.setdefault(name, at)
            least = [heapq.nsmallest(k + 1, set(x)) for x in found.values()]
            asked = [any(i % every == 0 for i in x) for x in found.values()]
            vectors = batch.column(1).take(pa.array(list(first.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), vectors, pa.array(least, pa.list_(pa.int64())), pa.array(asked, pa.bool_())],
                names=["class", "v", "ids", "asked"],
            )

    parts = rows.select("id", "v", "class").mapInArrow(run, f"class string, v {kind}, ids array<bigint>, asked boolean")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return parts.groupBy("class").agg(F.first("v").alias("v"), smallest.alias("ids"), F.max("asked").alias("asked"))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of x and, for each row, their scale and the length of its quantisation error."""
    scale = np.abs(x).max(1, initial=0) / 127
    scale[scale == 0] = 1.0
    c = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - c * scale[:, None], axis=1)
    return c, scale, error * (1 + 1e-9) + 1e-12 * scale


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 codes."""
    out = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, a.shape[1], SLICE):
        s = slice(at, at + SLICE)
        out += a[:, s].astype(np.float32) @ b[:, s].astype(np.float32).T
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances of paired rows, summed in order of the dimensions."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        gap = q[:, j] - x[:, j]
        total += gap * gap
    return np.sqrt(total)


def tile(q: np.ndarray, x: np.ndarray, need: int):
    """Pairs (i, j, distance) that hold the need nearest rows of x for each row of q."""
    qc, qs, qe = codes(q)
    xc, xs, xe = codes(x)
    qn = (qc.astype(np.float64) ** 2).sum(1) * qs * qs
    xn = (xc.astype(np.float64) ** 2).sum(1) * xs * xs
    step = max(1, CELLS // len(x))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        square = qn[part, None] + xn[None, :] - 2 * (qs[part, None] * xs[None, :]) * product(qc[part], xc)
        about = np.sqrt(np.maximum(square, 0.0))
        # rounding of the squares themselves, which the square root can enlarge near zero
        slack = np.sqrt(1e-13 * (qn[part, None] + xn[None, :]))
        bound = qe[part, None] + xe[None, :] + slack
        if len(x) > need:
            most = np.partition(about + bound, need - 1, axis=1)[:, need - 1]
            i, j = np.nonzero(about - bound <= most[:, None])
        else:
            i, j = np.divmod(np.arange(about.size), len(x))
        for cut_at in range(0, len(i), CELLS // 4):
            a, b = i[cut_at : cut_at + CELLS // 4] + at, j[cut_at : cut_at + CELLS // 4]
            yield a, b, distances(q[a], x[b])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


class Pivots:
    """Vectors to cluster by; a cluster is the place of its pivot, or -1 for lengths that have none."""

    def __init__(self, vectors: list[list[float]]):
        unique = sorted({tuple(v) for v in vectors})
        self.places = {n: [i for i, v in enumerate(unique) if len(v) == n] for n in {len(v) for v in unique}}
        self.vectors = {n: np.array([unique[i] for i in found], np.float64) for n, found in self.places.items()}

    def rows(self, column) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """For each length: which rows of an Arrow list column have it, the length, and their vectors."""
        sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
        found = []
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            found.append((at, int(n), _matrix(column.take(pa.array(at)))))
        return found

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each row of x to each pivot of its length."""
        return np.stack([np.linalg.norm(x - p, axis=1) for p in self.vectors[x.shape[1]]], axis=1)


def placed(merged: DataFrame, pivots: Pivots) -> DataFrame:
    """merged with dims, cluster and far, the distance from the cluster's pivot."""

    def run(batches):
        for batch in batches:
            size = batch.num_rows
            dims, cluster, far = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size)
            for at, n, x in pivots.rows(batch.column(1)):
                dims[at] = n
                if n in pivots.places:
                    d = pivots.distances(x)
                    best = d.argmin(1)
                    cluster[at], far[at] = np.array(pivots.places[n])[best], d[np.arange(len(at)), best]
            new = [pa.array(dims), pa.array(cluster), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "dims", "cluster", "far"])

    kind = merged.schema["v"].dataType.simpleString()
    return merged.mapInArrow(run, f"class string, v {kind}, ids array<bigint>, asked boolean, dims int, cluster int, far double")


def wanted(asked: DataFrame, pivots: Pivots, radii: dict[int, float]) -> DataFrame:
    """asked (class, v, dims, cluster, bound) with clusters: the others that may hold something within bound.

    radii: by cluster, the largest distance from its pivot. A null bound allows every cluster.
    """

    def run(batches):
        for batch in batches:
            found = [[]] * batch.num_rows
            own = batch.column(3).to_numpy(zero_copy_only=False)
            bound = np.array([np.inf if b is None else b for b in batch.column(4).to_pylist()])
            for at, n, x in pivots.rows(batch.column(1)):
                if n not in pivots.places:
                    continue
                places = np.array([c for c in pivots.places[n] if c in radii])
                radius = np.array([radii[c] for c in places])
                d = pivots.distances(x)[:, [c in radii for c in pivots.places[n]]]
                near = d - radius <= (bound[at] * (1 + 1e-9))[:, None] + 1e-9 * (d + radius)
                near &= places[None, :] != own[at][:, None]
                for row, some in zip(at.tolist(), near):
                    found[row] = places[some].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["class", "v", "dims", "clusters"])

    kind = asked.schema["v"].dataType.simpleString()
    return asked.select("class", "v", "dims", "cluster", "bound").mapInArrow(run, f"class string, v {kind}, dims int, clusters array<int>")


def merged_heaps(found: DataFrame, size: int) -> DataFrame:
    """class and best, the size least (score, id) of its rows; a task holds one heap at a time."""

    def run(batches):
        name, heap = None, []
        for batch in batches:
            names, out = [], []
            for n, i, d in zip(*(c.to_pylist() for c in batch.columns)):
                if n != name:
                    if name is not None:
                        names.append(name)
                        out.append([{"score": -d, "ids": -i} for d, i in sorted(heap, reverse=True)])
                    name, heap = n, []
                if len(heap) < size:
                    heapq.heappush(heap, (-d, -i))
                elif (-d, -i) > heap[0]:
                    heapq.heapreplace(heap, (-d, -i))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, kind)], names=["class", "best"])
        if name is not None:
            last = [{"score": -d, "ids": -i} for d, i in sorted(heap, reverse=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([last], kind)], names=["class", "best"])

    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.int64())]))
    dealt = found.select("class", "ids", "score").repartition("class").sortWithinPartitions("class")
    return dealt.mapInArrow(run, "class string, best array<struct<score: double, ids: bigint>>")


def nearest(rows: DataFrame, id_column: str, vector: str, k: int = 10, every: int = EVERY) -> DataFrame:
    """query_id, rank, id and score: the k nearest other rows of each row whose id every divides."""
    spark = rows.sparkSession
    used = usable(rows, id_column, vector)
    # One class more than k, as a query's own class may hold no other id; a class counts
    # for its smallest id, and all k + 1 ids stand at the class's distance.
    need = k + 1
    chosen = used.select("v", "id").orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(PIVOTS).collect()
    pivots = Pivots([[float(a) for a in r["v"]] for r in chosen])
    merged = cut(placed(classes(used, k, every), pivots))
    stats = merged.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.sum(F.col("asked").cast("long")).alias("asked")).collect()
    if not stats:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    blocks = F.create_map(*[F.lit(x) for r in stats for x in (r["cluster"], -(-r["n"] // BLOCK))])
    down = -(-max(1, sum(r["asked"] for r in stats)) // BLOCK)
    spread = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    def run(queries, candidates):
        empty = pa.table({"class": pa.array([], pa.string()), "ids": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not candidates.num_rows:
            return empty
        q, x = _matrix(queries["v"]), _matrix(candidates["v"])
        names, ids = queries["class"].to_pylist(), candidates["ids"].to_pylist()
        best = [[] for _ in names]
        for a, b, d in tile(q, x, need):
            order = np.lexsort((b, d, a))
            a, b, d = a[order], b[order], d[order]
            starts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]))
            for s, e in zip(starts[:-1], starts[1:]):
                heap = best[a[s]]
                last = d[min(e, s + need) - 1]
                while s < e and d[s] <= last:  # ties of the last are kept until ids decide
                    heap += [(d[s], i) for i in ids[b[s]]]
                    s += 1
                best[a[s - 1]] = heapq.nsmallest(need, heap)
        flat = [(n, i, float(d)) for n, heap in zip(names, best) for d, i in heap]
        columns = list(zip(*flat)) or [(), (), ()]
        return pa.table({"class": pa.array(columns[0], pa.string()), "ids": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ("dims", "cluster", "qb", "xb")

    def tiles(queries, candidates):
        """class, ids and score of the best of each tile, for queries (class, v, dims, cluster)."""
        left = queries.select("dims", "cluster", spread(F.lit(down)).alias("qb"), "class", "v", each(blocks[F.col("cluster")]).alias("xb"))
        right = candidates.select("dims", "cluster", spread(blocks[F.col("cluster")]).alias("xb"), "ids", "v", each(F.lit(down)).alias("qb"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "class string, ids bigint, score double")

    asked = merged.filter("asked").select("class", "v", "dims", "cluster")
    first = cut(merged_heaps(tiles(asked, merged), need))
    last = F.when(F.size("best") == need, F.element_at("best", -1)["score"])
    others = wanted(asked.join(first.select("class", last.alias("bound")), "class", "left"), pivots, {r["cluster"]: r["far"] for r in stats})
    others = others.withColumn("cluster", F.explode("clusters"))
    again = first.select("class", F.explode("best").alias("b")).select("class", F.col("b.ids").alias("ids"), F.col("b.score").alias("score"))
    heaps = merged_heaps(tiles(others, merged).unionByName(again), need)
    # Back to single rows: one row a query, so a class that many queries share can be split.
    queries = used.filter(F.col("id") % every == 0).select("class", F.col("id").alias("query_id")).distinct()
    own = F.filter("best", lambda b: b["ids"] != F.col("query_id"))
    answers = queries.join(heaps, "class").select(
        "query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "b")
    )
    return answers.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.ids").alias("vec_id"), F.col("b.score").alias("score")
    )


def op3_vector_search(spark, sf_dir):
    """The 10 nearest of every hundredth vector; see the module for odd rows."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


OP3_SQL = r"""
WITH e AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v),
    lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
