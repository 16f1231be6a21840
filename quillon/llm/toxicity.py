"""Toxicity by class-conditional Kneser-Ney models.

An expression is a run of letters, lower-cased. Either class (toxic, ordinary) has an
interpolated Kneser-Ney model of expressions that backs off from the whole expression to ever
shorter beginnings of it and at last to shared counts:

    P(e | class) = sum over beginnings p of e: X(p) / N * S(e | p)  +  (1 - sum of all X / N) * S(e)

S is the shared continuation distribution: an expression counts once for every document that
has it, whatever the labels, however often. N is the same count over the class's documents, and
X(p) is what absolute discounting leaves of the class's count of beginning p, after the longer
beginnings have taken theirs. The discount is no constant: DISCOUNT, plus SPARED times the
count that shared counts lead to expect, plus NOISE of its standard deviations. So rare
expressions, and ordinary ones of either class, are judged by the shared counts alone, and what
a class has in excess counts for all expressions that begin alike. Since S(e | p) / S(e) is
1 / S(p), the classes' likelihoods are compared without S(e) itself, and only beginnings with
an excess are needed to score; both probabilities sum to one over all expressions.

A document's one feature is its length-normalised comparison: the difference of its two
log-likelihoods divided by its number of expressions. Its score is a monotone function of that,
a logistic curve fitted to held-out folds of the training sample.

The classes are fitted on about SAMPLE labelled documents of each, chosen by a hash of doc_id;
equal texts count once. The shared counts are an aggregate over all documents, a row for every
expression of the corpus. Everything is counted in Spark; the driver gets the beginnings that
exceed their discount in the sample, and a number for each of its documents.

Null texts and texts without letters have no expressions and are scored like an expression
that neither class has in excess. Whole texts are scored, in time linear in their length. Rows without a
label, doc_id or text are not learned from; a doc_id with several labels is toxic if one says
so, and one with several texts is learned from with each, so the order of rows changes nothing.
Repeated rows are scored alike; there are no ties to break. Without both classes to learn from
every score is 0. Columns of score()'s input that aren't kept don't matter, and one named like
its output is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import broadcast_if_small, cut, for_python, table

#: Labelled documents of each class (ordinary, toxic) that the models are fitted on, about.
SAMPLE = (4000, 2500)
#: The discount of a beginning with an expected count x is DISCOUNT + SPARED * x + NOISE * sqrt(x).
DISCOUNT, SPARED, NOISE = 8.0, 1.2, 4.0
#: Folds of the sample, each scored by models of the others to fit the curve.
FOLDS = 5
#: Ends a whole expression; never a letter.
END = "$"
#: Distinct expressions that a task counts before it passes them on.
PIECE = 200_000
#: Expressions whose ratios a task remembers before it starts afresh.
KNOWN = 200_000
#: Beginnings that are broadcast to the corpus's expressions at most (some 100 bytes each).
BROADCAST_BEGINNINGS = 1_000_000

EXPRESSION = re.compile(r"[^\W\d_]+")


def expressions(text: str | None) -> list[str]:
    return EXPRESSION.findall(text.lower()) if text else []


def counted(docs: DataFrame, keys: tuple = ()) -> DataFrame:
    """The keys, e and n: in how many rows of docs (the keys, text) each expression occurs."""
    schema = T.StructType([docs.schema[k] for k in keys]).add("e", T.StringType()).add("n", T.LongType())
    width = len(keys)

    def run(batches):
        seen: dict[tuple, Counter] = {}

        def parts():
            for key, counts in seen.items():
                columns = [pa.array([x] * len(counts), f.type) for x, f in zip(key, fields)]
                columns += [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
            seen.clear()

        fields = []
        for batch in batches:
            fields = list(batch.schema)[:width]
            rows = zip(*[c.to_pylist() for c in batch.columns[:width]]) if width else iter(lambda: (), None)
            for key, text in zip(rows, batch.column(width)):
                seen.setdefault(key, Counter()).update(set(expressions(text.as_py())))
                if sum(map(len, seen.values())) > PIECE:
                    yield from parts()
        yield from parts()

    found = for_python(docs.select(*keys, "text")).mapInArrow(run, schema)
    return found.groupBy(*keys, "e").agg(F.sum("n").alias("n"))


def beginnings(counts: DataFrame, longest: int | None = None) -> DataFrame:
    """counts with p instead of e, a row for each beginning of it, from the empty one to the whole."""
    whole = F.concat("e", F.lit(END))
    size = F.length(whole) if longest is None else F.least(F.length(whole), F.lit(longest))
    places = F.transform(F.sequence(F.lit(0), size), lambda i: F.substring(whole, F.lit(1), i))
    return counts.select(*[c for c in counts.columns if c != "e"], F.explode(places).alias("p"))


def discount(expected):
    """What a class's count must exceed, given the count that shared counts lead to expect."""
    return DISCOUNT + SPARED * expected + NOISE * expected**0.5


def excess(counts: dict[str, float], shared: dict[str, float]) -> tuple[float, dict[str, float]]:
    """The rest that backs off to the shared distribution, and X(p) / N / S(p) of each beginning.

    counts and shared: counts by beginning, the empty one's being the total. Beginnings that
    don't exceed their discount may be missing.
    """
    total, everything = counts.get("", 0.0), shared.get("", 0.0)
    if not total or not everything:
        return 1.0, {}
    taken, found = Counter(), {}
    for p in sorted(counts, key=lambda p: (-len(p), p)):
        if not p:
            continue
        # a sample's expressions are in the corpus, so expected counts aren't zero
        expected = total * max(shared.get(p, 0.0), counts[p]) / everything
        left = counts[p] - taken[p] - discount(expected)
        if left > 0:
            found[p] = left / expected
            for size in range(len(p)):
                taken[p[:size]] += left
    return 1 - taken[""] / total, found


def model_of(counts: tuple[dict, dict], shared: dict) -> dict:
    """Both classes' rests, and by beginning what it adds to each likelihood; plain data."""
    (rest0, found0), (rest1, found1) = (excess(c, shared) for c in counts)
    nodes = {}
    for p in {*found0, *found1}:
        nodes[p] = (found0.get(p, 0.0), found1.get(p, 0.0))
        for size in range(1, len(p)):  # a way to each of them
            nodes.setdefault(p[:size], (0.0, 0.0))
    return {"rests": (rest0, rest1), "nodes": nodes}


class Ratios(dict):
    """log P(e | toxic) - log P(e | ordinary) of each expression that is asked for."""

    def __init__(self, model: dict):
        super().__init__()
        self.rests, self.nodes = model["rests"], model["nodes"]

    def __missing__(self, e: str) -> float:
        (p0, p1), nodes, whole = self.rests, self.nodes, e + END
        for size in range(1, len(whole) + 1):
            found = nodes.get(whole[:size])
            if found is None:
                break
            p0, p1 = p0 + found[0], p1 + found[1]
        ratio = self[e] = math.log(max(p1, 1e-300)) - math.log(max(p0, 1e-300))
        return ratio

    def feature(self, text: str | None) -> float:
        """The length-normalised comparison of a whole text."""
        words = expressions(text)
        if not words:
            return math.log(max(self.rests[1], 1e-300)) - math.log(max(self.rests[0], 1e-300))
        found = sum(map(self.__getitem__, words)) / len(words)
        if len(self) > KNOWN:
            self.clear()
        return found


def curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float, float, float]:
    """Centre and scale of the feature, slope (never negative) and constant of the logistic curve."""
    ordinary = x[~y]
    centre, scale = float(np.median(ordinary)), float(max(ordinary.std(), 1e-6))
    z = np.stack([np.arcsinh((x - centre) / scale), np.ones(len(x))], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (weights * p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(hessian, z.T @ (weights * (p - y)) + ridge @ w)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    if w[0] < 0:  # no more toxic the likelier: only the classes' shares are left
        share = float(np.average(y, weights=weights))
        w = np.array([0.0, math.log(share / (1 - share))])
    return centre, scale, float(w[0]), float(w[1])


def scored(x: float, parameters: tuple) -> float:
    centre, scale, slope, constant = parameters
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, slope * math.asinh((x - centre) / scale) + constant))))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that may be learned from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.filter(F.col("toxic").isNotNull() & (fold != 0))
    return known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[float]]:
    """Distinct texts of the sample (toxic, fold, text), and what each row of a class stands for."""
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)
    share = [min(1.0, SAMPLE[c] / max(1, sizes.get(bool(c), 0))) for c in (0, 1)]
    chosen = cut(labels.filter(place < F.when(F.col("toxic"), share[1]).otherwise(share[0])))
    # about sum(SAMPLE) rows of a key and a flag, so the broadcast is bounded
    side = F.broadcast(chosen.withColumnRenamed("doc_id", "__qn_id"))
    texts = docs.select("doc_id", "text").filter("text is not null").join(side, F.col("doc_id") == F.col("__qn_id"))
    digest = F.md5("text")
    fold = F.pmod(F.xxhash64(digest), F.lit(FOLDS)).cast("int")
    once = texts.select("toxic", digest.alias("__qn_digest"), "text").dropDuplicates(["toxic", "__qn_digest"])
    return once.select("toxic", fold.alias("fold"), "text"), [1 / s for s in share]


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A classifier, as plain data. labels: doc_id and toxic (boolean), each doc_id once."""
    sample, weights = sampled(docs, labels)
    sample = cut(sample)
    if sample.select("toxic").distinct().count() < 2:
        return None
    # a class of the model per class and fold
    each = [(c, f) for c in (False, True) for f in range(FOLDS)]
    names = [f"n{int(c)}_{f}" for c, f in each]
    of = beginnings(counted(sample, ("toxic", "fold")))
    sums = [F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(n) for (c, f), n in zip(each, names)]
    total = lambda k: sum(F.col(n) for n in names[k * FOLDS : (k + 1) * FOLDS])
    nodes = of.groupBy("p").agg(*sums).filter((total(0) > DISCOUNT) | (total(1) > DISCOUNT) | (F.col("p") == ""))
    nodes = cut(nodes)
    longest = nodes.agg(F.max(F.length("p"))).first()[0] or 0
    corpus = beginnings(counted(docs), longest).withColumnRenamed("p", "__qn_p")
    known = broadcast_if_small(nodes.select("p"), BROADCAST_BEGINNINGS)
    shared = corpus.join(known, F.col("__qn_p") == F.col("p")).groupBy("p").agg(F.sum("n").alias("n"))
    joined = cut(nodes.join(shared, "p", "left").select("p", F.coalesce("n", F.lit(0)).alias("n"), *names))
    # Only what exceeds its discount in a class, of all or of all but one fold, goes to the driver.
    root = joined.filter("p = ''").first()
    wanted = F.col("p") == ""
    for left_out in (None, *range(FOLDS)) if root else ():  # no root: no expression in the sample
        for k in (False, True):
            own = [n for (c, f), n in zip(each, names) if c == k and f != left_out]
            have = sum(F.col(n) for n in own).cast("double")
            expected = sum(root[n] for n in own) * F.greatest("n", have) / float(root["n"])
            wanted = wanted | (have > discount(expected))
    rows = joined.filter(wanted).collect()
    held = {r["p"]: float(r["n"]) for r in rows}

    def classes(left_out):
        counts = ({}, {})
        for r in rows:
            for (c, f), n in zip(each, names):
                if f != left_out and r[n]:
                    counts[c][r["p"]] = counts[c].get(r["p"], 0.0) + r[n]
        return counts

    model = model_of(classes(None), held)
    folds = docs.sparkSession.sparkContext.broadcast([model_of(classes(f), held) for f in range(FOLDS)])

    def features(batches):
        ratios = [Ratios(m) for m in folds.value]
        for batch in batches:
            found = [ratios[f].feature(t) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["toxic", "x"])

    # a number for each document of the bounded sample
    got = for_python(sample).mapInArrow(features, "toxic boolean, x double").toArrow().sort_by([("x", "ascending"), ("toxic", "ascending")])
    y = got["toxic"].to_numpy(zero_copy_only=False).astype(bool)
    model["curve"] = curve(got["x"].to_numpy(), y, np.where(y, weights[1], weights[0]))
    return model


def score(docs: DataFrame, model: dict | None, keep: list[str], name: str = "toxicity") -> DataFrame:
    """The columns of keep and, under name, the score from 0 to 1."""
    keep = [c for c in keep if c.lower() != name.lower()]
    schema = T.StructType([docs.schema[c] for c in keep]).add(name, T.DoubleType())
    n = len(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        ratios = Ratios(model) if model else None  # a task's own, so a worker's memory doesn't grow with its tasks
        for batch in batches:
            texts = (t.as_py() for t in batch.column(n))
            found = [scored(ratios.feature(t), model["curve"]) if model else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, pa.float64())], names=[*keep, name])

    return for_python(docs.select(*keep, F.col("text").alias("__qn_scored"))).mapInArrow(run, schema)


def op2_toxicity(spark, sf_dir):
    """doc_id, held_out, score and predicted of every document; see the module for odd rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
