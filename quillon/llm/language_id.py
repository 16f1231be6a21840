"""Language identification by nearest centroids of TF-IDF character n-grams.

A text's letters (lower-cased, everything else one space) give n-grams of one to three
characters, hashed to DIMS columns; counts are damped, weighted by inverse document
frequency and scaled to length one. Each language is clustered into up to CLUSTERS
centroids by spherical k-means. A text gets the language of the centroid of largest cosine,
and is rejected when it has no letter or that cosine is below the language's own limit,
which lies well under what its training texts reach (letter junk and unlearned languages of
the same alphabet reach less; near relatives and texts of a few letters can go either way).

The centroids are fitted on a sample of about SAMPLE labelled rows in all, shared equally by
the languages (a language with fewer rows gives all), chosen by a hash of doc_id; equal texts
of a language count once. Every value
of lang is learned, however many there are, from about FEW rows at least if it has them. The
features are computed on the executors; the driver gets 2 bytes x DIMS a row: some 32 MB up to
SAMPLE / FEW languages, and beyond that some 64 KB a language.

Null or empty texts and texts without a letter are "und" with score 0. Whole texts are used
whatever their length. Ties: equal cosines go to the smaller language name. Rows without lang,
text or doc_id are not learned from; with nothing to learn from, every text is "und".
Repeated rows are judged alike and learned from once; a doc_id with several texts is learned
from with each, so the order of rows changes nothing. Empty tables give empty results. Extra
columns are kept, but those named like an output are replaced.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import broadcast_if_small, cut, for_python, table

DIMS = 4096
CLUSTERS = 3
ROUNDS = 8
SAMPLE = 4000
FEW = 8
#: The shares of languages are broadcast up to so many languages.
BROADCAST_LANGUAGES = 100_000
#: No code point from here on is a letter (Unicode has assigned none beyond this plane).
LETTERS = 0x40000
#: Longer texts are counted in pieces of so many characters that overlap by two.
PIECE = 1 << 20
#: The limit of a language, as a share of the cosine that one in a hundred of its training
#: texts falls short of.
LIMIT_SHARE = 0.5
UNKNOWN = "und"


class _Folded:
    """For each code point: its lower case if it is a letter, a space otherwise."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            lut = np.full(sys.maxunicode + 1, 32, np.uint32)
            for c in range(LETTERS):
                x = chr(c)
                if x.isalpha():
                    low = x.lower()
                    lut[c] = ord(low) if len(low) == 1 else c
            cls.table = lut
        return cls.table


def _grams(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter."""
    counts, seen = np.zeros(DIMS, np.int64), False
    mix = np.uint32(2654435761)
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - 2) : at + PIECE] if at else text[:PIECE]
        a = _Folded.get()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")]
        letter = a != 32
        if not letter.any():
            continue
        seen = True
        a = np.concatenate(([np.uint32(32)], a, [np.uint32(32)]))
        a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
        one = a * mix
        two = (one[:-1] ^ (a[1:] + np.uint32(0x9E3779B9))) * mix
        three = (two[:-1] ^ (a[2:] + np.uint32(0x85EBCA6B))) * mix
        shift = np.uint32(32 - (DIMS.bit_length() - 1))
        for h in (one, two, three):
            counts += np.bincount(h >> shift, minlength=DIMS)
    return counts if seen else None


def features(text: str | None) -> np.ndarray | None:
    """Damped counts, as 32-bit floats; None without a letter."""
    counts = _grams(text) if text else None
    return None if counts is None else np.log1p(counts).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Model:
    """Centroids (rows of length one), the language of each, and each language's limit."""

    def __init__(self, names: list[str], x: np.ndarray, seed: int = 7):
        """names: the language of each row of x, the rows' features."""
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        unit = _unit(x * self.idf)
        self.languages = sorted(set(names), key=lambda s: s.encode("utf-8", "surrogatepass"))
        place = {name: k for k, name in enumerate(self.languages)}
        own = np.array([place[n] for n in names])
        rng, centroids, of = np.random.default_rng(seed), [], []
        for k in range(len(self.languages)):
            rows = unit[own == k]
            c = rows[rng.choice(len(rows), min(CLUSTERS, len(rows)), replace=False)]
            for _ in range(ROUNDS):
                nearest = (rows @ c.T).argmax(1)
                c = _unit(np.array([rows[nearest == j].sum(0) if (nearest == j).any() else c[j] for j in range(len(c))]))
            centroids.append(c)
            of += [k] * len(c)
        self.centroids, self.of = np.concatenate(centroids).astype(np.float32), np.array(of)
        best = unit @ self.centroids.T
        self.limits = np.array([
            LIMIT_SHARE * np.quantile(best[own == k][:, self.of == k].max(1), 0.01) for k in range(len(self.languages))
        ])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is rejected."""
        x = features(text)
        if x is None:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ _unit(x * self.idf)
        best = int(cosines.argmax())  # languages are in order, so the first of equals
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[self.of[best]], score, score < self.limits[self.of[best]]


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull()
    return docs.select("doc_id", "lang", "text").filter(usable & (fold != 1))


def fit(rows: DataFrame) -> Model | None:
    """A model from rows of doc_id, lang and text, or None if there is nothing to learn."""
    sizes = cut(
        rows.groupBy("lang", "doc_id").agg(F.lit(1).alias("__qn_one"))
        .groupBy(F.col("lang").alias("__qn_lang")).agg(F.count("__qn_one").alias("__qn_n"))
    )
    languages = sizes.count()
    if not languages:
        return None
    each = max(SAMPLE // languages, FEW)
    # A number from 0 to 1 fixed by doc_id; a language's share of it gives its sample.
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    wanted = (F.col("lang") == F.col("__qn_lang")) & (place < F.least(F.lit(1.0), F.lit(float(each)) / F.col("__qn_n")))
    shares = broadcast_if_small(sizes, BROADCAST_LANGUAGES)
    # equal texts are the same whichever of them is kept
    sample = rows.join(shares, wanted).withColumn("__qn_digest", F.md5("text")).dropDuplicates(["lang", "__qn_digest"])

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            packed = [None if f is None else f.astype(np.float16).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["lang", "x"])

    got = for_python(sample.select("lang", "text")).mapInArrow(run, "lang string, x binary").filter("x is not null").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # rows arrive in no fixed order
    return Model([r["lang"] for r in got], np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32))


def identify(
    docs: DataFrame, model: Model | None, keep: list[str] | None = None, names=("lang_pred", "lang_score", "lang_rejected")
) -> DataFrame:
    """The columns of keep (all by default) with language, cosine and rejection under names."""
    made = {name.lower() for name in names}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())):
        schema = schema.add(name, kind)
    n = len(keep)

    def run(batches):
        for batch in batches:
            judge = model.predict if model else lambda t: (UNKNOWN, 0.0, True)
            got = [judge(t.as_py()) for t in batch.column(n)]
            new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=schema.fieldNames())

    return for_python(docs.select(*keep, F.col("text").alias("__qn_judged"))).mapInArrow(run, schema)


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language the model, fitted on their labels, doesn't reject."""
    names = ("__qn_pred", "__qn_score", "__qn_rejected")
    judged = identify(docs, fit(training_rows(docs)), names=names)
    return judged.filter(~F.col(names[2])).select(*docs.columns)


def op9_language_id(spark, sf_dir):
    """Language and score of every document; see the module for odd rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    return identify(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
