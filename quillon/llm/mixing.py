"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words per document, summed per source. Targets follow from a water level: each
source gets level x weight words, at most MAX_REPEATS times what it has, and the level is
the one at which the targets add up to all words; it is found by resharing the excess of full
sources until none is above, a small aggregate over sources each time. A source's rate is
target / size. Each document is taken floor(rate) times, plus once more by a Bernoulli draw of
its own, seeded by a hash of its id and text, whose probability is the rate's fraction.

The draws of a source are those of stratified, systematic sampling, so that its words come near
the target. Its documents lie in strata of sizes (stratum()); of strata in the order of
there_and_back(), the running sum of fraction x documents, moved by one hash-seeded number of the
source, gives each stratum a whole number of copies, which go to its documents of least hash.
Over hashes that is the fraction as a probability, for every document. The least hashes are
found by a histogram of BINS bins for each stratum; within the last of them, documents draw by
further bits.

Nulls, empty texts and empty tables: a null or empty text has size 0 and is never taken;
null is a source of its own, after all others; an empty table gives an empty mix. Very long
texts are documents like others: one that holds much of its source moves what the source takes
by as much. Ties: sources of equal fill become full together. Repeated rows are documents of
their own but share one draw, as it depends on doc_id and text. Extra columns are kept, and
helper columns carry a prefix that keeps them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACED_WORD, broadcast_if_small, cut, table

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-2"
#: The table of strata is broadcast up to so many rows (some 100 bytes each). A source has some
#: 18 of them for each decimal place of its longest document's size.
BROADCAST_STRATA = 100_000
#: Parts that a stratum's documents are dealt to where that table is joined by a shuffle.
SALTS = 64
#: Bins of a stratum's hashes; documents are counted per bin.
BINS = 512


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def stratum(size: Column) -> Column:
    """Of sizes: decimal places, first digit, and which half of it; in the order of sizes."""
    s = size.cast("string")
    half = F.when(F.substring(s, 2, 1) >= "5", 1).otherwise(0)
    return F.length(s) * 100 + F.substring(s, 1, 1).cast("int") * 10 + half


def there_and_back(stratum_: Column) -> Column:
    """An order of strata: every second one up, the others down, so that rounding favours no size."""
    return F.when(stratum_ % 2 == 0, stratum_).otherwise(1_000_000 - stratum_)


def _hashed(*parts: Column) -> Column:
    """52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("long")


def coin(seed=SEED) -> Column:
    """52 bits fixed by a document's id and text: its bin, and above that its draw."""
    own = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))
    return _hashed(F.lit(seed + "|"), *own)


def sized(docs: DataFrame, keep: list[str], seed=SEED) -> DataFrame:
    """The columns of keep and, with a prefix, source, size, stratum, bin and draw (0 to 1)."""
    made = docs.select(
        *[F.col(c) for c in keep],
        F.col("source").alias("__qn_source"),
        word_count(F.col("text")).alias("__qn_size"),
        coin(seed).alias("__qn_coin"),
    )
    return made.select(
        *keep, "__qn_source", "__qn_size",
        stratum(F.col("__qn_size")).alias("__qn_stratum"),
        F.pmod("__qn_coin", F.lit(BINS)).cast("int").alias("__qn_bin"),
        (F.floor(F.col("__qn_coin") / BINS) / float((1 << 52) // BINS)).alias("__qn_draw"),
    )


def histogram(documents: DataFrame) -> DataFrame:
    """source, stratum, bin, n (documents with words) and words, from sized()."""
    n = F.sum(F.when(F.col("__qn_size") > 0, 1).otherwise(0))
    grouped = documents.groupBy("__qn_source", "__qn_stratum", "__qn_bin").agg(n.alias("n"), F.sum("__qn_size").alias("words"))
    return grouped.select(F.col("__qn_source").alias("source"), F.col("__qn_stratum").alias("stratum"), F.col("__qn_bin").alias("bin"), "n", "words")


def turns(sizes: DataFrame) -> DataFrame:
    """sizes (a row per source) with turn, from 0, by code point and null last.

    Sources are dealt to ranges and numbered within each, so no task sees all of them.
    """
    by_name = F.col("source").asc_nulls_last()
    dealt = cut(sizes.repartitionByRange(by_name).withColumn("__qn_part", F.spark_partition_id()))
    # a row per range, of which there are as many as shuffle partitions
    before = Window.orderBy("__qn_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__qn_part").agg(F.count(F.lit(1)).alias("__qn_n"))
    starts = starts.select(F.col("__qn_part").alias("__qn_range"), F.coalesce(F.sum("__qn_n").over(before), F.lit(0)).alias("__qn_start"))
    within = F.row_number().over(Window.partitionBy("__qn_part").orderBy(by_name))
    placed = dealt.withColumn("__qn_within", within - 1).join(F.broadcast(starts), F.col("__qn_part") == F.col("__qn_range"))
    return placed.select(*sizes.columns, (F.col("__qn_start") + F.col("__qn_within")).alias("turn"))


def water_level(sources: DataFrame) -> float:
    """The level, of a row per source with weight, source_size and most."""
    level = 0.0
    while True:
        full = F.col("most").cast("double") / F.col("weight") <= level
        free = F.sum(F.when(full, 0).otherwise(F.col("weight")))
        spent = F.sum(F.when(full, F.col("most")).otherwise(0))
        total, spent, free = sources.agg(F.sum("source_size"), spent, free).first()
        if not free:  # no words at all, or no source
            return level
        # with the full sources at their most, the others share the rest by weight
        higher = float(total - spent) / float(free)
        if higher <= level:
            return level
        level = higher


def source_targets(counts: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """One row per source of a histogram: source, source_size, target and rate."""
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.element_at(cycle, (F.col("turn") % len(weights) + 1).cast("int"))
    sources = cut(turns(sizes).withColumn("weight", weight).withColumn("most", F.col("source_size") * max_repeats))
    target = F.least(F.col("most").cast("double"), F.lit(water_level(sources)) * F.col("weight"))
    made = sources.select("source", "source_size", target.alias("target"))
    rate = F.least(F.lit(float(max_repeats)), F.col("target") / F.col("source_size"))
    return made.withColumn("rate", F.when(F.col("source_size") > 0, rate).otherwise(F.lit(0.0)))


def plan(counts: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS, seed=SEED) -> DataFrame:
    """One row per source and stratum of a histogram: source_size, target, rate, and who gets a copy more.

    Documents in bins before last do, and those in it whose draw x n is below more.
    """
    targets = source_targets(counts, weights, max_repeats).withColumnRenamed("source", "__qn_name")
    strata = counts.groupBy("source", "stratum").agg(F.sum("n").alias("n"))
    named = strata.join(targets, F.col("source").eqNullSafe(F.col("__qn_name")))
    start = _hashed(F.lit(seed + "|source|"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))) / float(1 << 52)
    fraction = F.col("rate") - F.floor("rate")
    whole = lambda n: F.floor(fraction * n.cast("double") + F.col("__qn_start"))
    # the strata of a source, and the bins of a stratum: bounded numbers of rows
    upto = Window.partitionBy("source").orderBy(there_and_back(F.col("stratum"))).rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("__qn_start", start).withColumn("__qn_upto", F.sum("n").over(upto))
    more = whole(F.col("__qn_upto")) - whole(F.col("__qn_upto") - F.col("n"))
    wanted = cut(placed.select("source", "stratum", "source_size", "target", "rate", more.alias("wanted")))
    before = Window.partitionBy("source", "stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    run = counts.select(
        F.col("source").alias("__qn_name"), F.col("stratum").alias("__qn_stratum"), "bin", "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__qn_before"),
    )
    same = F.col("source").eqNullSafe(F.col("__qn_name")) & (F.col("stratum") == F.col("__qn_stratum"))
    last = (F.col("__qn_before") < F.col("wanted")) & (F.col("wanted") <= F.col("__qn_before") + F.col("n"))
    return wanted.join(run, same & last, "left").select(
        "source", "stratum", "source_size", "target", "rate", F.coalesce("bin", F.lit(-1)).alias("last"), "n",
        (F.col("wanted") - F.col("__qn_before")).alias("more"),
    )


def mix_plan(docs: DataFrame, keep: list[str], weights=WEIGHTS, max_repeats=MAX_REPEATS, seed=SEED):
    """The columns of keep with __qn_size, __qn_source_size, __qn_target and __qn_copies, a row per document."""
    counts = cut(histogram(sized(docs, [], seed)))
    planned = cut(plan(counts, weights, max_repeats, seed))
    planned = planned.select(*[F.col(c).alias(f"__qn_of_{c}") for c in planned.columns])
    side = broadcast_if_small(planned, BROADCAST_STRATA)
    documents = sized(docs, keep, seed)
    same = F.col("__qn_source").eqNullSafe(F.col("__qn_of_source")) & (F.col("__qn_stratum") == F.col("__qn_of_stratum"))
    if side is planned:  # too many strata to broadcast: deal each to SALTS parts
        side = planned.withColumn("__qn_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        deal = F.pmod(F.xxhash64("__qn_draw", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        documents = documents.withColumn("__qn_deal", deal)
        same = same & (F.col("__qn_deal") == F.col("__qn_part"))
    at_last = (F.col("__qn_bin") == F.col("__qn_of_last")) & (F.col("__qn_draw") * F.col("__qn_of_n").cast("double") < F.col("__qn_of_more").cast("double"))
    once_more = F.coalesce((F.col("__qn_bin") < F.col("__qn_of_last")) | at_last, F.lit(False)).cast("long")
    copies = F.when(F.col("__qn_size") > 0, F.floor("__qn_of_rate") + once_more).otherwise(F.lit(0)).cast("long")
    return documents.join(side, same, "left").select(
        *keep, "__qn_size", F.col("__qn_of_source_size").alias("__qn_source_size"), F.col("__qn_of_target").alias("__qn_target"),
        copies.alias("__qn_copies"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS, seed=SEED) -> DataFrame:
    """docs with every document repeated as often as the mix takes it."""
    plan = mix_plan(docs, docs.columns, weights, max_repeats, seed)
    each = F.explode(F.sequence(F.lit(1), F.col("__qn_copies").cast("int")))
    return plan.filter("__qn_copies > 0").withColumn("__qn_turn", each).select(*docs.columns)


def op10_mixing(spark, sf_dir):
    """size, source_size, target and taken of every document; see the module for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_plan(docs, ["doc_id"]).select(
        "doc_id",
        F.col("__qn_size").alias("size"),
        F.col("__qn_source_size").alias("source_size"),
        F.col("__qn_target").alias("target"),
        (F.col("__qn_size") * F.col("__qn_copies")).alias("taken"),
    )


OP10_SQL = r"""
WITH e AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-2|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT AS coin
  FROM documents),
d AS (
  SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 1)::INTEGER * 10
      + CASE WHEN substr(size::VARCHAR, 2, 1) >= '5' THEN 1 ELSE 0 END AS stratum,
    coin % 512 AS bin, (coin // 512)::DOUBLE / 8796093022208::DOUBLE AS draw
  FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, (turn % 3 + 1) AS weight, source_size * 3 AS most FROM r),
f AS (SELECT *, most::DOUBLE / weight AS fill FROM w),
l AS (
  SELECT *,
    ((sum(source_size) OVER ()) - coalesce(sum(most) OVER b, 0))::DOUBLE
      / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM f
  WINDOW b AS (ORDER BY fill NULLS FIRST, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most::DOUBLE, (max(level) OVER ()) * weight) AS target FROM l),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-2|source|' || coalesce('=' || source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS start
  FROM t),
n AS (SELECT source, stratum, bin, count(*) FILTER (size > 0) AS n FROM d GROUP BY source, stratum, bin),
g AS (SELECT source, stratum, sum(n)::BIGINT AS n FROM n GROUP BY source, stratum),
c AS (
  SELECT g.*, q.source_size, q.target, q.rate, q.rate - floor(q.rate) AS fraction, q.start,
    (sum(g.n) OVER (PARTITION BY g.source ORDER BY CASE WHEN g.stratum % 2 = 0 THEN g.stratum ELSE 1000000 - g.stratum END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, floor(fraction * upto::DOUBLE + start) - floor(fraction * (upto - n)::DOUBLE + start) AS wanted FROM c),
m AS (
  SELECT *, coalesce((sum(n) OVER (PARTITION BY source, stratum ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS before FROM n)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN (size * (floor(rate) + CASE WHEN d.bin < m.bin OR (d.bin = m.bin AND draw * m.n::DOUBLE < wanted - before) THEN 1 ELSE 0 END))::BIGINT ELSE 0 END AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.stratum = k.stratum
  LEFT JOIN m ON k.source IS NOT DISTINCT FROM m.source AND k.stratum = m.stratum AND before < wanted AND wanted <= before + m.n
"""
