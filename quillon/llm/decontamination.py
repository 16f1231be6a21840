"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A window is WINDOW consecutive words of an item (all of a shorter one). Window words are
ordered by rarity, counted over all documents. To hold a whole window a document must hold
its rarest word, the necessary prefix at full containment, so only that word is joined. Its
offset in the window and the window's length bound where the window can lie in the document,
its end words are compared, and what is left is verified word for word in place.

Documents are read twice, for the rarities and for the join, and neither pass shuffles more
than counts and hits. Windows are broadcast in chunks of at most CHUNK rows, a pass for each
chunk, so a benchmark of any size is joined in bounded memory; with several chunks documents
are first numbered and written once.

Null or empty texts have no words, and neither side of them matches. Items may repeat: ids
are listed once, and a null id is not listed. Repeated documents are rows of their own.
Ties: of equally rare words the smaller is the prefix, at its first place. Very long texts are
read whole. Extra columns don't matter; kept ones may have any name, but those named like an
output are replaced. An empty benchmark hits nothing;
no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_BYTES, ascii_lower, broadcast_if_small, cut, table, weighed

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Windows broadcast at once, about 300 bytes each; fewer if they hold more than BROADCAST_BYTES.
CHUNK = 200_000
#: Distinct benchmark words broadcast at once while documents' words are counted.
VOCABULARY = 1_000_000

OUTPUTS = ("n_words", "n_hit", "n_items", "items", "contaminated")

# Between words: every ASCII character but digits and letters. Case is lowered afterwards.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words in their own case; an empty string may stand first and last."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def word_total(words: Column) -> Column:
    """How many of raw_words() are words."""
    first = F.when(F.element_at(words, 1) == "", 1).otherwise(0)
    last = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (F.size(words) - first - last).cast("long")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: window (its words), text (joined by spaces) and ids of their items."""
    words = F.filter(raw_words(F.col("text")), lambda w: w != "")
    lowered = items.select(
        F.col("item_id").cast("string").alias("item_id"), F.transform(words, ascii_lower).alias("w")
    ).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = lowered.select("item_id", "w", F.explode(starts).alias("at"))
    each = each.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("ids"))


def rarities(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """word and how often documents hold it, for every word of a window."""
    vocabulary = cut(wins.select(F.explode("window").alias("w")).select(F.lower("w").alias("word")).distinct())
    side = broadcast_if_small(vocabulary, VOCABULARY)
    # lower() may merge words that differ in scripts beyond ASCII; it does so on both sides,
    # so no window is missed, and the verification below tells them apart.
    held = docs.select(F.explode(raw_words(F.col("text"))).alias("w")).select(F.lower("w").alias("word"))
    counted = lambda df: df.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # beyond the bound words are counted first, so that none is shuffled occurrence by occurrence
    counts = counted(held).join(side, "word", "left_semi") if side is vocabulary else counted(held.join(side, "word", "left_semi"))
    return vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest word (ties: the smaller word, then the first place)."""
    placed = wins.select("window", "ids", F.posexplode("window").alias("offset", "w"))
    ranked = placed.withColumn("word", F.lower("w")).join(counts, "word")
    first = ranked.groupBy("window").agg(
        F.min(F.struct("n", "word", "offset")).alias("rarest"), F.first("ids").alias("ids")
    )
    return first.select(
        F.col("rarest.word").alias("prefix"),
        F.col("rarest.offset").alias("offset"),
        F.size("window").alias("length"),
        F.lower(F.element_at("window", 1)).alias("head"),
        F.lower(F.element_at("window", -1)).alias("tail"),
        F.array_join("window", " ").alias("text_of"),
        F.array_sort("ids").alias("ids"),
    )


def hits(docs: DataFrame, joined: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each document (__qn_row) at least, and one for each window found: kept, n_words, hit.

    Only a document's first row holds its columns, however many windows it has.
    """
    words = F.col("__qn_words")
    placed = docs.select("__qn_row", *keep, raw_words(F.col("text")).alias("__qn_words"))
    placed = placed.select("*", word_total(words).alias("n_words"), F.posexplode("__qn_words").alias("__qn_at", "__qn_w"))
    start = F.col("__qn_at") - F.col("offset")
    in_place = F.slice(words, start + 1, F.col("length"))
    lowered = F.translate(F.array_join(in_place, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = (
        F.col("prefix").isNotNull()
        & (start >= 0)
        & (start + F.col("length") <= F.size(words))
        & (F.lower(F.get(words, start)) == F.col("head"))
        & (F.lower(F.get(words, start + F.col("length") - 1)) == F.col("tail"))
        & (lowered == F.col("text_of"))
    )
    hit = F.struct(start.alias("start"), F.col("length"), F.col("ids"))
    matched = placed.join(F.broadcast(joined), F.lower("__qn_w") == F.col("prefix"), "left")
    matched = matched.withColumn("hit", F.when(found, hit)).filter((F.col("__qn_at") == 0) | F.col("hit").isNotNull())
    kept = F.when(F.col("__qn_at") == 0, F.struct(*keep) if keep else F.lit(True))
    return matched.select("__qn_row", kept.alias("kept"), "n_words", "hit")


def covered(spans: Column) -> Column:
    """Words inside any of the spans (start, length)."""
    def step(seen, x):
        end = x["start"] + x["length"]
        new = F.greatest(F.lit(0), end - F.greatest(seen["end"], x["start"]))
        return F.struct((seen["n"] + new).alias("n"), F.greatest(seen["end"], end).alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda seen: seen["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], size: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """keep with n_words, n_hit, n_items, items and contaminated (which replace columns of keep), a row for each document."""
    names = [c for c in keep if c.lower() not in OUTPUTS]
    keep = [f"__qn_keep{i}" for i in range(len(names))]  # whatever the columns are called
    docs = docs.select("text", *[F.col(c).alias(k) for c, k in zip(names, keep)])
    wins = cut(windows(items, size))
    joined = cut(prefixes(wins, rarities(docs, wins)))
    # a chunk is bounded in rows and, as windows may hold long words, in bytes
    rows, weight = joined.agg(F.count(F.lit(1)), F.sum(weighed(joined))).first()
    parts = max(1, -(-rows // chunk), -(-(weight or 0) // BROADCAST_BYTES))
    # A document may hold windows of several chunks; a chunk's rows are told apart by hash.
    dealt = joined.withColumn("__qn_part", F.pmod(F.xxhash64("text_of"), F.lit(parts)))
    docs = docs.select(F.monotonically_increasing_id().alias("__qn_row"), *keep, "text")
    if parts > 1:  # several passes must see the same numbers
        docs = cut(docs)
    rows = None
    for part in range(parts):
        some = hits(docs, dealt.filter(F.col("__qn_part") == part).drop("__qn_part"), keep)
        rows = some if rows is None else rows.unionByName(some)
    # Within a chunk a document's first word gives a row whether or not it is hit.
    kept = F.first("kept", ignorenulls=True).alias("kept")
    grouped = rows.groupBy("__qn_row").agg(kept, F.first("n_words").alias("n_words"), F.collect_list("hit").alias("__qn_hits"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("__qn_hits", lambda h: h["ids"]))))
    spans = F.transform("__qn_hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length")))
    out = grouped.select(*[F.col("kept")[k].alias(k) for k in keep], "n_words", covered(spans).alias("n_hit"), ids.alias("items"))
    bad = (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    named = [F.col(k).alias(c) for c, k in zip(names, keep)]
    return out.select(*named, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", bad.alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated. Only the others' digests are joined."""
    digest = F.md5(F.col("text"))
    found = contamination(docs.select("text", digest.alias("__qn_digest")), items, ["__qn_digest"])
    bad = cut(found.filter("contaminated").select(F.col("__qn_digest").alias("__qn_bad")).distinct())
    side = broadcast_if_small(bad, CHUNK)
    return docs.join(side, digest == F.col("__qn_bad"), "left_anti")


def op6_decontamination(spark, sf_dir):
    """Words, hits, items and verdict of every document; see the module for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP6_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT item_id, least(len(w), 13) AS size, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i, w
  FROM b WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS t FROM v),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
g AS (
  SELECT r, size, w, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size),
h AS (
  SELECT g.r, g.i, g.size, win.item_id
  FROM g JOIN win ON win.size = g.size AND win.t = array_to_string(list_slice(g.w, g.i, g.i + g.size - 1), ' ')),
p AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS pos FROM h) GROUP BY r),
q AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
