"""URL verdicts: listed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1: bad) are counted per host and rolled up to registered domain,
suffix and everything. Each level's rate is shrunk towards the level above it by a
beta-binomial prior whose mean is the parent's shrunk rate and whose strength is fitted to
the spread of the children by the method of moments. A page is blocked when the lower bound
of its host's posterior exceeds the threshold; a host without outcomes has its domain's
posterior, and so on upwards.

The bound holds for every beta posterior, whatever its shape: a beta distribution of strength s
is sub-Gaussian with variance proxy 1 / (4 (s + 1)), and Cantelli's inequality uses its own
variance; the better of the two lower bounds is taken, each exceeded with probability RISK at most.

The suffix is a host's last label, or its last two if the last is a country's (two letters) and
the one before it is among SECOND; the registered domain has one label more. Ports, user parts
and a final dot don't count; a host of a suffix alone is its own domain, and so is an IP
address, whose suffix is empty. Null urls and urls without "://" have an empty host and path and
are judged by the overall prior. Urls of any length are read whole. Ties: of rules that fit, the
longest wins, and of equally long ones the greater text. Empty tables give empty results; without outcomes everything
that no rule blocks is allowed. Repeated rows are judged alike, each on its own row. Extra
columns are kept, but those named like an output are replaced. Rules are a short policy list
held in the plan; outcomes of any number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, broadcast_if_small, cut, table

#: (verdict, host and path); a rule fits its host and all subdomains.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Block where the lower bound of the posterior rate of bad pages exceeds this.
THRESHOLD = 0.5
#: The probability that the posterior rate lies below its lower bound, at most.
RISK = 0.05
#: Labels under which countries register names, by convention.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "govt", "mil", "ne", "net", "nom", "or", "org", "sch")
#: Least and most strength of a prior, in pages.
STRENGTH = (1.0, 1000.0)
#: Reputations are broadcast up to so many hosts (some 60 bytes each).
BROADCAST_HOSTS = 100_000
LEVELS = ("host", "domain", "suffix")
OUTPUTS = ("host", "path", "rule", "verdict", "bound")


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, after).otherwise(F.lit(""))


def split_host(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.$", "")
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")
    last = F.substring_index(name, ".", -1)
    two = (F.length(last) == 2) & F.substring_index(F.substring_index(name, ".", -2), ".", 1).isin(*SECOND) & name.contains(".")
    labels = lambda n: F.when(two, F.substring_index(name, ".", -n - 1)).otherwise(F.substring_index(name, ".", -n))
    return F.when(address, name).otherwise(labels(2)), F.when(address, "").otherwise(labels(1))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), or null."""
    found = []
    for verdict, rule in rules:
        at, _, tail = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        one = F.struct(
            F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")
        )
        found.append(F.when(fits, one))
    return F.array_max(F.array(*found)) if found else F.lit(None)


def _shrunk(child: DataFrame, parent, key: str, up: str) -> DataFrame:
    """child (key, up, bad, n) with posterior mean and strength.

    parent: a table with up and mean, or the one mean that all children share.
    """
    if isinstance(parent, float):
        joined = child.withColumn("__qn_prior", F.lit(parent))
    else:
        joined = child.join(parent.select(F.col(up), F.col("mean").alias("__qn_prior")), up)
    # Moments: the excess of the squared deviations over the binomial's gives the spread
    # rho = 1 / (strength + 1) of the children's own rates about their parents'.
    noise = F.col("n") * F.col("__qn_prior") * (1 - F.col("__qn_prior"))
    off = (F.col("bad") - F.col("n") * F.col("__qn_prior")) ** 2
    over, most = joined.agg(
        F.sum(off - noise), F.sum(noise * (F.col("n") - 1))
    ).first()
    rho = over / most if most else 0.0
    low, high = STRENGTH
    strength = F.lit(max(low, min(high, 1 / rho - 1 if rho > 0 else high)))
    mean = (F.col("bad") + strength * F.col("__qn_prior")) / (F.col("n") + strength)
    return joined.select(*dict.fromkeys((key, up)), mean.alias("mean"), (F.col("n") + strength).alias("strength"))


def reputations(outcomes: DataFrame) -> dict:
    """Posterior mean and strength per host, domain and suffix as tables, over all as a pair.

    outcomes: columns host and bad (0 or 1), one row per labelled page.
    """
    domain, suffix = split_host(F.col("host"))
    hosts = cut(
        outcomes.filter(F.col("bad").isNotNull())
        .groupBy("host")
        .agg(F.sum("bad").cast("double").alias("bad"), F.count("bad").cast("double").alias("n"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "bad", "n")
    )
    sums = (F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    # Without outcomes the rate is 0 and nothing is blocked.
    mean, strength = (bad or 0.0) / max(n or 0.0, 1.0), n or 0.0
    by_suffix = cut(_shrunk(suffixes, mean, "suffix", "suffix"))
    by_domain = cut(_shrunk(domains, by_suffix, "domain", "suffix"))
    by_host = cut(_shrunk(hosts, by_domain, "host", "domain"))
    return {"host": by_host, "domain": by_domain, "suffix": by_suffix, "all": (mean, strength)}


def lower_bound(mean: Column, strength: Column) -> Column:
    """What a beta posterior's rate exceeds with a probability of 1 - RISK at least."""
    shape_free = F.sqrt(F.lit(math.log(1 / RISK) / 2) / (strength + 1))
    by_variance = F.sqrt(F.lit(1 / RISK - 1) * mean * (1 - mean) / (strength + 1))
    return mean - F.least(shape_free, by_variance)


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold=THRESHOLD) -> DataFrame:
    """pages (column url) with host, path, rule, verdict and the bound it rests on."""
    known = reputations(outcomes)
    pages = pages.select(*[c for c in pages.columns if c.lower() not in OUTPUTS])
    domain, suffix = split_host(F.col("host"))
    judged = (
        pages.withColumn("host", url_host(F.col("url")))
        .withColumn("path", url_path(F.col("url")))
        .withColumn("host", F.coalesce("host", F.lit("")))
        .withColumn("path", F.coalesce("path", F.lit("")))
        .withColumn("__qn_domain", domain)
        .withColumn("__qn_suffix", suffix)
    )
    for level in LEVELS:
        side = known[level].select(
            F.col(level).alias(f"__qn_{level}_key"),
            F.struct("mean", "strength").alias(f"__qn_{level}_seen"),
        )
        key = F.col("host" if level == "host" else f"__qn_{level}")
        judged = judged.join(
            broadcast_if_small(side, BROADCAST_HOSTS), key == F.col(f"__qn_{level}_key"), "left"
        )
    overall = F.struct(*[F.lit(x).alias(n) for x, n in zip(known["all"], ("mean", "strength"))])
    seen = F.coalesce("__qn_host_seen", "__qn_domain_seen", "__qn_suffix_seen", overall)
    bound = lower_bound(seen["mean"], seen["strength"])
    rule = best_rule(F.col("host"), F.col("path"), rules)
    return judged.select(
        *[F.col(c) for c in pages.columns],
        "host",
        "path",
        rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(bound > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        bound.alias("bound"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and bad of every labelled page.

    A page shows the document whose number is the last one in its path, and is bad if that
    document is labelled toxic or of low quality. A document labelled more than once is bad
    if any of its labels says so.
    """
    number = F.regexp_extract(url_path(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1)
    numbered = pages.select(
        url_host(F.col("url")).alias("host"),
        F.when(number != "", number).cast("long").alias("doc_id"),
    ).filter(F.col("doc_id").isNotNull())
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    marked = labels.select("doc_id", F.coalesce(bad, F.lit(0)).alias("bad"))
    return numbered.join(marked.groupBy("doc_id").agg(F.max("bad").alias("bad")), "doc_id").select("host", "bad")


def op8_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page; see the module for odd rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "labels"))
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(strpos(url, '://') > 0, false) AS ok FROM pages),
h AS (
  SELECT page_id,
    CASE WHEN ok THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN ok THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p),
u AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.$', '') AS name,
    regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS num FROM h),
i AS (
  SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') OR starts_with(name, '[') AS address FROM u),
t AS (
  SELECT *, CASE WHEN length(parts[-1]) = 2 AND coalesce(parts[-2], '') IN
    ('ac', 'co', 'com', 'edu', 'gob', 'gov', 'govt', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'sch') THEN 2 ELSE 1 END AS size FROM i),
k AS (
  SELECT *, CASE WHEN address THEN '' ELSE array_to_string(list_slice(parts, -size, -1), '.') END AS suffix,
    CASE WHEN address THEN name ELSE array_to_string(list_slice(parts, -size - 1, -1), '.') END AS domain FROM t),
l AS (
  SELECT doc_id, max(coalesce((toxic = 1 OR quality = 0)::INT, 0)) AS bad FROM labels GROUP BY doc_id),
o AS (
  SELECT host, domain, suffix, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS n
  FROM k JOIN l ON CASE WHEN num <> '' THEN num::BIGINT END = l.doc_id GROUP BY ALL),
od AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM o GROUP BY ALL),
os AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM o GROUP BY ALL),
oa AS (SELECT coalesce(sum(bad), 0.0) / greatest(coalesce(sum(n), 0.0), 1.0) AS mean, coalesce(sum(n), 0.0) AS strength FROM o),
js AS (SELECT os.*, oa.mean AS prior FROM os, oa),
ms AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) AS ov, sum(n * prior * (1 - prior) * (n - 1)) AS mo FROM js),
ss AS (SELECT greatest(1.0, least(1000.0, CASE WHEN mo > 0 AND ov / mo > 0 THEN 1 / (ov / mo) - 1 ELSE 1000.0 END)) AS st FROM ms),
bs AS (SELECT suffix, (bad + st * prior) / (n + st) AS mean, n + st AS strength FROM js, ss),
jd AS (SELECT od.*, bs.mean AS prior FROM od JOIN bs USING (suffix)),
md AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) AS ov, sum(n * prior * (1 - prior) * (n - 1)) AS mo FROM jd),
sd AS (SELECT greatest(1.0, least(1000.0, CASE WHEN mo > 0 AND ov / mo > 0 THEN 1 / (ov / mo) - 1 ELSE 1000.0 END)) AS st FROM md),
bd AS (SELECT domain, (bad + st * prior) / (n + st) AS mean, n + st AS strength FROM jd, sd),
jh AS (SELECT o.*, bd.mean AS prior FROM o JOIN bd USING (domain)),
mh AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) AS ov, sum(n * prior * (1 - prior) * (n - 1)) AS mo FROM jh),
sh AS (SELECT greatest(1.0, least(1000.0, CASE WHEN mo > 0 AND ov / mo > 0 THEN 1 / (ov / mo) - 1 ELSE 1000.0 END)) AS st FROM mh),
bh AS (SELECT host, (bad + st * prior) / (n + st) AS mean, n + st AS strength FROM jh, sh),
j AS (
  SELECT k.*, coalesce(bh.mean, bd.mean, bs.mean, oa.mean) AS mean,
    coalesce(bh.strength, bd.strength, bs.strength, oa.strength) AS strength
  FROM k LEFT JOIN bh USING (host) LEFT JOIN bd USING (domain) LEFT JOIN bs USING (suffix), oa),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM j)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN mean - least(sqrt(ln(20) / 2 / (strength + 1)), sqrt(19 * mean * (1 - mean) / (strength + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
