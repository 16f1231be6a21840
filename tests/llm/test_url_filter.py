import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import url_filter as u


def judged(spark, urls, outcomes=(), **more):
    pages = spark.createDataFrame([(i, x, "own", "own") for i, x in enumerate(urls)], "page_id int, url string, host string, bound string")
    seen = spark.createDataFrame(list(outcomes), "host string, bad int")
    return {r.page_id: r for r in u.judge(pages, seen, **more).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        "HTTP://A.Example.COM/en/7x?q=/en/#f", "https://xcom/en/", "http://com/en/", "x://b.net/de/1",
        "x://www.example.net/de/81", "x://sub.org?x/es/", "x://o.org/es/", None, "no scheme/en/", "", "a://b#c", "x://é.COM/en/ü",
    ]
    out = judged(spark, urls)
    got = {k: (r.host, r.path, r.rule, r.verdict) for k, r in out.items()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("xcom", "/en/", None, "allow")
    assert got[2] == ("com", "/en/", "com/en/", "block")
    assert got[3] == ("b.net", "/de/1", "net/de/", "allow")
    assert got[4] == ("www.example.net", "/de/81", "example.net/de/8", "block")
    assert got[5] == ("sub.org", "", None, "allow")
    assert got[6] == ("o.org", "/es/", "org/es/", "block")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == ("b", "", None, "allow")
    assert got[11] == ("é.com", "/en/ü", "com/en/", "block")


def test_reputation_is_shrunk_and_falls_back(spark):
    outcomes = [("bad.a.zz", 1)] * 200 + [("good.a.zz", 0)] * 200 + [("one.b.zz", 1)] + [("x.c.yy", 0)] * 50 + [("bad.a.zz", None)]
    out = judged(spark, ["s://bad.a.zz/", "s://good.a.zz/", "s://one.b.zz/", "s://new.a.zz/", "s://u.yy/", "s://q/"], outcomes)
    assert [out[i].verdict for i in range(6)] == ["block", "allow", "allow", "allow", "allow", "allow"]
    assert judged(spark, [], outcomes) == {}
    assert judged(spark, ["s://bad.a.zz/"])[0].verdict == "allow"


def test_shuffled_reputations_agree(spark, monkeypatch):
    outcomes = [("bad.a.zz", 1)] * 50 + [("x.c.yy", 0)] * 50
    urls = ["s://bad.a.zz/", "s://x.c.yy/", "s://n.zz/"] * 3
    want = {k: r.bound for k, r in judged(spark, urls, outcomes).items()}
    monkeypatch.setattr(u, "BROADCAST_HOSTS", 0)
    assert {k: r.bound for k, r in judged(spark, urls, outcomes).items()} == want


def test_columns_named_like_outputs_are_replaced(spark):
    pages = spark.createDataFrame([(1, "s://a.b/c", "own", "own", "x")], "page_id int, url string, HOST string, bound string, more string")
    out = u.judge(pages, spark.createDataFrame([], "host string, bad int"))
    assert out.columns == ["page_id", "url", "more", *u.OUTPUTS] and out.first().host == "a.b"


@pytest.mark.parametrize(
    "host, domain, suffix",
    [
        ("www.a.co.uk", "a.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("a.b.com", "b.com", "com"), ("x.com.au", "x.com.au", "com.au"),
        ("a.b.de", "b.de", "de"), ("com", "com", "com"), ("uk", "uk", "uk"), ("1.2.3.4", "1.2.3.4", ""), ("1.2.3.4:80", "1.2.3.4", ""),
        ("[::1]:80", "[::1]", ""), ("me:pw@a.b.com:8080", "b.com", "com"), ("a.b.com.", "b.com", "com"), ("", "", ""), ("a.co.info", "co.info", "info"),
    ],
)
def test_domains_and_suffixes(spark, host, domain, suffix):
    row = spark.createDataFrame([(host,)], "h string").select(*u.split_host(F.col("h"))).first()
    assert tuple(row) == (domain, suffix)


def test_bound_holds_for_any_posterior(spark):
    """At most RISK of a beta posterior lies below its bound, by its own quantiles."""
    import numpy as np

    rng = np.random.default_rng(5)
    shapes = [(a, b) for a in (0.3, 1, 2.5, 9, 60, 700) for b in (0.2, 1, 4, 30, 500)]
    frame = spark.createDataFrame([(a / (a + b), float(a + b)) for a, b in shapes], "mean double, strength double")
    bounds = [r[0] for r in frame.select(u.lower_bound(F.col("mean"), F.col("strength"))).collect()]
    for (a, b), bound in zip(shapes, bounds):
        assert bound <= np.quantile(rng.beta(a, b, 200_000), u.RISK) + 1e-3, (a, b)


def test_query_blocks_by_reputation_as_its_sql_does(spark, tmp_path):
    """Hosts good and bad, of several domains, beside what no rule and no outcome touches."""
    rng = random.Random(8)
    hosts = [f"{w}{i}.{d}" for w in "ab" for i in range(4) for d in ("bad.co.uk", "fine.co.uk", "mixed.xyz", "x.example.com", "net")] + ["1.2.3.4", "9.9.9.9:81"]
    rate = lambda h: 0.95 if "bad" in h or h.startswith(("1.2", "a1.mixed")) else 0.05
    pages, labels = [], []
    for i in range(3000):
        h = rng.choice(hosts)
        pages.append((i, f"http://{h}/{rng.choice(['en', 'de', 'es'])}/{i}", ""))
        if rng.random() < 0.7:
            labels.append((i, 0 if rng.random() < rate(h) else 1, None if i % 50 == 0 else 0))
    pages += [(3000 + k, f"http://new.{d}/q", "") for k, d in enumerate(("bad.co.uk", "other.co.uk", "mixed.xyz"))] + [(3003, None, ""), (3003, None, "")]
    for name, rows, schema in (("pages", pages, "page_id bigint, url string, html string"), ("labels", labels, "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [tuple(r) for r in u.op8_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.sql(u.OP8_SQL).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    by_method = [(h, v) for _, h, _, rule, v in got if rule is None]
    assert {h for h, v in by_method if v == "block"} >= {"a0.bad.co.uk", "new.bad.co.uk", "a1.mixed.xyz", "1.2.3.4"}
    assert all(v == "allow" for h, v in by_method if "fine" in h or h in ("9.9.9.9:81", "new.other.co.uk", "new.mixed.xyz", ""))
