"""Every named query against its oracle on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from quillon import workloads

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES.split():
        if os.path.exists(f"{SF}/{t}.parquet"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(workloads.QUERIES))
def test_workload(spark, oracle, name):
    df = workloads.QUERIES[name](spark, SF)
    want = oracle.execute(workloads.ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_rows_of_several_sizes(spark, oracle):
    """A limit without an order gives that many rows, whichever they are."""
    from quillon.session import Engine

    engine = Engine(spark, SF)
    for n, m in ((0, 0), (3, 0), (3, 2), (100, 3)):
        got = engine.sql(f"SELECT r_name FROM region LIMIT {n} OFFSET {m}").count()
        assert got == max(0, min(n, 5 - m))
