import datetime

import pytest
from pyspark.sql import types as T

from quillon import render
from quillon.errors import ConstraintProblem, EngineProblem, NameProblem, TypeProblem
from quillon.session import Engine

SF = "/root/testdata/sf0.001"
# The sets that set operations are tried on, and the truth tables below.
LEFT = "(VALUES (1), (2), (2), (3), (3), (3), (4), (4), (4), (4)) a(n)"
RIGHT = "(VALUES (1), (3), (3), (5)) b(n)"


@pytest.fixture
def engine(spark):
    return Engine(spark, SF)


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(engine, expression):
    return engine.sql(f"SELECT {expression} AS x FROM region LIMIT 1").first()[0]


@pytest.mark.parametrize(
    "op, want",
    [
        ("UNION", [1, 2, 3, 4, 5]), ("UNION ALL", [1, 1, 2, 2, 3, 3, 3, 3, 3, 4, 4, 4, 4, 5]), ("INTERSECT", [1, 3]),
        ("INTERSECT ALL", [1, 3, 3]), ("EXCEPT", [2, 4]), ("EXCEPT ALL", [2, 2, 3, 4, 4, 4, 4]),
    ],
)
def test_set_operations(engine, op, want):
    df = engine.sql(f"SELECT n FROM {LEFT} {op} SELECT n FROM {RIGHT} ORDER BY n")
    assert [r[0] for r in df.collect()] == want


def test_order_places_nulls_last_and_first(engine):
    values = "(VALUES (1, 3), (2, NULL), (3, 1)) v(id, x)"
    assert rows(engine.sql(f"SELECT id FROM {values} ORDER BY x")) == [(3,), (1,), (2,)]
    assert rows(engine.sql(f"SELECT id FROM {values} ORDER BY x DESC")) == [(2,), (1,), (3,)]
    assert rows(engine.sql(f"SELECT id FROM {values} ORDER BY x NULLS FIRST OFFSET 1")) == [(3,), (1,)]


@pytest.mark.parametrize(
    "a, b, both, any_",
    [
        ("TRUE", "TRUE", True, True), ("TRUE", "FALSE", False, True), ("TRUE", "NULL", None, True),
        ("FALSE", "FALSE", False, False), ("FALSE", "NULL", False, None), ("NULL", "NULL", None, None),
    ],
)
def test_three_valued_logic(engine, a, b, both, any_):
    for x, y in ((a, b), (b, a)):
        assert one(engine, f"{x} AND {y}") is both and one(engine, f"{x} OR {y}") is any_
    assert one(engine, f"NOT {a}") is {"TRUE": False, "FALSE": True, "NULL": None}[a]


def test_types_and_arithmetic(engine):
    schema = engine.sql("SELECT 1 + 1 AS a, 1 + 1.5 AS b, 7 / 2 AS c, -7 / 2 AS d, 3000000000 AS e, count(*) AS f FROM region GROUP BY 1").schema
    assert [f.dataType for f in schema] == [T.IntegerType(), T.DoubleType(), T.IntegerType(), T.IntegerType(), T.LongType(), T.LongType()]
    assert (one(engine, "7 / 2"), one(engine, "-7 / 2"), one(engine, "7 / 2.0")) == (3, -3, 3.5)
    engine.sql("CREATE TABLE n (s smallint, i integer, b bigint, r real, d double precision, x numeric)")
    engine.sql("INSERT INTO n VALUES (1, 2, 3, 2.99, 2.99, 1.5)")
    kinds = engine.sql("SELECT s + s AS a, s + i AS b, i * b AS c, s * r AS d, r - d AS e, x + d AS f FROM n").schema
    want = [T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DecimalType(38, 18)]
    assert [f.dataType for f in kinds] == want
    # widened, the nearest real is above the double
    assert rows(engine.sql("SELECT r > 2.99 AS x FROM n")) == [(True,)]
    for text in ("1 / 0", "1.5 / 0"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            one(engine, text)


@pytest.mark.parametrize(
    "text, problem",
    [
        ("SELECT x FROM region", NameProblem), ("SELECT r.r_name FROM region", NameProblem), ("SELECT a FROM nowhere", NameProblem),
        ("SELECT n_name FROM nation a, nation b", NameProblem), ("SELECT 1 AS x FROM nation, nation", NameProblem),
        ("SELECT r_name + 1 AS x FROM region", TypeProblem), ("SELECT r_name || 1 AS x FROM region", TypeProblem),
        ("SELECT r_name AS x FROM region WHERE r_name", TypeProblem), ("SELECT r_name = 1 AS x FROM region", TypeProblem),
        ("SELECT r_name FROM region WHERE count(*) > 1", TypeProblem), ("SELECT r_name, count(*) FROM region", TypeProblem),
        ("SELECT r_name FROM region GROUP BY r_regionkey", TypeProblem), ("SELECT length(1) AS x FROM region", TypeProblem),
        ("SELECT nothing(1) AS x FROM region", NameProblem), ("SELECT r_name FROM region UNION SELECT r_regionkey FROM region", TypeProblem),
        ("SELECT r_name FROM region UNION SELECT r_name, r_name FROM region", TypeProblem), ("SELECT a FROM (VALUES (1), (1, 2)) v", TypeProblem),
        ("SELECT 1 AS x FROM (SELECT r_name FROM region) t(a, b)", NameProblem), ("SELECT count(*) AS n FROM region GROUP BY count(*)", TypeProblem),
        ("SELECT nextval('none') AS x FROM region", NameProblem), ("SELECT x.* FROM region", NameProblem),
    ],
)
def test_problems(engine, text, problem):
    with pytest.raises(problem):
        engine.sql(text)


def test_names_and_aliases(engine):
    assert engine.sql("SELECT r_name, r_regionkey + 1, length(r_name), r_name AS z FROM region").columns == ["r_name", "?column?", "length", "z"]
    assert engine.sql("SELECT * FROM (VALUES (1, 'a')) v").columns == ["column1", "column2"]
    assert engine.sql("SELECT r_name, r_name FROM region").columns == ["r_name", "r_name"]
    assert engine.sql("SELECT R_NAME FROM Region R WHERE r.R_regionKey = 0").count() == 1


def test_residual_join_conditions_hold(engine):
    assert rows(engine.sql("SELECT v.k FROM region r JOIN (VALUES (0), (1)) v(k) ON v.k = r.r_regionkey AND v.k > 0")) == [(1,)]
    assert rows(engine.sql("SELECT r.r_name FROM region r, nation n WHERE FALSE")) == []


def test_plans_push_down_and_prune(engine):
    plan = engine.explained("SELECT o_orderkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100.5 AND c.c_nationkey = 3")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100.5)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan and "BroadcastNestedLoop" not in plan
    plan = engine.explained("SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 3 OFFSET 2")
    assert "TakeOrderedAndProject" in plan
    plan = engine.explained("SELECT * FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) s WHERE k = 3")
    assert "EqualTo(o_custkey,3)" in plan
    assert rows(engine.sql("EXPLAIN DELETE FROM region WHERE r_regionkey = 1"))[0][0].startswith("== Physical Plan")
    assert engine.sql("SELECT count(*) AS n FROM region").first()[0] == 5


def test_changes(engine):
    engine.script("""CREATE TABLE t (id serial PRIMARY KEY, name text NOT NULL, size bigint DEFAULT 7, made timestamp with time zone);
        INSERT INTO t (name) VALUES ('a'), ('b'); INSERT INTO t (name, size, made) VALUES ('c', NULL, '2024-01-02 03:04:05+00');""")
    assert rows(engine.sql("SELECT id, name, size FROM t ORDER BY id")) == [(1, "a", 7), (2, "b", 7), (3, "c", None)]
    assert rows(engine.sql("SELECT made FROM t WHERE id = 3")) == [(datetime.datetime(2024, 1, 2, 3, 4, 5),)]
    got = rows(engine.sql("UPDATE t x SET size = size + id, name = name || '!' WHERE x.size = 7 RETURNING x.id, size, name || '?' AS n"))
    assert sorted(got) == [(1, 8, "a!?"), (2, 9, "b!?")]
    # several matches of a row change it once
    engine.sql("UPDATE t SET size = v.n FROM (VALUES (1, 50), (1, 40), (9, 1)) v(k, n) WHERE v.k = t.id")
    assert rows(engine.sql("SELECT id, size FROM t ORDER BY id")) == [(1, 40), (2, 9), (3, None)]
    assert rows(engine.sql("DELETE FROM t USING (VALUES (2), (2)) v(k) WHERE v.k = id RETURNING *"))[0][:3] == (2, "b!", 9)
    assert rows(engine.sql("DELETE FROM t WHERE id = 77 RETURNING id")) == []
    engine.sql("DELETE FROM t")
    assert engine.sql("SELECT * FROM t").count() == 0
    assert rows(engine.sql("INSERT INTO t (name) VALUES ('d') RETURNING id")) == [(4,)]


def test_refused_changes_leave_the_table(engine):
    engine.script("""CREATE TABLE p (id integer PRIMARY KEY, tag text); CREATE UNIQUE INDEX u ON p (length(tag)) WHERE id > 0;
        INSERT INTO p VALUES (1, 'x'), (2, NULL), (-3, 'y');
        CREATE TABLE c (id integer, p integer REFERENCES p (id), CHECKED integer CHECK (CHECKED > 1));
        INSERT INTO c VALUES (1, 1, 2), (2, NULL, NULL)""")
    for text in (
        "INSERT INTO p VALUES (1, 'long')", "INSERT INTO p VALUES (5, 'a'), (5, 'bb')", "INSERT INTO p VALUES (NULL, 'abc')",
        "INSERT INTO p VALUES (9, 'z')", "UPDATE p SET id = 1", "INSERT INTO c VALUES (3, 8, 2)", "UPDATE c SET checked = 0 WHERE id = 1",
        "UPDATE c SET p = 77 WHERE id = 2", "ALTER TABLE c ADD CONSTRAINT k CHECK (id > 1)", "ALTER TABLE c ADD CONSTRAINT k PRIMARY KEY (id)",
        "CREATE UNIQUE INDEX w ON c (1 + 0 * id)", "CREATE INDEX h ON p USING hash (id, tag)", "CREATE UNIQUE INDEX h2 ON p USING hash (id)",
        "ALTER TABLE c ADD CONSTRAINT f FOREIGN KEY (id) REFERENCES p (tag)",
    ):
        with pytest.raises(ConstraintProblem):
            engine.sql(text)
    assert engine.sql("SELECT * FROM p").count() == 3 and engine.sql("SELECT * FROM c").count() == 2
    for text in ("INSERT INTO p VALUES (TRUE, 'a')", "INSERT INTO p VALUES (4)  ", "INSERT INTO p (id) VALUES (4, 5)", "UPDATE p SET id = 'x'"):
        if text.endswith("(4)  "):
            engine.sql(text)  # missing columns take their defaults
            continue
        with pytest.raises(EngineProblem):
            engine.sql(text)
    engine.sql("ALTER TABLE c ADD CONSTRAINT ok FOREIGN KEY (p) REFERENCES p (id)")
    with pytest.raises(EngineProblem):
        engine.sql("CREATE TABLE z (a integer REFERENCES nowhere (x))")
    with pytest.raises(NameProblem):
        engine.sql("SELECT * FROM z")


def test_sequences(engine):
    engine.sql("CREATE SEQUENCE s AS integer")
    with pytest.raises(EngineProblem):
        engine.sql("SELECT currval('s') AS x FROM region")
    assert sorted(rows(engine.sql("SELECT nextval('s') AS x FROM region"))) == [(i,) for i in range(1, 6)]
    assert one(engine, "currval('s')") == 5 and one(engine, "setval('s', 40)") == 40
    assert sorted(rows(engine.sql("SELECT nextval('s') * 10 AS x FROM region WHERE r_regionkey < 2"))) == [(410,), (420,)]
    engine.sql("SELECT setval('s', 2147483647) AS x FROM region")
    with pytest.raises(EngineProblem):
        engine.sql("SELECT nextval('s') AS x FROM region")


def test_only_files_with_matches_are_rewritten(engine, spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    spark.range(40).selectExpr("id", "id % 4 AS part").repartitionByRange(4, "id").write.parquet(path)
    engine.catalog.load(spark, "wide", path)
    before = set(engine.catalog.table("wide").listed(spark))
    assert len(before) == 4
    engine.sql("UPDATE wide SET part = 9 WHERE id = 3")
    table = engine.catalog.table("wide")
    assert len(before & set(table.files)) == 3
    assert engine.sql("SELECT count(*) AS n FROM wide").first()[0] == 40
    assert rows(engine.sql("SELECT id FROM wide WHERE part = 9")) == [(3,)]


def test_own_functions(engine):
    from pyspark.sql import functions as F

    from quillon import types

    engine.functions.register("twice", [types.TEXT], types.TEXT, lambda x: F.concat(x, x))
    engine.aggregates.register("spread", [types.DOUBLE], types.DOUBLE, lambda x: F.max(x) - F.min(x))
    assert one(engine, "TWICE('ab')") == "abab"
    assert engine.sql("SELECT spread(r_regionkey) AS s FROM region").first()[0] == 4


def test_streams(engine, spark, tmp_path):
    from quillon.streaming.queries import start

    path = str(tmp_path / "events")
    spark.range(100).selectExpr("id", "id % 3 AS k").write.parquet(path)
    engine.register("feed", spark.readStream.schema("id bigint, k bigint").parquet(path))
    query = start(engine, "SELECT k, count(*) AS n FROM feed WHERE id > 9 GROUP BY k", "counted", "complete")
    query.processAllAvailable()
    query.stop()
    assert sorted(rows(spark.table("counted"))) == [(0, 30), (1, 30), (2, 30)]
    with pytest.raises(EngineProblem):
        engine.sql("DELETE FROM feed")


def test_frames_can_be_changed(engine, spark):
    engine.register("mine", spark.createDataFrame([(1, "a"), (2, None)], "id int, t string"))
    engine.sql("UPDATE mine SET t = 'b' WHERE t IS NULL")
    assert sorted(rows(engine.sql("SELECT * FROM mine"))) == [(1, "a"), (2, "b")]


def test_rendering(engine):
    df = engine.sql("SELECT id, name, ok FROM (VALUES (1, 'x', TRUE), (20, NULL, FALSE)) v(id, name, ok) ORDER BY id")
    assert render.table(df) == " id |  name  | ok\n----+--------+----\n  1 | x      | t \n 20 | [NULL] | f \n(2 rows)\n"
    assert render.expanded(df).splitlines() == [
        "-[ RECORD 1 ]", "id   | 1", "name | x", "ok   | t", "-[ RECORD 2 ]", "id   | 20", "name | [NULL]", "ok   | f",
    ]
    assert render.table(engine.sql("SELECT r_name FROM region LIMIT 0")).endswith("(0 rows)\n")


def test_rendering_is_bounded(engine):
    df = engine.sql("SELECT n_nationkey FROM nation ORDER BY n_nationkey")
    assert [x.strip() for x in render.table(df, most=3).splitlines()[2:]] == ["0", "1", "2", "(the first 3 rows)"]
    assert render.expanded(df, most=2).splitlines()[-1] == "(the first 2 rows)" and render.table(df, most=25).endswith("(25 rows)\n")


def test_plans_of_changes_in_the_shell(engine):
    import io

    from quillon.repl import Shell

    out = io.StringIO()
    shell = Shell(engine, out)
    for line in ("create table q (a integer);", "debug", "insert into q select r_regionkey from region;", "update q set a = 7 where a > 2;", "delete from q where a = 7;"):
        shell.feed(line)
    assert out.getvalue().count("Physical Plan") == 3 and engine.sql("SELECT count(*) AS n FROM q").first()[0] == 3


def test_shell(engine, tmp_path):
    import io

    from quillon.repl import Shell

    out = io.StringIO()
    shell = Shell(engine, out)
    (tmp_path / "a.sql").write_text("create table q (a integer); insert into q values (5);")
    for line in ("select r_name", "from region order by r_name limit 1; select", "nonsense from region;", "\\x", "debug", f"load {tmp_path}/a.sql", "select a from q;", f"load {SF}"):
        assert shell.feed(line)
    assert not shell.feed("exit")
    said = out.getvalue()
    assert " AFRICA" in said and "error: unknown column nonsense" in said and "a | 5" in said and "Time:" in said and "Physical Plan" in said


def test_sample(engine):
    from quillon.sources import sample

    sample.load(engine, "schema")
    sample.load(engine, "data")
    got = rows(engine.sql("""SELECT a.area, count(*) AS n FROM clients c JOIN countries d ON d.country_id = c.country_id
        JOIN areas a ON a.area_id = d.area_id GROUP BY a.area ORDER BY n DESC, a.area LIMIT 2"""))
    assert len(got) == 2 and got[0][1] >= got[1][1]
    with pytest.raises(ConstraintProblem):
        engine.sql("INSERT INTO goods VALUES (1000000, 'x', 0, 1.0)")
    assert engine.sql("INSERT INTO notes (client_id, note) VALUES (NULL, 'hello') RETURNING note_id").first()[0] == 1


NUMBERS = ("smallint", "integer", "bigint", "real", "double precision", "numeric")


def test_numbers_fit_every_numeric_column(engine):
    columns = ", ".join(f"c{i} {n}" for i, n in enumerate(NUMBERS))
    engine.sql(f"CREATE TABLE n ({columns})")
    engine.sql("INSERT INTO n VALUES (1.75, 2.75, 3.75, 4.75, 5, 6.5)")
    engine.sql("INSERT INTO n SELECT c5, c4, c3, c2, c1, c0 FROM n")
    got = sorted(tuple(map(float, r)) for r in rows(engine.sql("SELECT * FROM n")))
    # fractions are cut off towards zero
    assert got == [(1, 2, 3, 4.75, 5, 6.5), (6, 5, 4, 3, 2, 1)]
    for i, big in ((0, "32768"), (1, "2147483648"), (2, "1e19"), (0, "-40000")):
        with pytest.raises(Exception, match="OVERFLOW|out of range|NUMERIC_VALUE"):
            engine.sql(f"INSERT INTO n (c{i}) VALUES ({big})")
    assert engine.sql("SELECT count(*) AS n FROM n").first()[0] == 2


@pytest.mark.parametrize("low", range(len(NUMBERS)))
def test_promotion_is_symmetric(engine, low):
    from quillon import types

    for high in range(low, len(NUMBERS)):
        a, b = types.spark_type(NUMBERS[low]), types.spark_type(NUMBERS[high])
        assert types.promoted(a, b) == types.promoted(b, a) == b
    with pytest.raises(TypeProblem):
        types.promoted(types.TEXT, types.INTEGER)


def test_timestamps_are_read_from_text(engine):
    engine.sql("CREATE TABLE m (at timestamp with time zone)")
    engine.sql("INSERT INTO m VALUES ('2020-02-29'), ('2020-02-29 12:30:00+02'), (NULL)")
    got = [r[0] for r in rows(engine.sql("SELECT at FROM m ORDER BY at"))]
    assert got == [datetime.datetime(2020, 2, 29), datetime.datetime(2020, 2, 29, 10, 30), None]
    assert rows(engine.sql("SELECT count(*) AS n FROM m WHERE at > '2020-02-29 01:00:00+00'")) == [(1,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        engine.sql("INSERT INTO m VALUES ('soon')")


def test_every_join_kind_and_plan(engine):
    a, b = "(VALUES (1), (2), (NULL)) a(n)", "(VALUES (2), (3), (NULL)) b(n)"
    got = {k: sorted(rows(engine.sql(f"SELECT a.n AS x, b.n AS y FROM {a} {k} JOIN {b} ON a.n = b.n")), key=str) for k in ("", "LEFT", "RIGHT", "FULL OUTER")}
    assert got[""] == [(2, 2)] and got["LEFT"] == [(1, None), (2, 2), (None, None)]
    assert got["RIGHT"] == [(2, 2), (None, 3), (None, None)] and len(got["FULL OUTER"]) == 5
    assert engine.sql(f"SELECT a.n AS x, b.n AS y FROM {a} CROSS JOIN {b}").count() == 9
    plan = engine.explained("SELECT o.o_orderkey FROM orders o, lineitem l WHERE l.l_orderkey = o.o_orderkey")
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ambiguity_and_scopes(engine):
    with pytest.raises(NameProblem, match="ambiguous"):
        engine.sql("SELECT n FROM (VALUES (1)) a(n), (VALUES (2)) b(n)")
    assert rows(engine.sql("SELECT a.n AS x, b.n AS y FROM (VALUES (1)) a(n), (VALUES (2)) b(n)")) == [(1, 2)]
    # an alias of the select list comes before an input column in GROUP BY and ORDER BY
    assert sorted(rows(engine.sql("SELECT n / 2 AS n, count(*) AS c FROM (VALUES (1), (2), (3)) v(n) GROUP BY n"))) == [(0, 1), (1, 2)]
    assert rows(engine.sql("SELECT -n AS n FROM (VALUES (1), (3), (2)) v(n) ORDER BY n LIMIT 1")) == [(-3,)]
    assert rows(engine.sql("SELECT x FROM (SELECT n + 1 AS x FROM (VALUES (1)) v(n)) s WHERE s.x > 1")) == [(2,)]


def test_sequences_in_updates(engine):
    engine.script("CREATE SEQUENCE s; CREATE TABLE q (a integer, b bigint); INSERT INTO q VALUES (1, 0), (2, 0), (3, 0)")
    engine.sql("UPDATE q SET b = nextval('s') * 10 WHERE a > 1")
    assert sorted(rows(engine.sql("SELECT b FROM q"))) == [(0,), (10,), (20,)]
    with pytest.raises(TypeProblem):
        engine.sql("SELECT a FROM q WHERE nextval('s') > 1")
    engine.sql("UPDATE q SET b = NULL")
    assert rows(engine.sql("SELECT count(b) AS n, count(*) AS m FROM q")) == [(0, 3)]


def test_changes_in_a_folder_of_any_name(spark, tmp_path, monkeypatch):
    from quillon import storage

    folder = str(tmp_path / "a b%c+d é")
    monkeypatch.setattr(storage, "shared_folder", lambda spark: folder)
    with Engine(spark, SF) as engine:
        engine.script("CREATE TABLE t (a integer PRIMARY KEY, b text); INSERT INTO t VALUES (1, 'x'), (2, 'y'); INSERT INTO t VALUES (3, 'z')")
        engine.sql("UPDATE t SET b = b || '!' WHERE a > 1")
        engine.sql("UPDATE t SET b = v.n FROM (VALUES (1, 'new')) v(k, n) WHERE v.k = t.a")
        assert rows(engine.sql("DELETE FROM t WHERE a = 2 RETURNING b")) == [("y!",)]
        assert sorted(rows(engine.sql("SELECT a, b FROM t"))) == [(1, "new"), (3, "z!")]
        # a table that lies in such a folder can be changed, too
        spark.range(4).write.parquet(f"{folder}/own.parquet")
        engine.catalog.load(spark, "own", f"{folder}/own.parquet")
        engine.sql("DELETE FROM own WHERE id = 2")
        assert sorted(rows(engine.sql("SELECT id FROM own"))) == [(0,), (1,), (3,)]


def test_nothing_stays_of_failed_changes_and_closed_engines(spark, tmp_path, monkeypatch):
    import os

    from quillon import storage

    folder = tmp_path / "shared"
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(folder))
    with Engine(spark, SF) as engine:
        engine.script("CREATE TABLE t (a integer PRIMARY KEY, b integer CHECK (b > 0)); INSERT INTO t VALUES (1, 1), (2, 2)")
        before = sorted(os.listdir(folder))
        for text in ("INSERT INTO t VALUES (1, 3)", "UPDATE t SET b = 0", "UPDATE t SET a = 1 FROM (VALUES (2)) v(k) WHERE v.k = t.a", "INSERT INTO t VALUES (7, 0)"):
            with pytest.raises(ConstraintProblem):
                engine.sql(text)
            assert sorted(os.listdir(folder)) == before
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            engine.sql("UPDATE t SET b = 1 / (b - b)")
        assert sorted(os.listdir(folder)) == before and engine.sql("SELECT sum(b) AS n FROM t").first()[0] == 3
    assert os.listdir(folder) == []


def test_only_constraints_on_changed_columns_are_checked(engine, monkeypatch):
    engine.script("""CREATE TABLE p (id integer PRIMARY KEY); INSERT INTO p VALUES (1);
        CREATE TABLE t (a integer PRIMARY KEY, b integer REFERENCES p (id), c integer NOT NULL CHECK (c > b), d text);
        CREATE UNIQUE INDEX by_d ON t (length(d)); INSERT INTO t VALUES (1, 1, 2, 'x'), (2, NULL, 5, 'yy')""")
    seen = []
    for name in ("unique", "foreign"):
        real = getattr(engine.constraints, name)
        monkeypatch.setattr(engine.constraints, name, lambda *a, name=name, real=real: (seen.append(name), real(*a)))
    engine.sql("UPDATE t SET c = c + 1")
    assert seen == []
    engine.sql("UPDATE t SET d = d || 'z' WHERE a = 2")
    assert seen == ["unique"]
    engine.sql("UPDATE t SET b = 1")
    assert seen == ["unique", "foreign"]
    for text in ("UPDATE t SET b = 9", "UPDATE t SET c = NULL", "UPDATE t SET c = 0", "UPDATE t SET b = 1, c = 1", "UPDATE t SET a = 2", "UPDATE t SET d = 'q'"):
        with pytest.raises(ConstraintProblem):
            engine.sql(text)


def test_distinct_aggregates(engine):
    values = "(VALUES (1, 1, 'b'), (1, 1, 'a'), (1, 4, 'b'), (2, 7, NULL), (2, NULL, NULL)) v(g, x, t)"
    got = engine.sql(f"SELECT g, avg(DISTINCT x) AS a, stddev(DISTINCT x) AS s, sum(DISTINCT x * 2) AS t, count(DISTINCT x) AS n, avg(x) AS p FROM {values} GROUP BY g ORDER BY g")
    assert [tuple(r) for r in got.collect()] == [(1, 2.5, pytest.approx(4.5**0.5), 10, 2, 2.0), (2, 7.0, None, 14, 1, 7.0)]
    assert rows(engine.sql(f"SELECT min(DISTINCT x) AS a, max(DISTINCT x) AS b, bool_and(DISTINCT x > 0) AS c FROM {values}")) == [(1, 7, True)]
    assert rows(engine.sql(f"SELECT string_agg(t, '-') AS a, string_agg(DISTINCT t, '-') AS b FROM {values}")) == [("a-b-b", "a-b")]
    assert rows(engine.sql(f"SELECT avg(DISTINCT x) AS a, string_agg(t, '-') AS b FROM {values} WHERE FALSE")) == [(None, None)]
    engine.aggregates.register("spread", [None], engine.aggregates.get("sum").returns, lambda x: x)
    with pytest.raises(TypeProblem):
        engine.sql(f"SELECT spread(DISTINCT x) AS a FROM {values}")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quillon import storage

    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(EngineProblem, match="spark.checkpoint.dir"):
        storage.shared_folder(Session)


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') AND n_nationkey < 9", [(2,), (7,)]),
        ("SELECT x FROM (VALUES (1), (2), (NULL)) v(x) WHERE x NOT IN (SELECT y FROM (VALUES (2), (NULL)) w(y))", []),
        ("SELECT x FROM (VALUES (1), (2), (NULL)) v(x) WHERE x NOT IN (SELECT y FROM (VALUES (2)) w(y))", [(1,)]),
        ("SELECT x, x IN (SELECT y FROM (VALUES (2)) w(y)) AS i FROM (VALUES (1), (2)) v(x)", [(1, False), (2, True)]),
        ("SELECT r_regionkey FROM region r WHERE NOT EXISTS (SELECT 1 AS x FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n_nationkey < 3)", [(3,), (4,)]),
        ("SELECT r_regionkey, (SELECT max(n_nationkey) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS m FROM region r WHERE r_regionkey < 2", [(0, 20), (1, 21)]),
        ("SELECT x FROM (VALUES (1), (5)) v(x) WHERE x > (SELECT avg(y) FROM (VALUES (2), (4)) w(y))", [(5,)]),
        # a column of the query itself comes before one around it
        ("SELECT x FROM (VALUES (1), (5)) v(x) WHERE EXISTS (SELECT x FROM (VALUES (7)) w(x) WHERE x = 7)", [(1,), (5,)]),
        ("SELECT a.k FROM (VALUES (1), (2)) a(k) WHERE a.k IN (SELECT b.k FROM (VALUES (2), (3)) b(k) WHERE b.k = a.k)", [(2,)]),
    ],
)
def test_subqueries(engine, text, want):
    assert sorted(rows(engine.sql(text))) == want


def test_subqueries_in_changes_and_plans(engine):
    engine.script("CREATE TABLE t (a integer, b integer); INSERT INTO t VALUES (1, 0), (2, 0), (3, 0)")
    engine.sql("UPDATE t SET b = 1 WHERE a IN (SELECT r_regionkey FROM region WHERE r_name < 'ASIA')")
    engine.sql("DELETE FROM t WHERE NOT EXISTS (SELECT 1 AS x FROM region WHERE r_regionkey < 4 AND r_regionkey = a + 1)")
    assert sorted(rows(engine.sql("SELECT a, b FROM t"))) == [(1, 1), (2, 0)]
    plan = engine.explained("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 AS x FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
    assert "LeftSemi" in plan and "NestedLoop" not in plan
    for text in ("SELECT 1 AS x FROM region WHERE 1 IN (SELECT r_name, r_regionkey FROM region)", "SELECT (SELECT r_name, r_regionkey FROM region) AS x FROM region", "SELECT 1 AS x FROM region WHERE EXISTS (SELECT nope FROM nation)"):
        with pytest.raises(EngineProblem):
            engine.sql(text)


@pytest.mark.parametrize(
    "expression, want",
    [
        ("row_number() OVER (ORDER BY x)", [1, 2, 3, 4, 5]), ("rank() OVER (ORDER BY x)", [1, 2, 2, 4, 5]), ("dense_rank() OVER (ORDER BY x)", [1, 2, 2, 3, 4]),
        ("row_number() OVER (ORDER BY x DESC)", [5, 3, 4, 2, 1]), ("sum(x) OVER (ORDER BY x)", [1, 5, 5, 9, 9]), ("count(*) OVER ()", [5] * 5),
        ("sum(x) OVER (ORDER BY x ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", [1, 3, 4, 6, 4]), ("lag(x) OVER (ORDER BY x)", [None, 1, 2, 2, 4]),
        ("lead(x, 2, 0) OVER (ORDER BY x)", [2, 4, None, 0, 0]), ("first_value(x) OVER (PARTITION BY x / 2 ORDER BY x)", [1, 2, 2, 4, None]),
        ("max(x) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", [4] * 5), ("ntile(2) OVER (ORDER BY x)", [1, 1, 1, 2, 2]),
        ("x - min(x) OVER (PARTITION BY x > 1)", [0, 0, 0, 2, None]), ("count(x) OVER (ORDER BY x RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)", [1, 3, 3, 1, 0]),
    ],
)
def test_windows(engine, expression, want):
    got = engine.sql(f"SELECT x, {expression} AS w FROM (VALUES (1), (2), (2), (4), (NULL)) v(x)")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    values = zip([1, 2, 2, 4, None], want)
    assert sorted(rows(got), key=key) == sorted(values, key=key)


def test_windows_after_grouping_and_before_limits(engine):
    text = "SELECT n_regionkey / 3 AS k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM nation GROUP BY k ORDER BY r LIMIT 1"
    assert rows(engine.sql(text)) == [(0, 15, 1)]
    assert rows(engine.sql("SELECT r_name FROM region ORDER BY row_number() OVER (ORDER BY r_name DESC) LIMIT 1")) == [("MIDDLE EAST",)]
    assert engine.sql("SELECT DISTINCT count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation").count() == 1
    for text in ("SELECT 1 AS x FROM region WHERE rank() OVER (ORDER BY r_name) = 1", "SELECT count(*) AS n FROM region GROUP BY rank() OVER (ORDER BY r_name)",
                 "SELECT count(*) AS n FROM region HAVING rank() OVER (ORDER BY count(*)) = 1", "SELECT rank() OVER (PARTITION BY r_name) AS x FROM region"):
        with pytest.raises(TypeProblem):
            engine.sql(text)


def test_using_natural_and_distinct_on(engine):
    x, y = "(VALUES (1, 'a'), (2, 'b')) x(k, p)", "(VALUES (2, 'c'), (3, 'd')) y(k, q)"
    got = {kind: sorted(rows(engine.sql(f"SELECT * FROM {x} {kind} JOIN {y} USING (k)")), key=str) for kind in ("", "LEFT", "RIGHT", "FULL")}
    assert got[""] == [(2, "b", "c")] and got["LEFT"] == [(1, "a", None), (2, "b", "c")]
    assert got["RIGHT"] == [(2, "b", "c"), (3, None, "d")] and got["FULL"] == [(1, "a", None), (2, "b", "c"), (3, None, "d")]
    assert sorted(rows(engine.sql(f"SELECT k, x.k AS a, y.k AS b FROM {x} NATURAL LEFT JOIN {y}"))) == [(1, 1, None), (2, 2, 2)]
    assert rows(engine.sql(f"SELECT j.k, j.q FROM ({x} JOIN {y} USING (k)) j")) == [(2, "c")]
    assert engine.sql(f"SELECT y.* FROM {x} JOIN {y} USING (k)").columns == ["k", "q"]
    assert engine.sql("SELECT 1 AS z FROM (VALUES (1)) a(m) NATURAL JOIN (VALUES (1), (2)) b(n)").count() == 2
    with pytest.raises(NameProblem):
        engine.sql(f"SELECT 1 AS z FROM {x} JOIN {y} USING (p)")
    got = rows(engine.sql("SELECT DISTINCT ON (n_regionkey) n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey, n_nationkey DESC"))
    assert got == [(0, 20), (1, 21), (2, 22), (3, 23), (4, 24)]
    assert rows(engine.sql("SELECT DISTINCT ON (n_regionkey / 3) n_nationkey FROM nation ORDER BY n_nationkey LIMIT 3")) == [(0,), (3,)]


def test_long_lists(engine):
    assert rows(engine.sql(f"SELECT r_regionkey FROM region WHERE r_regionkey IN ({', '.join(map(str, range(3, 5000)))})")) == [(3,), (4,)]
    values = "(VALUES (1), (2), (NULL)) v(x)"
    assert rows(engine.sql(f"SELECT x IN (2, NULL) AS a, x NOT IN (2, 3) AS b FROM {values}")) == [(None, True), (True, False), (None, None)]
    assert rows(engine.sql(f"SELECT x FROM {values} WHERE x IN (1.0, x + 0, 7)")) == [(1,), (2,)]
    many = " OR ".join(f"r_regionkey = {i}" for i in range(3, 2000))
    assert rows(engine.sql(f"SELECT r_regionkey FROM region WHERE {many}")) == [(3,), (4,)]
    assert "In(p_size" in engine.explained("SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3)")
