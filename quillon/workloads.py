"""Named queries over the test tables, and DuckDB SQL with the same rows.

A workload is statements in the engine's dialect, the last of which gives the result. The
oracle is that last statement itself where DuckDB reads it alike, else its own SQL.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from quillon.session import Engine


@dataclass(frozen=True)
class Workload:
    name: str
    sql: str  # statements, separated by semicolons
    oracle: str | None = None  # the same as sql if None

    def run(self, spark, folder):
        return Engine(spark, folder).script(self.sql)[-1]


# The sets that set operations are tried on, a truth table, nulls among values.
LEFT = "(VALUES (1), (2), (2), (3), (3), (3), (4), (4), (4), (4)) a(n)"
RIGHT = "(VALUES (1), (3), (3), (5)) b(n)"
TRUTH = "(VALUES (1, TRUE), (2, FALSE), (3, NULL)) t(id, b)"
NULLS = "(VALUES (1, 10), (2, NULL), (3, 5), (4, NULL), (5, 7)) v(id, x)"
KEYS = "CREATE TABLE reg (r_regionkey integer PRIMARY KEY, r_name text NOT NULL);"
COPY = KEYS + "INSERT INTO reg SELECT r_regionkey, r_name FROM region;"
NATIONS = (
    "CREATE TABLE nat (n_nationkey integer PRIMARY KEY, n_name text NOT NULL, n_regionkey integer);"
    "INSERT INTO nat SELECT n_nationkey, n_name, n_regionkey FROM nation;"
)

WORKLOADS = [
    Workload("flagship", """
        SELECT o.o_orderpriority, c.c_mktsegment, count(*) AS order_lines, round(sum(l.l_extendedprice), 2) AS revenue
        FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        WHERE c.c_mktsegment = 'BUILDING' AND l.l_quantity > 10 GROUP BY o.o_orderpriority, c.c_mktsegment
        ORDER BY revenue DESC, o.o_orderpriority LIMIT 20"""),
    # projections
    Workload("scan_all", "SELECT * FROM nation"),
    Workload("select_columns", "SELECT n_name, n_regionkey FROM nation"),
    Workload("qualified_columns", "SELECT nation.n_name, nation.n_nationkey FROM nation"),
    Workload("alias_columns", "SELECT n_name AS name, n_regionkey region_key FROM nation n"),
    Workload("wildcard_plus_expr", "SELECT *, p_size + 1 AS next_size FROM part"),
    Workload("table_wildcard", "SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey"),
    Workload("duplicate_columns", "SELECT p_size, p_size AS p_size_again, p_size * 2 AS twice FROM part"),
    # filters
    Workload("filter_cmp", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11'"),
    Workload("filter_and_or_not", """SELECT p_partkey FROM part
        WHERE NOT (p_size = 1 OR p_size = 2) AND (p_size < 5 OR p_retailprice > 1500.5)"""),
    Workload("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15"),
    Workload("filter_not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45"),
    Workload("filter_between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 15 AND 5",
             "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15"),
    Workload("filter_not_between_symmetric", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN SYMMETRIC 45 AND 5",
             "SELECT p_partkey FROM part WHERE NOT (p_size BETWEEN 5 AND 45)"),
    Workload("filter_is_null_family", f"""SELECT id, x IS NULL AS a, x IS NOT NULL AS b, x ISNULL AS c, x NOTNULL AS d
        FROM {NULLS} WHERE x ISNULL OR x > 6"""),
    Workload("filter_is_bool_family", f"""SELECT id, b IS TRUE AS a, b IS NOT TRUE AS c, b IS FALSE AS d,
        b IS NOT FALSE AS e, b IS UNKNOWN AS f, b IS NOT UNKNOWN AS g FROM {TRUTH}""",
             f"""SELECT id, b IS TRUE AS a, b IS NOT TRUE AS c, b IS FALSE AS d, b IS NOT FALSE AS e, b IS NULL AS f,
        b IS NOT NULL AS g FROM {TRUTH}"""),
    Workload("filter_three_valued", f"""SELECT x.id AS i, y.id AS j, x.b AND y.b AS both_true, x.b OR y.b AS any_true, NOT x.b AS neg
        FROM (VALUES (1, TRUE), (2, FALSE), (3, NULL)) x(id, b), (VALUES (1, TRUE), (2, FALSE), (3, NULL)) y(id, b)"""),
    Workload("filter_is_distinct_from", f"""SELECT id, x IS DISTINCT FROM 5 AS a, x IS NOT DISTINCT FROM NULL AS b
        FROM {NULLS} WHERE x IS DISTINCT FROM 10"""),
    Workload("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '%1_'"),
    Workload("filter_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%a%' AND p_type NOT ILIKE 's%'"),
    Workload("filter_timestamp", """SELECT o_orderkey FROM orders
        WHERE o_orderdate >= CAST('1996-01-01' AS timestamp with time zone)""",
             "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
    Workload("filter_constant_false", "SELECT n.n_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE FALSE"),
    Workload("filter_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND p_size NOT IN (2)"),
    # joins
    Workload("join_inner", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'"),
    Workload("join_multi", """SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
        JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE c.c_acctbal > 5000.0"""),
    Workload("join_fact", """SELECT s.s_name, count(*) AS items, round(sum(l.l_quantity), 2) AS quantity FROM lineitem l
        JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size < 10 GROUP BY s.s_name"""),
    Workload("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    Workload("join_theta", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey"),
    Workload("join_comma_cross", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey"),
    Workload("join_without_condition", "SELECT r.r_name, n.n_name FROM region r JOIN nation n",
             "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n"),
    Workload("join_parenthesised", """SELECT c.c_custkey, r.r_name FROM customer c JOIN (nation n JOIN region r ON r.r_regionkey = n.n_regionkey)
        ON n.n_nationkey = c.c_nationkey"""),
    Workload("join_derived", """SELECT n.n_name, s.customers FROM nation n JOIN
        (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY c_nationkey) s ON s.k = n.n_nationkey"""),
    Workload("join_derived_columns", """SELECT n.n_name, s.total FROM nation n JOIN
        (SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey) s(k, total) ON s.k = n.n_nationkey"""),
    Workload("join_values", """SELECT n.n_name, v.tag FROM nation n JOIN (VALUES (0, 'a'), (1, 'b'), (1, 'c')) v(k, tag)
        ON v.k = n.n_regionkey AND v.tag <> 'c' WHERE n.n_nationkey + v.k > 3"""),
    Workload("join_limited", """SELECT n.n_name, s.r_name FROM nation n JOIN
        (SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 2 OFFSET 1) s ON s.r_regionkey = n.n_regionkey"""),
    Workload("join_left", "SELECT r.r_name, s.s_name FROM region r LEFT JOIN (SELECT n_regionkey, n_name AS s_name FROM nation WHERE n_nationkey < 5) s ON s.n_regionkey = r.r_regionkey"),
    Workload("join_right", "SELECT r.r_name, n.n_name FROM region r RIGHT JOIN nation n ON r.r_regionkey = n.n_regionkey AND r.r_regionkey > 2"),
    Workload("join_full", "SELECT a.n AS x, b.n AS y FROM (VALUES (1), (2)) a(n) FULL JOIN (VALUES (2), (3)) b(n) ON a.n = b.n"),
    Workload("join_using", "SELECT k, a.x, b.y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a FULL JOIN (SELECT r_regionkey + 23 AS k, r_name AS y FROM region) b USING (k)"),
    Workload("join_natural", "SELECT * FROM (SELECT n_nationkey, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b"),
    # aggregates
    Workload("agg_count_star", "SELECT count(*) AS total FROM lineitem"),
    Workload("agg_count_col", f"SELECT count(x) AS known, count(*) AS total, count(1) AS ones FROM {NULLS}"),
    Workload("agg_min_max", "SELECT min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, min(l_quantity) AS low, max(l_comment) AS word FROM (SELECT l_shipdate, l_quantity, l_returnflag AS l_comment FROM lineitem) s"),
    Workload("agg_nulls", f"SELECT min(x) AS low, max(x) AS high, CAST(sum(x) AS bigint) AS total FROM {NULLS}"),
    Workload("agg_sum", "SELECT CAST(sum(p_size) AS bigint) AS sizes, round(sum(p_retailprice), 2) AS prices FROM part"),
    Workload("agg_group_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    Workload("agg_group_expr", "SELECT length(c_mktsegment) AS size, count(*) AS n FROM customer GROUP BY length(c_mktsegment)"),
    Workload("agg_group_alias", "SELECT p_size * 2 AS p_size, count(*) AS n FROM part GROUP BY p_size",
             "SELECT p_size * 2 AS p_size, count(*) AS n FROM part GROUP BY part.p_size * 2"),
    Workload("agg_group_constant", "SELECT count(*) AS n, min(p_size) AS low FROM part GROUP BY 1", "SELECT count(*) AS n, min(p_size) AS low FROM part"),
    Workload("agg_group_constant_empty", "SELECT count(*) AS n FROM part WHERE p_size < 0 GROUP BY 1", "SELECT count(*) AS n FROM part WHERE FALSE GROUP BY p_size"),
    Workload("agg_expr_over_agg", "SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS spread, count(*) * 2 AS twice FROM customer GROUP BY c_nationkey"),
    Workload("agg_having_by_subquery", "SELECT * FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) s WHERE s.n > 15 AND o_custkey > 100"),
    Workload("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    Workload("agg_empty_input", "SELECT count(*) AS n, max(p_size) AS high FROM part WHERE p_size < 0"),
    Workload("agg_null_keys", f"SELECT x, count(*) AS n FROM {NULLS} GROUP BY x"),
    Workload("agg_order_by_count", "SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment ORDER BY count DESC, c_mktsegment LIMIT 3",
             "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 3"),
    Workload("agg_events", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type"),
    Workload("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY o_orderstatus"),
    Workload("agg_distinct_avg", "SELECT o_orderstatus, round(avg(DISTINCT o_custkey + 1), 6) AS mean, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    Workload("agg_distinct_stddev", "SELECT round(stddev(DISTINCT p_size), 6) AS spread, round(stddev(p_size), 6) AS of_all, CAST(sum(DISTINCT p_size) AS bigint) AS total, min(DISTINCT p_size) AS low FROM part"),
    Workload("agg_string", "SELECT r.r_name, string_agg(DISTINCT n.n_name, ', ') AS nations FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
             "SELECT r.r_name, string_agg(DISTINCT n.n_name, ', ' ORDER BY n.n_name) AS nations FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"),
    # order and limits
    Workload("join_sort_limit", """SELECT c.c_name, o.o_orderkey, n.n_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
        JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 1000.0 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20"""),
    Workload("order_nulls_first", f"SELECT id, x FROM {NULLS} ORDER BY x NULLS FIRST, id DESC LIMIT 3"),
    Workload("order_nulls_last_desc", f"SELECT id, x FROM {NULLS} ORDER BY x DESC NULLS LAST, id LIMIT 3"),
    Workload("now", "SELECT r_regionkey, now() IS NOT NULL AND now() > CAST('2020-01-01' AS timestamp with time zone) AS later FROM region",
             "SELECT r_regionkey, TRUE AS later FROM region"),
    Workload("order_multi_mixed", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_size DESC, p_brand, p_partkey DESC LIMIT 50"),
    Workload("order_expr", "SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey LIMIT 25"),
    Workload("order_alias", "SELECT p_partkey AS k, p_retailprice - p_size AS gap FROM part ORDER BY gap DESC, k LIMIT 25"),
    Workload("order_non_selected", "SELECT p_name FROM part ORDER BY p_partkey LIMIT 10"),
    Workload("order_constant", "SELECT p_partkey FROM part ORDER BY 1, p_partkey DESC LIMIT 5", "SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 5"),
    Workload("order_nulls", f"SELECT id FROM {NULLS} ORDER BY x, id DESC LIMIT 4", f"SELECT id FROM {NULLS} ORDER BY x NULLS LAST, id DESC LIMIT 4"),
    Workload("order_nulls_desc", f"SELECT id FROM {NULLS} ORDER BY x DESC, id LIMIT 3", f"SELECT id FROM {NULLS} ORDER BY x DESC NULLS FIRST, id LIMIT 3"),
    Workload("limit_only", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"),
    Workload("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    Workload("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    Workload("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0"),
    Workload("offset_past_end", "SELECT r_name FROM region ORDER BY r_name LIMIT 5 OFFSET 100"),
    Workload("limit_unordered_count", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 100) s"),
    Workload("distinct_on", "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey"),
    # subqueries and windows
    Workload("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    Workload("subquery_exists", """SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 AS x FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)
        AND NOT EXISTS (SELECT 1 AS x FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey = 0)"""),
    Workload("subquery_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) * 1.5 FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)"),
    Workload("subquery_in_list", "SELECT r_name, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS nations FROM region r"),
    Workload("window_ranks", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
        rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS d FROM orders"""),
    Workload("window_frames", """SELECT p_partkey, lag(p_size, 1, 0) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before, count(*) OVER (PARTITION BY p_brand) AS n,
        max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS high FROM part"""),
    Workload("window_over_groups", "SELECT c_nationkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM customer GROUP BY c_nationkey"),
    # set operations
    Workload("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    Workload("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    Workload("union_values", f"SELECT n FROM {LEFT} UNION SELECT n FROM {RIGHT}"),
    Workload("union_all_values", f"SELECT n FROM {LEFT} UNION ALL SELECT n FROM {RIGHT}"),
    Workload("intersect_distinct", f"SELECT n FROM {LEFT} INTERSECT SELECT n FROM {RIGHT}"),
    Workload("intersect_all", f"SELECT n FROM {LEFT} INTERSECT ALL SELECT n FROM {RIGHT}"),
    Workload("except_distinct", f"SELECT n FROM {LEFT} EXCEPT SELECT n FROM {RIGHT}"),
    Workload("except_all", f"SELECT n FROM {LEFT} EXCEPT ALL SELECT n FROM {RIGHT}"),
    Workload("setop_tables", "SELECT c_nationkey FROM customer WHERE c_acctbal < 0.0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0"),
    Workload("setop_right_nested", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey <= 10 EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey >= 8 AND n_nationkey <= 12 UNION SELECT n_nationkey FROM nation WHERE n_nationkey = 3",
             "SELECT n_nationkey AS k FROM nation WHERE n_nationkey <= 10 EXCEPT (SELECT n_nationkey FROM nation WHERE n_nationkey >= 8 AND n_nationkey <= 12 UNION SELECT n_nationkey FROM nation WHERE n_nationkey = 3)"),
    Workload("setop_parenthesised_values", "SELECT r_regionkey FROM region UNION (VALUES (7), (8), (1))"),
    Workload("setop_ordered", f"SELECT n FROM {LEFT} UNION ALL SELECT n FROM {RIGHT} ORDER BY n DESC LIMIT 6",
             f"SELECT n FROM (SELECT n FROM {LEFT} UNION ALL SELECT n FROM {RIGHT}) u ORDER BY n DESC LIMIT 6"),
    Workload("setop_nulls", f"SELECT x FROM {NULLS} INTERSECT SELECT x FROM {NULLS.replace('v(', 'w(')}"),
    # expressions
    Workload("arith_promote", "SELECT p_partkey, p_size + p_partkey AS a, p_size * 1.5 AS b, p_size - 7 AS c, p_retailprice / 4 AS d FROM part",
             "SELECT p_partkey, p_size + p_partkey AS a, p_size * 1.5::DOUBLE AS b, p_size - 7 AS c, p_retailprice / 4 AS d FROM part"),
    Workload("arith_left", "SELECT 10 - 3 - 2 AS a, 2 * 7 / 3 AS b, 20 / 3 / 2 AS c, 1 + 2 * 3 - 4 AS d FROM region LIMIT 1",
             "SELECT 5 AS a, 4 AS b, 3 AS c, 3 AS d"),
    Workload("int_division", "SELECT p_partkey, p_size / 7 AS q, -p_size / 7 AS neg, p_partkey / 3 AS big FROM part",
             "SELECT p_partkey, p_size // 7 AS q, (-p_size) // 7 AS neg, p_partkey // 3 AS big FROM part"),
    Workload("unary_minus", "SELECT -p_size AS a, +p_size AS b, - -3 AS c FROM part", "SELECT -p_size AS a, p_size AS b, 3 AS c FROM part"),
    Workload("concat", "SELECT n_name || '/' || n_name AS twice FROM nation"),
    Workload("concat_null", "SELECT id, t || 'x' AS made FROM (VALUES (1, 'a'), (2, NULL)) v(id, t)"),
    Workload("length_bytes", "SELECT doc_id, length(text) AS bytes FROM documents", "SELECT doc_id, strlen(text) AS bytes FROM documents"),
    Workload("precedence", "SELECT p_partkey FROM part WHERE NOT p_size = 3 AND p_size + 1 IS NOT NULL AND p_size BETWEEN 2 AND 9 AND p_partkey > 5"),
    Workload("case_cast_coalesce", f"SELECT id, CASE WHEN x > 6 THEN 'big' WHEN x ISNULL THEN 'none' ELSE 'small' END AS size, coalesce(x, 0) AS y, CAST(x AS text) AS t FROM {NULLS}"),
    Workload("select_distinct", "SELECT DISTINCT p_brand, p_size FROM part"),
    Workload("with_query", "WITH big AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 20), all_of AS (SELECT k FROM big UNION ALL SELECT k FROM big) SELECT k, count(*) AS n FROM all_of GROUP BY k"),
    # sources
    Workload("values_columns", "SELECT column1, column2 FROM (VALUES (1, 'a'), (2, 'b')) v", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(column1, column2)"),
    Workload("values_alias", "SELECT v.a, v.b FROM (VALUES (1, 2.5), (2, NULL)) v(a, b)", "SELECT a, b FROM (VALUES (1, 2.5::DOUBLE), (2, NULL)) v(a, b)"),
    Workload("values_expressions", "SELECT a, b FROM (VALUES (1 + 1, 'a' || 'b'), (7 / 2, NULL)) v(a, b)", "SELECT a, b FROM (VALUES (2, 'ab'), (3, NULL)) v(a, b)"),
    Workload("derived_table", "SELECT s.k, s.n_name FROM (SELECT n_nationkey AS k, n_name FROM nation) s WHERE s.k > 10"),
    Workload("derived_table_aliases", "SELECT f.id, f.label FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation) f(id, label) WHERE f.n_regionkey = 1",
             "SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_regionkey = 1"),
    Workload("derived_limit_boundary", "SELECT * FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20) s WHERE o_orderstatus = 'O'"),
    Workload("group_pushdown", "SELECT * FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) s WHERE c_nationkey > 5 AND n > 2"),
    # changes and definitions
    Workload("dml_insert_returning", KEYS + "INSERT INTO reg (r_name, r_regionkey) VALUES ('NORTH', 10), ('SOUTH', 11) RETURNING r_regionkey, r_name, r_regionkey * 2 AS twice",
             "SELECT * FROM (VALUES (10, 'NORTH', 20), (11, 'SOUTH', 22)) v(r_regionkey, r_name, twice)"),
    Workload("dml_insert_select", COPY + "SELECT * FROM reg", "SELECT * FROM region"),
    Workload("dml_insert_defaults", "CREATE TABLE d (id serial, kind text NOT NULL DEFAULT 'none', size bigint DEFAULT 3); INSERT INTO d (size) VALUES (1), (NULL); INSERT INTO d (kind) VALUES ('own'); SELECT * FROM d",
             "SELECT * FROM (VALUES (1, 'none', 1::BIGINT), (2, 'none', NULL), (3, 'own', 3)) v(id, kind, size)"),
    Workload("dml_update_returning", COPY + "UPDATE reg r SET r_name = r_name || '!' WHERE r.r_regionkey > 2 RETURNING *",
             "SELECT r_regionkey, r_name || '!' AS r_name FROM region WHERE r_regionkey > 2"),
    Workload("dml_update_all_rows", NATIONS + "UPDATE nat SET n_regionkey = n_regionkey + 1, n_name = n_name || '.' WHERE n_regionkey < 2; SELECT * FROM nat",
             "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN n_name || '.' ELSE n_name END AS n_name, CASE WHEN n_regionkey < 2 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation"),
    Workload("dml_update_from", NATIONS + "UPDATE nat n SET n_name = n.n_name || '-' || r.r_name FROM region r WHERE r.r_regionkey = n.n_regionkey AND r.r_name = 'ASIA'; SELECT n_nationkey, n_name FROM nat",
             "SELECT n_nationkey, CASE WHEN r_name = 'ASIA' THEN n_name || '-' || r_name ELSE n_name END AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    Workload("dml_delete", NATIONS + "DELETE FROM nat WHERE n_regionkey = 1; SELECT * FROM nat", "SELECT * FROM nation WHERE n_regionkey <> 1"),
    Workload("dml_delete_returning", NATIONS + "DELETE FROM nat n WHERE n.n_nationkey >= 20 RETURNING n.n_name AS gone", "SELECT n_name AS gone FROM nation WHERE n_nationkey >= 20"),
    Workload("dml_delete_using", NATIONS + "DELETE FROM nat USING region r WHERE r.r_regionkey = n_regionkey AND r.r_name = 'EUROPE'; SELECT * FROM nat",
             "SELECT nation.* FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'"),
    Workload("seq_serial_insert", "CREATE TABLE t (id bigserial PRIMARY KEY, name text); INSERT INTO t (name) SELECT n_name FROM nation; INSERT INTO t (name) VALUES ('last'); SELECT count(*) AS n, min(id) AS low, max(id) AS high, count(DISTINCT id) AS ids FROM t",
             "SELECT count(*) + 1 AS n, 1::BIGINT AS low, count(*) + 1 AS high, count(*) + 1 AS ids FROM nation"),
    Workload("seq_functions", "CREATE SEQUENCE s; SELECT count(*) AS n, min(v) AS low, max(v) AS high FROM (SELECT nextval('s') AS v FROM nation) q; SELECT currval('s') AS now_at, setval('s', 100) AS put FROM region LIMIT 1; SELECT r_regionkey, nextval('s') - 100 > 0 AS later FROM region",
             "SELECT r_regionkey, TRUE AS later FROM region"),
    Workload("constraint_indexes", COPY + "CREATE UNIQUE INDEX by_name ON reg USING btree (r_name); CREATE INDEX h ON reg USING hash (r_regionkey); CREATE INDEX part ON reg (length(r_name) DESC) WHERE r_regionkey > 1; ALTER TABLE reg ADD CONSTRAINT small CHECK (r_regionkey < 100); INSERT INTO reg VALUES (50, 'MOON'); SELECT * FROM reg",
             "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'MOON'"),
    Workload("constraint_foreign_key", COPY + "CREATE TABLE c (id integer PRIMARY KEY, region integer REFERENCES reg (r_regionkey), price real CHECK (price > 0)); INSERT INTO c VALUES (1, 0, 1.5), (2, NULL, NULL); SELECT c.id, r.r_name FROM c JOIN reg r ON r.r_regionkey = c.region",
             "SELECT 1 AS id, r_name FROM region WHERE r_regionkey = 0"),
]


def _violations(spark, folder):
    """Each kind of violation is refused and leaves the table as it was."""
    from quillon.errors import ConstraintProblem

    engine = Engine(spark, folder)
    engine.script(COPY + "CREATE TABLE c (id integer PRIMARY KEY, r integer REFERENCES reg (r_regionkey), n integer CHECK (n > 0));")
    engine.sql("INSERT INTO c VALUES (1, 1, 1)")
    found = []
    for name, text in (
        ("primary key", "INSERT INTO c VALUES (1, 2, 2)"), ("not null", "INSERT INTO c VALUES (NULL, 2, 2)"),
        ("foreign key", "INSERT INTO c VALUES (2, 99, 2)"), ("check", "UPDATE c SET n = 0"),
        ("none", "INSERT INTO c VALUES (3, NULL, NULL)"),
    ):
        try:
            engine.sql(text)
            refused = False
        except ConstraintProblem:
            refused = True
        found.append((name, refused, engine.sql("SELECT count(*) AS n FROM c").first()[0]))
    return spark.createDataFrame(found, "violation string, refused boolean, rows bigint")


def _refusals(spark, folder):
    """Statements that mean nothing are refused, each with its kind of problem."""
    from quillon.errors import EngineProblem, NameProblem

    engine, found = Engine(spark, folder), []
    for name, text in (
        ("ungrouped column", "SELECT r_name, count(*) FROM region"), ("column beside its key", "SELECT r_name FROM region GROUP BY r_regionkey"),
        ("aggregate in WHERE", "SELECT r_name FROM region WHERE count(*) > 1"), ("aggregate as a key", "SELECT count(*) AS n FROM region GROUP BY count(*)"),
        ("nested aggregates", "SELECT sum(count(*)) AS n FROM region"), ("unknown column", "SELECT x FROM region"),
        ("grouped expression", "SELECT r_regionkey + 1 AS k, count(*) AS n FROM region GROUP BY r_regionkey + 1"),
    ):
        try:
            problem = "none" if engine.sql(text) else ""
        except EngineProblem as refused:
            problem = "NameProblem" if isinstance(refused, NameProblem) else type(refused).__name__
        found.append((name, problem))
    return spark.createDataFrame(found, "statement string, problem string")


def _rendered(spark, folder):
    """The lines of a table and of records as the shell shows them."""
    from quillon import render

    df = Engine(spark, folder).sql("SELECT id, name, ok FROM (VALUES (1, 'x', TRUE), (20, NULL, FALSE)) v(id, name, ok) ORDER BY id")
    lines = [*render.table(df).splitlines(), *render.expanded(df).splitlines()]
    return spark.createDataFrame(list(enumerate(lines)), "place bigint, line string")


def _shell(spark, folder):
    """What the shell says to a few lines, but for times."""
    import io

    from quillon.repl import Shell

    out = io.StringIO()
    shell = Shell(Engine(spark, folder), out)
    for line in ("select r_name", "from region order by r_name limit 1;", "select nonsense from region;", "\\x", "select r_regionkey from region limit 0;"):
        shell.feed(line)
    lines = [x for x in out.getvalue().splitlines() if x and not x.startswith("Time")]
    return spark.createDataFrame(list(enumerate(lines)), "place bigint, line string")


def _functions(spark, folder):
    """Functions of one's own, scalar and aggregate, beside the engine's."""
    from pyspark.sql import functions as F

    from quillon import types

    engine = Engine(spark, folder)
    engine.functions.register("twice", [types.TEXT], types.TEXT, lambda x: F.concat(x, x))
    engine.aggregates.register("spread", [types.DOUBLE], types.DOUBLE, lambda x: F.max(x) - F.min(x))
    return engine.sql("SELECT twice(c_mktsegment) AS name, spread(c_acctbal) AS spread FROM customer GROUP BY twice(c_mktsegment)")


def _sample(spark, folder):
    """The sample database's script, loaded from the folder's tables."""
    from quillon.sources import sample

    engine = Engine(spark, folder)
    sample.load(engine)
    return engine.sql("""SELECT a.area, count(*) AS clients FROM clients c JOIN countries d ON d.country_id = c.country_id
        JOIN areas a ON a.area_id = d.area_id GROUP BY a.area""")


def _stream(spark, folder):
    """A stream of Parquet files as a table, joined and grouped until it has all that there is."""
    from quillon.streaming.queries import start

    engine, name = Engine(spark, folder), f"streamed_{uuid.uuid4().hex}"
    path = f"{folder}/orders.parquet"
    engine.register("feed", spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/orders*.parquet"))
    query = start(engine, "SELECT c.c_mktsegment, count(*) AS n FROM feed f JOIN customer c ON c.c_custkey = f.o_custkey GROUP BY c.c_mktsegment", name, "complete")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def _explain(spark, folder):
    """EXPLAIN gives one row with one text column; the plan's wording is Spark's."""
    plan = Engine(spark, folder).sql("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey > 3")
    return plan.selectExpr("`query plan` LIKE '%PushedFilters%n_nationkey%' AS pushed")


OTHERS = {
    "constraint_violations": _violations, "explain": _explain, "refusals": _refusals, "rendered": _rendered, "shell": _shell,
    "functions_registered": _functions, "sample_database": _sample, "stream_as_table": _stream,
}
QUERIES = {w.name: w.run for w in WORKLOADS} | OTHERS
ORACLES = {w.name: w.oracle or w.sql for w in WORKLOADS} | {
    "constraint_violations": "SELECT * FROM (VALUES ('primary key', TRUE, 1::BIGINT), ('not null', TRUE, 1), ('foreign key', TRUE, 1), ('check', TRUE, 1), ('none', FALSE, 2)) v(violation, refused, rows)",
    "explain": "SELECT TRUE AS pushed",
    "refusals": """SELECT * FROM (VALUES ('ungrouped column', 'TypeProblem'), ('column beside its key', 'TypeProblem'), ('aggregate in WHERE', 'TypeProblem'),
        ('aggregate as a key', 'TypeProblem'), ('nested aggregates', 'TypeProblem'), ('unknown column', 'NameProblem'), ('grouped expression', 'none')) v(statement, problem)""",
    "rendered": """SELECT * FROM (VALUES (0::BIGINT, ' id |  name  | ok'), (1, '----+--------+----'), (2, '  1 | x      | t '), (3, ' 20 | [NULL] | f '),
        (4, '(2 rows)'), (5, '-[ RECORD 1 ]'), (6, 'id   | 1'), (7, 'name | x'), (8, 'ok   | t'), (9, '-[ RECORD 2 ]'), (10, 'id   | 20'),
        (11, 'name | [NULL]'), (12, 'ok   | f')) v(place, line)""",
    "shell": """SELECT * FROM (VALUES (0::BIGINT, ' r_name'), (1, '--------'), (2, ' AFRICA'), (3, '(1 rows)'), (4, 'error: unknown column nonsense'),
        (5, 'Expanded display is on.'), (6, '(0 rows)')) v(place, line)""",
    "functions_registered": "SELECT c_mktsegment || c_mktsegment AS name, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY ALL",
    "sample_database": """SELECT r.r_name AS area, count(*) AS clients FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
        JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ALL""",
    "stream_as_table": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL",
}
