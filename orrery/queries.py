"""Queries over the driver's tables, one or more for each operator, with their DuckDB equivalents.

SQL ones are in the engine's dialect, run through its rewriter; the others use the DataFrame operators.
Keys say what a query covers; results that SQL leaves without order are compared without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import functions as fn
from orrery.operators import recursion
from orrery.operators import relational as rel
from orrery.plans import ingest, substrait
from orrery.plans.builder import Builder
from orrery.session import scratch
from orrery.sources.engine import Engine
from orrery.streaming import bounded

FLAGSHIP = "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag ORDER BY l_returnflag"

#: name: (engine SQL, DuckDB SQL or None where the text is the same)
SQL: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, None),
    "scan_subset": ("SELECT n_nationkey, n_name FROM nation", None),
    "values_rows": ("VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(column1, column2)"),
    "values_from": ("SELECT k, s FROM (VALUES (1, 'x'), (2, 'y')) AS t(k, s) WHERE k > 1", None),
    "generate_series": ("SELECT generate_series AS n FROM generate_series(10, 1, -3)", "SELECT generate_series AS n FROM generate_series(10, 1, -3)"),
    "generate_series_empty": ("SELECT generate_series AS n FROM generate_series(5, 1)", "SELECT generate_series AS n FROM generate_series(5, 1)"),
    "comma_from": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "derived_table": ("SELECT d.k, d.n FROM (SELECT l_suppkey AS k, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey) AS d WHERE d.n > 5", None),
    "projection_arithmetic": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem", None),
    "predicates": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 10 AND l_quantity < 20) OR NOT (l_tax <> 0.02) AND l_linenumber <= 3", None),
    "null_tests": ("SELECT NULLIF(l_linenumber, 1) IS NULL AS a, NULLIF(l_linenumber, 2) IS NOT NULL AS b, COUNT(*) AS n FROM lineitem GROUP BY NULLIF(l_linenumber, 1) IS NULL, NULLIF(l_linenumber, 2) IS NOT NULL", None),
    "in_list": ("SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5) OR n_nationkey NOT IN (1, 2, 3, 4, 5, 6, 7, 8)", None),
    "between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 7 AND l_linenumber NOT BETWEEN 2 AND 3", None),
    "like_escape": ("SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE '%x!%y%' ESCAPE '!'", None),
    "like_backslash": ("SELECT COUNT(*) AS n FROM region WHERE 'a\\b' LIKE 'a\\_'", "SELECT COUNT(*) AS n FROM region WHERE 'a\\b' LIKE 'a\\_'"),
    "ilike": ("SELECT n_name FROM nation WHERE n_name ILIKE '%A%'", None),
    "prewhere": ("SELECT l_orderkey, l_linenumber FROM lineitem PREWHERE l_quantity > 45 WHERE l_tax > 0.05", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_tax > 0.05"),
    "qualified_columns": ("SELECT main.nation.n_name FROM nation WHERE main.nation.n_nationkey < 5", "SELECT n_name FROM nation WHERE n_nationkey < 5"),
    "star": ("SELECT * FROM region", None),
    "inner_join": ("SELECT o_orderkey, l_linenumber, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40", None),
    "left_join": ("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    "right_join": ("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", None),
    "full_join": ("SELECT a.k AS ak, b.k AS bk FROM (SELECT NULLIF(n_nationkey, 3) AS k FROM nation) AS a FULL JOIN (SELECT r_regionkey + 2 AS k FROM region) AS b ON a.k = b.k", None),
    "cross_join": ("SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "theta_join": ("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey * 3", None),
    "range_join": ("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey BETWEEN r_regionkey AND r_regionkey + 2", None),
    "multi_key_join": ("SELECT COUNT(*) AS n FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey", None),
    "multi_join": ("SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name", None),
    "lateral": ("SELECT n_nationkey, t.m FROM nation, LATERAL (SELECT MAX(s_acctbal) AS m FROM supplier WHERE s_nationkey = n_nationkey) AS t", None),
    "lateral_left": ("SELECT r_regionkey, t.n_name FROM region LEFT JOIN LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20) AS t ON true", None),
    "exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "correlated_scalar": ("SELECT l_orderkey, l_linenumber FROM lineitem AS a WHERE l_quantity > (SELECT AVG(l_quantity) FROM lineitem AS b WHERE b.l_partkey = a.l_partkey)", None),
    "scalar_subquery": ("SELECT o_orderkey, (SELECT COUNT(*) FROM region) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    "in_subquery": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", None),
    "not_in_null": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region)", None),
    "scalar_aggregate": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_shipdate) AS a, MAX(l_shipdate) AS z, ROUND(AVG(l_tax), 8) AS m FROM lineitem", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_shipdate) AS a, MAX(l_shipdate) AS z, ROUND(AVG(l_tax), 8) AS m FROM lineitem"),
    "empty_aggregate": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_tax) AS m, STDDEV_POP(l_tax) AS d FROM lineitem WHERE l_quantity < 0", None),
    "filtered_aggregate": ("SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS r FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.06 AND l_quantity < 24", None),
    "group_low": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_medium": ("SELECT l_suppkey, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice), 2) AS p FROM lineitem GROUP BY l_suppkey", None),
    "group_high": ("SELECT l_orderkey, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey", None),
    "group_two_keys": ("SELECT l_suppkey, l_linenumber, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey, l_linenumber", None),
    "group_wide": ("SELECT l_suppkey, l_linenumber, l_returnflag, l_linestatus, MIN(l_tax) AS a, MAX(l_tax) AS z FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag, l_linestatus", None),
    "group_expression": ("SELECT l_orderkey % 10 AS k, COUNT(*) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey % 10", None),
    "group_null_key": ("SELECT NULLIF(l_linenumber, 2) AS k, COUNT(*) AS n FROM lineitem GROUP BY NULLIF(l_linenumber, 2)", None),
    "string_aggregates": ("SELECT c_mktsegment, MIN(c_name) AS a, MAX(c_name) AS z, COUNT(c_name) AS n FROM customer GROUP BY c_mktsegment", None),
    "variance": ("SELECT l_returnflag, ROUND(VAR_POP(l_quantity), 6) AS a, ROUND(VAR_SAMP(l_quantity), 6) AS b, ROUND(VARIANCE(l_quantity), 6) AS c, ROUND(STDDEV(l_quantity), 6) AS d, ROUND(STDDEV_POP(l_quantity), 6) AS e, ROUND(STDDEV_SAMP(l_quantity), 6) AS f FROM lineitem GROUP BY l_returnflag", None),
    "decimal_aggregates": ("SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(10,2))) AS DOUBLE) AS s, CAST(MIN(CAST(l_tax AS DECIMAL(10,2))) AS DOUBLE) AS a, CAST(MAX(CAST(l_tax AS DECIMAL(10,2))) AS DOUBLE) AS z FROM lineitem GROUP BY l_returnflag", None),
    "count_distinct": ("SELECT COUNT(DISTINCT l_suppkey) AS n FROM lineitem", None),
    "count_distinct_grouped": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag HAVING COUNT(DISTINCT l_suppkey) > 1 ORDER BY l_returnflag LIMIT 2", None),
    "count_distinct_mixed": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS a, COUNT(DISTINCT l_partkey) AS b, COUNT(*) AS n, MIN(l_tax) AS t FROM lineitem GROUP BY l_returnflag", None),
    "having": ("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 590 AND MIN(l_tax) = 0", None),
    "post_aggregate": ("SELECT l_returnflag, ROUND(SUM(l_extendedprice) / SUM(l_quantity) + 1, 4) AS r FROM lineitem GROUP BY l_returnflag", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_returnflag) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(GROUPING(l_returnflag) AS TINYINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "cube": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag), ())", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "grouping_id": ("SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS g, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "group_by_all": ("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY ALL", None),
    "with_rollup": ("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag WITH ROLLUP", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)"),
    "with_cube": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH CUBE", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "with_totals": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH TOTALS", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())"),
    "window_ranks": ("SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS d FROM orders", None),
    "window_running": ("SELECT l_orderkey, l_linenumber, ROUND(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 4) AS s, ROUND(AVG(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 4) AS m, MIN(l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS a, MAX(l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS z, COUNT(l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem", None),
    "window_whole": ("SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer", None),
    "window_named": ("SELECT c_custkey, CAST(RANK() OVER (w ORDER BY c_acctbal, c_custkey) AS BIGINT) AS r FROM customer WINDOW w AS (PARTITION BY c_mktsegment)", None),
    "qualify_alias": ("SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn = 1", "SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn FROM orders QUALIFY rn = 1"),
    "qualify_expression": ("SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2", None),
    "order_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5", None),
    "fetch_first": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST 7 ROWS ONLY", None),
    "top_n": ("SELECT TOP 9 o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 9"),
    "for_update": ("SELECT r_name FROM region FOR UPDATE", "SELECT r_name FROM region"),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus, NULLIF(l_linenumber, 1) AS k FROM lineitem", None),
    "distinct_on": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", None),
    "distinct_on_limit": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 50", None),
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region", None),
    "except_all": ("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region", None),
    "intersect": ("SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region", None),
    "intersect_all": ("SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_nationkey % 2 FROM nation", None),
    "cte": ("WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT MAX(s) AS m FROM a) SELECT o_custkey FROM a, b WHERE s = m", None),
    "recursive_linear": ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 200) SELECT n FROM r", None),
    "recursive_set_sql": ("WITH RECURSIVE r(src, dst) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation UNION SELECT r.src, CAST(n_regionkey AS BIGINT) FROM r JOIN nation ON r.dst = n_nationkey) SELECT src, dst FROM r", None),
    "recursive_nonlinear_sql": ("WITH RECURSIVE r AS (SELECT n_nationkey AS src, n_regionkey AS dst FROM nation UNION SELECT a.src, b.dst FROM r AS a JOIN r AS b ON a.dst = b.src) SELECT src, dst FROM r", "WITH RECURSIVE r AS (SELECT n_nationkey AS src, n_regionkey AS dst FROM nation UNION SELECT r.src, n_regionkey FROM r JOIN nation ON r.dst = n_nationkey) SELECT src, dst FROM r"),
    "recursive_mutual_sql": ("WITH RECURSIVE even(n) AS (SELECT r_regionkey FROM region WHERE r_regionkey = 0 UNION SELECT n + 1 FROM odd WHERE n < 40), odd(n) AS (SELECT r_regionkey FROM region WHERE r_regionkey = 1 UNION SELECT n + 1 FROM even WHERE n < 40) SELECT 'even' AS kind, n FROM even UNION ALL SELECT 'odd', n FROM odd", "SELECT CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, CAST(n AS INT) AS n FROM (SELECT generate_series AS n FROM generate_series(0, 40))"),
    "unnamed_items": ("SELECT l_returnflag, SUM(l_linenumber), COUNT(*), MAX(l_tax), COUNT(DISTINCT l_suppkey) + 1 FROM lineitem GROUP BY l_returnflag", 'SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber, COUNT(*) AS "count", MAX(l_tax) AS max_l_tax, COUNT(DISTINCT l_suppkey) + 1 AS __expr_4 FROM lineitem GROUP BY l_returnflag'),
    "join_collisions": ("SELECT * FROM (SELECT n_nationkey AS id, n_name AS name FROM nation) AS a JOIN (SELECT r_regionkey AS id, r_name AS name FROM region) AS b ON a.id = b.id", 'SELECT n_nationkey AS id, n_name AS name, r_regionkey AS "right.id", r_name AS "right.name" FROM nation JOIN region ON n_nationkey = r_regionkey'),
    "case_forms": ("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'mid' END AS a, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS b FROM lineitem", None),
    "coalesce_nullif": ("SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_linenumber, 1), NULLIF(l_linenumber, 2), 9) AS k FROM lineitem", None),
    "casts": ("SELECT CAST(l_linenumber AS DOUBLE) AS a, CAST(l_quantity AS BIGINT) AS b, CAST(l_linenumber > 3 AS INT) AS c, CAST(CAST(l_tax AS DECIMAL(10,2)) AS DOUBLE) AS d FROM lineitem", None),
    "safe_cast": ("SELECT SAFE_CAST(c_mktsegment AS INT) AS a, SAFE_CAST('12' AS INT) AS b, COUNT(*) AS n FROM customer GROUP BY SAFE_CAST(c_mktsegment AS INT)", "SELECT TRY_CAST(c_mktsegment AS INT) AS a, TRY_CAST('12' AS INT) AS b, COUNT(*) AS n FROM customer GROUP BY TRY_CAST(c_mktsegment AS INT)"),
    "cast_format": ("SELECT DISTINCT CAST(o_orderdate AS STRING FORMAT 'YYYY/MM/DD HH24:MI') AS s, CAST(' 2024-03-05 ' AS DATE FORMAT 'YYYY-MM-DD') AS d FROM orders", "SELECT DISTINCT strftime(o_orderdate, '%Y/%m/%d %H:%M') AS s, DATE '2024-03-05' AS d FROM orders"),
    "integer_division": ("SELECT l_orderkey, l_linenumber, l_orderkey / l_linenumber AS a, l_orderkey / (l_linenumber - 2) AS b, -l_orderkey * 3 / 2 AS c, l_orderkey % (l_linenumber - 1) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // l_linenumber AS a, CAST(trunc(l_orderkey / nullif(l_linenumber - 2, 0)) AS BIGINT) AS b, CAST(trunc(-l_orderkey * 3 / 2) AS BIGINT) AS c, l_orderkey % nullif(CAST(l_linenumber - 1 AS BIGINT), 0) AS d FROM lineitem"),
    "average_by_division": ("SELECT l_returnflag, SUM(l_linenumber) / COUNT(*) AS a, ROUND(SUM(l_quantity) / COUNT(*), 6) AS b FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(l_linenumber) // COUNT(*) AS BIGINT) AS a, ROUND(SUM(l_quantity) / COUNT(*), 6) AS b FROM lineitem GROUP BY l_returnflag"),
    "division_derived": ("SELECT d.k / d.n AS q, d.k % d.n AS r, d.s / d.n AS f FROM (SELECT l_orderkey AS k, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_orderkey) AS d", "SELECT d.k // d.n AS q, d.k % d.n AS r, CAST(d.s // d.n AS BIGINT) AS f FROM (SELECT l_orderkey AS k, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_orderkey) AS d"),
    "division_cte": ("WITH w AS (SELECT o_custkey AS c, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c / 7 AS b, SUM(n) / COUNT(*) AS n, ROUND(SUM(s / n), 2) AS s FROM w GROUP BY c / 7", "WITH w AS (SELECT o_custkey AS c, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c // 7 AS b, CAST(SUM(n) // COUNT(*) AS BIGINT) AS n, ROUND(SUM(s / n), 2) AS s FROM w GROUP BY c // 7"),
    "shifts_sql": ("SELECT l_orderkey, l_linenumber, l_orderkey << 70 AS a, l_linenumber >> 40 AS b, l_linenumber << l_linenumber AS c, (0 - l_orderkey) >> l_linenumber AS d, (0 - l_orderkey) >> 64 AS e, l_orderkey << l_linenumber - 8 AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(0 AS BIGINT) AS a, 0 AS b, CAST(l_linenumber << l_linenumber AS INTEGER) AS c, CAST(floor((0 - l_orderkey) / pow(2, l_linenumber)) AS BIGINT) AS d, CAST(CASE WHEN l_orderkey > 0 THEN -1 ELSE 0 END AS BIGINT) AS e, CAST(0 AS BIGINT) AS f FROM lineitem"),
    "date_trunc_sql": ("SELECT o_orderkey, DATE_TRUNC('month', o_orderdate) AS m, DATE_TRUNC('year', CAST(o_orderdate AS DATE)) AS y, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS n, o_orderdate - TIMESTAMP '1995-01-01 00:00:00' AS u FROM orders", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, CAST(date_trunc('year', CAST(o_orderdate AS DATE)) AS DATE) AS y, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS n, epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01') AS u FROM orders"),
    "join_using_sql": ("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) AS a LEFT JOIN (SELECT r_regionkey + 1 AS k, r_name FROM region) AS b USING (k)", 'SELECT a.k, n_name, b.k AS "right.k", r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) AS a LEFT JOIN (SELECT r_regionkey + 1 AS k, r_name FROM region) AS b ON a.k = b.k'),
    "join_natural_sql": ("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) AS a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) AS b WHERE k > 0", None),
    "grouping_id_subset": ("SELECT l_returnflag, l_linestatus, GROUPING_ID(l_linestatus) AS a, GROUPING_ID(l_linestatus, l_returnflag) AS b, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_linestatus) AS BIGINT) AS a, CAST(GROUPING_ID(l_linestatus, l_returnflag) AS BIGINT) AS b, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "union_coercion": ("SELECT l_linenumber AS v FROM lineitem UNION SELECT l_tax FROM lineitem", None),
    "recursive_nonlinear_all_sql": ("WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_regionkey + 100 AS dst FROM nation UNION ALL SELECT r_regionkey + 100, 1000 FROM region), r AS (SELECT src, dst FROM e UNION ALL SELECT a.src, b.dst FROM r AS a JOIN r AS b ON a.dst = b.src) SELECT src, dst FROM r", "WITH e AS (SELECT n_nationkey AS src, n_regionkey + 100 AS dst FROM nation UNION ALL SELECT r_regionkey + 100, 1000 FROM region) SELECT src, dst FROM e UNION ALL SELECT a.src, b.dst FROM e AS a JOIN e AS b ON a.dst = b.src"),
    "decimal_rounding": ("SELECT l_orderkey, l_linenumber, CAST(CAST(l_linenumber + 0.5 AS DECIMAL(10,0)) AS BIGINT) AS a, CAST(CAST(-0.5 - l_linenumber AS DECIMAL(10,0)) AS BIGINT) AS b, CAST(CAST(l_linenumber * 0.125 AS DECIMAL(10,2)) AS DOUBLE) AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(CAST(CAST(l_linenumber + 0.5 AS DOUBLE) AS DECIMAL(10,0)) AS BIGINT) AS a, CAST(CAST(CAST(-0.5 - l_linenumber AS DOUBLE) AS DECIMAL(10,0)) AS BIGINT) AS b, CAST(CAST(CAST(l_linenumber * 0.125 AS DOUBLE) AS DECIMAL(10,2)) AS DOUBLE) AS c FROM lineitem"),
    "strings_concat_functions": ("SELECT p_partkey, CONCAT(p_brand, '-', p_type) AS a, CONCAT_WS('-', p_brand, NULLIF(p_type, p_type), p_name) AS b FROM part", None),
    "initcap_sql": ("SELECT p_partkey, INITCAP(p_name || '-' || LOWER(p_type) || ' 7UP') AS s FROM part", r"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-' || lower(p_type) || ' 7UP', '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'), lambda w: upper(w[1]) || lower(w[2:])), '') AS s FROM part"),
    "bitwise": ("SELECT l_orderkey, l_linenumber, l_orderkey & 7 AS a, l_orderkey | 8 AS b FROM lineitem", None),
    "decimal_arithmetic": ("SELECT l_orderkey, l_linenumber, CAST(CAST(l_tax AS DECIMAL(10,2)) + CAST(l_discount AS DECIMAL(10,2)) * 2 AS DOUBLE) AS a, CAST(l_tax AS DECIMAL(10,2)) < CAST(l_discount AS DECIMAL(10,2)) AS b FROM lineitem", None),
    "strings_case": ("SELECT p_partkey, UPPER(p_name) AS a, LOWER(p_brand) AS b, REVERSE(p_type) AS c, REPLACE(p_name, 'a', 'xy') AS d FROM part", None),
    "strings_length": ("SELECT doc_id, LENGTH(text) AS a, OCTET_LENGTH(text) AS b FROM documents", "SELECT doc_id, LENGTH(text) AS a, strlen(text) AS b FROM documents"),
    "strings_substring": ("SELECT p_partkey, SUBSTRING(p_name, 2, 3) AS a, SUBSTRING(p_name, 0, 2) AS b, SUBSTRING(p_name FROM 3) AS c FROM part", "SELECT p_partkey, SUBSTRING(p_name, 2, 3) AS a, SUBSTRING(p_name, 1, 1) AS b, SUBSTRING(p_name, 3) AS c FROM part"),
    "strings_left_right": ("SELECT p_partkey, LEFT(p_name, 3) AS a, LEFT(p_name, -2) AS b, RIGHT(p_name, 3) AS c, RIGHT(p_name, -2) AS d FROM part", None),
    "strings_concat": ("SELECT p_partkey, p_brand || '-' || p_type AS a, p_brand || NULLIF(p_type, p_type) AS b FROM part", None),
    "strings_trim": ("SELECT p_partkey, TRIM('  ' || p_name || ' ') AS a, TRIM(LEADING 'B' FROM p_brand) AS b, LTRIM(' ' || p_name) AS c, RTRIM(p_name || ' ') AS d FROM part", "SELECT p_partkey, TRIM('  ' || p_name || ' ') AS a, LTRIM(p_brand, 'B') AS b, LTRIM(' ' || p_name) AS c, RTRIM(p_name || ' ') AS d FROM part"),
    "strings_position": ("SELECT p_partkey, POSITION('a' IN p_name) AS a, STRPOS(p_name, 'e') AS b FROM part", None),
    "strings_pad": ("SELECT p_partkey, LPAD(p_brand, 12, '*') AS a, RPAD(p_brand, 4, '-') AS b FROM part", None),
    "extract_parts": ("SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS d, EXTRACT(HOUR FROM o_orderdate) AS h, EXTRACT(MINUTE FROM o_orderdate) AS i, EXTRACT(SECOND FROM o_orderdate) AS s FROM orders", None),
    "temporal_filter": ("SELECT COUNT(*) AS n, MIN(o_orderdate) AS a, MAX(o_orderdate) AS z FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1997-06-30'", None),
    "date_interval": ("SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS d FROM orders"),
}


def _frames(spark: SparkSession, d: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{d}/{name}.parquet")


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        engine = Engine(spark)
        engine.register_parquet(d, [t for t in TABLES if t in text])
        return engine.sql(text)

    return run


TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _using(spark, d):
    t = _frames(spark, d)
    nation = t("nation").withColumnRenamed("n_regionkey", "regionkey")
    region = t("region").withColumnRenamed("r_regionkey", "regionkey")
    return rel.using(nation, region, ["regionkey"]).select("n_name", "r_name", F.col("`right.regionkey`").alias("right_regionkey"))


def _natural(spark, d):
    t = _frames(spark, d)
    return rel.natural(t("nation").select(F.col("n_regionkey").alias("k"), "n_name"), t("region").select(F.col("r_regionkey").alias("k"), "r_name")).select("k", "n_name", "r_name")


def _divide(spark, d):
    c = F.col
    return _frames(spark, d)("lineitem").select(
        "l_orderkey", "l_linenumber", fn.divide(c("l_orderkey"), (c("l_linenumber") - 2).cast("bigint"), True).alias("q"), fn.modulo(c("l_orderkey"), (c("l_linenumber") - 2).cast("bigint")).alias("r"),
        fn.divide(c("l_tax"), c("l_discount"), False).alias("f"),
    ).withColumn("kind", F.when(F.isnan("f"), "nan").when(F.col("f") == float("inf"), "inf").when(F.col("f") == float("-inf"), "-inf").otherwise("finite")).withColumn("f", F.when(F.col("kind") == "finite", F.round("f", 6)))


def _shift(spark, d):
    c = F.col
    return _frames(spark, d)("lineitem").select("l_orderkey", "l_linenumber", fn.shift_left(c("l_orderkey"), c("l_linenumber")).alias("a"), fn.shift_right(c("l_orderkey"), F.lit(70)).alias("b"), c("l_orderkey").bitwiseXOR(c("l_partkey")).alias("x"))


def _truncate(spark, d):
    c = F.col
    return _frames(spark, d)("orders").select("o_orderkey", fn.date_trunc("month", c("o_orderdate")).alias("m"), fn.date_trunc("year", c("o_orderdate").cast("date"), "date").alias("y"), fn.days_between(c("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("n"), fn.ticks_between(c("o_orderdate"), F.lit("1995-01-01").cast("timestamp_ntz")).alias("u"))


def _edges(spark, d):
    return _frames(spark, d)("nation").select(F.col("n_nationkey").cast("bigint").alias("src"), F.col("n_regionkey").cast("bigint").alias("dst"))


def _reach(spark, d):
    e = _edges(spark, d)
    return recursion.fixpoint(e, lambda new: new.alias("p").join(e.alias("e"), F.col("p.dst") == F.col("e.src")).select("p.src", "e.dst"))


def _closure(spark, d):
    e = _edges(spark, d)
    return recursion.naive(e, lambda p: p.alias("a").join(p.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst"), distinct=True)


def _parity(spark, d):
    one = spark.range(0, 1).select(F.col("id").alias("n"))
    found = recursion.mutual({"even": one, "odd": one.where("n > 0")}, {"even": lambda t: t["odd"].select(F.col("n") + 1).where("n < 60"), "odd": lambda t: t["even"].select((F.col("n") + 1).alias("n")).where("n < 60")})
    return found["even"].select(F.lit("even").alias("kind"), "n").unionAll(found["odd"].select(F.lit("odd").alias("kind"), "n"))


def _builder(spark, d):
    engine = Engine(spark).register_parquet(d, ["lineitem"])
    return Builder.scan(engine, "lineitem").filter(F.col("l_quantity") > 10).group_by("l_returnflag").agg(fn.count().alias("count"), fn.sum_(F.col("l_linenumber")).alias("sum_l_linenumber"), fn.max_(F.col("l_tax")).alias("max_l_tax")).into_plan()


def _plan(spark, d):
    read = {"rel": "read", "table": "orders", "columns": ["o_orderkey", "o_custkey", "o_totalprice"]}
    kept = {"rel": "filter", "input": read, "condition": {"call": "gt", "args": [{"field": 2}, {"literal": 100000, "type": "fp64"}]}}
    joined = {"rel": "join", "how": "inner", "left": kept, "right": {"rel": "read", "table": "customer", "columns": ["c_custkey", "c_mktsegment"]}, "on": {"call": "equal", "args": [{"field": 1}, {"field": 3}]}}
    grouped = {"rel": "aggregate", "input": joined, "keys": [4], "measures": [["n", "count", None], ["top", "max", {"field": 2}]]}
    return ingest.to_frame({"rel": "sort", "input": grouped, "by": [[0, "asc", "first"]]}, _frames(spark, d))


def _substrait(spark, d):
    field = lambda k: {"selection": {"directReference": {"structField": {"field": k}}, "rootReference": {}}}
    call = lambda f, *args: {"functionReference": f, "arguments": [{"value": a} for a in args]}
    read = lambda t, *names, **more: {"read": {"baseSchema": {"names": names}, "namedTable": {"names": [t]}, **more}}
    orders = read("orders", "o_custkey", "o_totalprice", filter={"scalarFunction": call(1, field(1), {"literal": {"fp64": 100000.0}})})
    joined = {"join": {"left": orders, "right": read("customer", "c_custkey", "c_mktsegment"), "type": "JOIN_TYPE_LEFT", "expression": {"scalarFunction": call(2, field(0), field(2))}}}
    grouped = {"aggregate": {"input": joined, "groupings": [{"groupingExpressions": [field(3)]}], "measures": [{"measure": call(3)}, {"measure": call(4, field(1))}]}}
    functions = [{"extensionFunction": {"functionAnchor": k, "name": n}} for k, n in ((1, "gt:any_any"), (2, "equal:any_any"), (3, "count:"), (4, "min:fp64"))]
    return substrait.to_frame({"extensions": functions, "relations": [{"root": {"input": grouped, "names": ["c_mktsegment", "n", "least"]}}]}, _frames(spark, d))


def _batches(spark, d):
    engine, n = Engine(spark), _frames(spark, d)("nation")
    engine.register_table_stream_lazy("halves", n.schema, lambda: [n.where("n_nationkey < 12"), n.where("n_nationkey >= 12")])
    return engine.sql("SELECT n_regionkey, COUNT(*) AS n FROM halves GROUP BY n_regionkey")


def _append(spark, d):
    engine, r = Engine(spark), _frames(spark, d)("region")
    engine.replace_table("twice", r)
    engine.register_batch("twice", r)
    return engine.sql("SELECT r_name, COUNT(*) AS n FROM twice GROUP BY r_name")


def _files(spark, d):
    """orders in six files, of which a micro-batch takes two."""
    folder, orders = scratch(spark, "orders"), _frames(spark, d)("orders")
    orders.repartition(6, "o_orderkey").write.parquet(folder)
    return bounded.stream_files(spark, folder, orders.schema, files_a_batch=2)


def _stream(keys):
    def run(spark, d):
        aggregates = (F.count("*").alias("n"), F.sum("o_custkey").alias("s"), F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("z"))
        return bounded.aggregate(_files(spark, d), keys, *aggregates)

    return run


def _stream_rows(spark, d):
    kept = _files(spark, d).where("o_totalprice > 100000").select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"))
    return bounded.rows(kept, scratch(spark, "rows"), scratch(spark, "rows-state"))


def _eager(spark, d):
    engine, n = Engine(spark), _frames(spark, d)("nation")
    engine.register_table_stream("parts", n.schema, [n.where("n_nationkey < 5"), n.where("n_nationkey between 5 and 12"), n.where("n_nationkey > 12")])
    return engine.sql("SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS a FROM parts GROUP BY n_regionkey")


def _register(spark, d):
    engine, r = Engine(spark), _frames(spark, d)("region")
    engine.register_table("r", r.where("r_regionkey < 2"))
    engine.register_batch("r", r.where("r_regionkey >= 2").toArrow())
    return engine.sql("SELECT r_regionkey, r_name FROM r")


def _user_rewrite(spark, d):
    engine = Engine(spark).register_parquet(d, ["orders"])
    engine.with_rewrite(lambda df: df.where(F.col("o_totalprice") > 100000)).with_rewrite(lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return engine.sql("SELECT o_orderkey, o_totalprice FROM orders")


def _decimal_divide(spark, d):
    c = F.col
    q = fn.decimal_divide(c("l_quantity").cast("decimal(10,2)"), (c("l_linenumber") - 3).cast("decimal(10,2)"), 12, 2)
    return _frames(spark, d)("lineitem").select("l_orderkey", "l_linenumber", q.cast("double").alias("q"))


def _wrapping(spark, d):
    big, c = F.lit(2**63 - 5), F.col
    t = _frames(spark, d)("lineitem")
    return t.select(
        "l_orderkey", "l_linenumber", fn.wrapping("+", c("l_orderkey"), big).alias("a"), fn.wrapping("-", -c("l_orderkey"), big).alias("b"),
        fn.wrapping("*", c("l_orderkey") * 1_000_000_007, c("l_partkey") * 998_244_353).alias("c"), fn.wrapping("+", c("l_linenumber"), F.lit(2**31 - 3), "int").alias("d"),
    )


def _builder_spread(spark, d):
    engine = Engine(spark).register_parquet(d, ["lineitem"])
    q = F.col("l_quantity")
    made = [F.round(f(q), 6).alias(n) for n, f in (("vp", fn.var_pop), ("vs", fn.var_samp), ("sp", fn.stddev_pop), ("ss", fn.stddev_samp))]
    return Builder.scan(engine, "lineitem").group_by("l_linestatus").agg(*made).into_plan()


def _bools(spark, d):
    b = F.col("l_quantity") > 25
    return _frames(spark, d)("lineitem").groupBy("l_returnflag").agg(fn.sum_(b, "boolean").alias("s"), F.round(fn.avg(b, "boolean"), 8).alias("m"), fn.min_(b).alias("a"))


def _initcap(spark, d):
    return _frames(spark, d)("part").select("p_partkey", fn.initcap(F.concat_ws("-", "p_name", F.lower("p_type"))).alias("s"))


#: Two's complement of 64 and of 32 bits, in DuckDB's 128-bit integers.
_WRAP = "CAST(((({}) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS BIGINT)"
_K, _P = "CAST(l_orderkey AS HUGEINT)", "CAST(l_partkey AS HUGEINT)"
WRAPPED = (
    f"SELECT l_orderkey, l_linenumber, {_WRAP.format(_K + ' + 9223372036854775803')} AS a, {_WRAP.format('-' + _K + ' - 9223372036854775803')} AS b, "
    f"{_WRAP.format(f'({_K} * 1000000007) * ({_P} * 998244353)')} AS c, CAST((CAST(l_linenumber AS BIGINT) + 2147483645 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS d FROM lineitem"
)

PLAIN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "join_using": (_using, "SELECT n_name, r_name, r_regionkey AS right_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_natural": (_natural, "SELECT n_regionkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "divide_modulo": (_divide, "SELECT l_orderkey, l_linenumber, CAST(trunc(l_orderkey / nullif(l_linenumber - 2, 0)) AS BIGINT) AS q, l_orderkey % nullif(CAST(l_linenumber - 2 AS BIGINT), 0) AS r, round(l_tax / nullif(l_discount, 0), 6) AS f, CASE WHEN l_discount <> 0 THEN 'finite' WHEN l_tax = 0 THEN 'nan' ELSE 'inf' END AS kind FROM lineitem"),
    "shifts_xor": (_shift, "SELECT l_orderkey, l_linenumber, l_orderkey << l_linenumber AS a, CAST(0 AS BIGINT) AS b, xor(l_orderkey, l_partkey) AS x FROM lineitem"),
    "date_trunc_difference": (_truncate, "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, CAST(date_trunc('year', CAST(o_orderdate AS DATE)) AS DATE) AS y, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS n, epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01') AS u FROM orders"),
    "recursive_union": (_reach, "WITH RECURSIVE r AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst FROM nation UNION SELECT r.src, CAST(n_regionkey AS BIGINT) FROM r JOIN nation ON r.dst = n_nationkey) SELECT * FROM r"),
    "recursive_nonlinear": (_closure, "WITH RECURSIVE r AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst FROM nation UNION SELECT r.src, CAST(n_regionkey AS BIGINT) FROM r JOIN nation ON r.dst = n_nationkey) SELECT * FROM r"),
    "recursive_mutual": (_parity, "SELECT CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, n FROM (SELECT generate_series AS n FROM generate_series(0, 60))"),
    "builder": (_builder, 'SELECT l_returnflag, COUNT(*) AS "count", CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber, MAX(l_tax) AS max_l_tax FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag'),
    "plan_ingestion": (_plan, "SELECT c_mktsegment, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment"),
    "substrait_plan": (_substrait, "SELECT c_mktsegment, COUNT(*) AS n, MIN(o_totalprice) AS least FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment"),
    "lazy_batches": (_batches, "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey"),
    "append_batch": (_append, "SELECT r_name, CAST(2 AS BIGINT) AS n FROM region"),
    "stream_scalar": (_stream([]), "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_totalprice) AS a, MAX(o_totalprice) AS z FROM orders"),
    "stream_grouped": (_stream(["o_orderstatus"]), "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_totalprice) AS a, MAX(o_totalprice) AS z FROM orders GROUP BY o_orderstatus"),
    "boolean_aggregates": (_bools, "SELECT l_returnflag, CAST(SUM(CAST(l_quantity > 25 AS INT)) AS BIGINT) AS s, round(AVG(CAST(l_quantity > 25 AS INT)), 8) AS m, MIN(l_quantity > 25) AS a FROM lineitem GROUP BY l_returnflag"),
    "initcap": (_initcap, r"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(concat_ws('-', p_name, lower(p_type)), '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'), lambda w: upper(w[1]) || lower(w[2:])), '') AS s FROM part"),
    "stream_rows": (_stream_rows, "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000"),
    "eager_batches": (_eager, "SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS a FROM nation GROUP BY n_regionkey"),
    "register_batch": (_register, "SELECT r_regionkey, r_name FROM region"),
    "user_rewrite": (_user_rewrite, "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_totalprice > 100000"),
    "decimal_division": (_decimal_divide, "SELECT l_orderkey, l_linenumber, trunc(l_quantity * 100 / nullif(l_linenumber - 3, 0)) / 100 AS q FROM lineitem"),
    "wrapping_arithmetic": (_wrapping, WRAPPED),
    "builder_spread": (_builder_spread, "SELECT l_linestatus, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(VAR_SAMP(l_quantity), 6) AS vs, ROUND(STDDEV_POP(l_quantity), 6) AS sp, ROUND(STDDEV_SAMP(l_quantity), 6) AS ss FROM lineitem GROUP BY l_linestatus"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _sql(v[0]) for k, v in SQL.items()} | {k: v[0] for k, v in PLAIN.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] or v[0] for k, v in SQL.items()} | {k: v[1] for k, v in PLAIN.items() if v[1]}
