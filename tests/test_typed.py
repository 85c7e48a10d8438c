"""Operators by their operands' types, through derived tables, common table expressions and joins."""

import datetime

import pytest

from orrery.errors import CapExceeded, PlanError
from orrery.plans.rewrite import rewrite
from orrery.sources.engine import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register_table("t", spark.sql("SELECT 7 AS k, 2 AS n, CAST(-9 AS BIGINT) AS b, 1.5D AS x, DATE '2024-03-05' AS d, TIMESTAMP_NTZ '2024-03-05 10:20:30' AS ts"))
    e.register_table("u", spark.sql("SELECT * FROM VALUES (7, 'seven'), (8, 'eight') AS u(k, name)"))
    return e


def one(df):
    return tuple(df.first())


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT d.k / d.n FROM (SELECT k, n FROM t) AS d", (3,)),
        ("SELECT a / c, a % c, a / 0 FROM (SELECT SUM(k) AS a, COUNT(*) + 1 AS c FROM t) AS d", (3, 1, None)),
        ("WITH w AS (SELECT k AS p, n AS q FROM t), v AS (SELECT p / q AS r FROM w) SELECT r / 2 FROM v", (1,)),
        ("SELECT s / z FROM (SELECT x AS s, 0 AS z FROM t) AS d", (float("inf"),)),
        ("SELECT (SELECT MAX(k) FROM t) / 2 FROM t", (3,)),
        ("SELECT a / 2 FROM (SELECT 7 AS a UNION ALL SELECT 9) AS d ORDER BY 1", (3,)),
        ("SELECT k << 70, k << 1, b >> 70, b >> 1, k >> 40, k << -1, CAST(k AS BIGINT) << 33 FROM t", (0, 14, -1, -5, 0, 0, 7 << 33)),
        ("SELECT k << 1 + 1, 1 << n << 1, (k + 1) >> 1 FROM t", (28, 8, 4)),
        ("SELECT DATE_TRUNC('month', d), DATE_TRUNC('hour', ts), DATE_TRUNC('year', z) FROM (SELECT d, ts, d AS z FROM t) AS q", (datetime.date(2024, 3, 1), datetime.datetime(2024, 3, 5, 10), datetime.date(2024, 1, 1))),
        ("SELECT d - DATE '2024-03-01', ts - TIMESTAMP_NTZ '2024-03-05 10:20:29', d - CAST('2024-02-01' AS DATE) FROM t", (4, 1_000_000, 33)),
        ("SELECT d - INTERVAL 1 DAY, k - n, -k - -n FROM t", (datetime.date(2024, 3, 4), 5, -5)),
        ("SELECT * FROM t JOIN u USING (k)", (7, 2, -9, 1.5, datetime.date(2024, 3, 5), datetime.datetime(2024, 3, 5, 10, 20, 30), 7, "seven")),
        ("SELECT k, name FROM t NATURAL JOIN u WHERE k > 1 ORDER BY k", (7, "seven")),
        ("SELECT COUNT(*), COUNT(k) FROM t RIGHT JOIN u USING (k)", (2, 1)),
        ("SELECT k, c.z FROM t JOIN u USING (k) JOIN (SELECT 7 AS k, 'z' AS z) AS c USING (k)", (7, "z")),
        ("SELECT LPAD(name, 6, '*'), RPAD(name, LENGTH(name) + 1, '-') FROM u ORDER BY 1", ("*eight", "eight-")),
    ],
)
def test_values(engine, sql, want):
    assert one(engine.sql(sql)) == want


def test_both_sides_keep_their_names(engine):
    assert engine.sql("SELECT * FROM t JOIN u USING (k)").columns == ["k", "n", "b", "x", "d", "ts", "right.k", "name"]


@pytest.mark.parametrize("sql", ["SELECT 1 FROM t JOIN u USING (n)", "SELECT 1 FROM u NATURAL JOIN (SELECT 1 AS z) AS q", "SELECT 1 FROM t JOIN u ON t.k = u.k JOIN (SELECT 7 AS k) AS c USING (k)"])
def test_names_that_do_not_join(engine, sql):
    with pytest.raises(PlanError):
        engine.sql(sql)


def test_grouping_id_of_some_keys(engine):
    found = engine.sql("SELECT n, k, GROUPING_ID(n) AS a, GROUPING_ID(n, k) AS b, COUNT(*) AS c FROM t GROUP BY CUBE (k, n)").collect()
    assert sorted((r.a, r.b, r.n, r.k) for r in found) == sorted([(0, 0, 2, 7), (0, 1, 2, None), (1, 2, None, 7), (1, 3, None, None)])


@pytest.mark.parametrize("sql", ["SELECT LPAD('a', 1048577, 'b')", "SELECT RPAD('a', 99999999, 'b')"])
def test_padding_is_capped(sql):
    with pytest.raises(CapExceeded):
        rewrite(sql)


def test_padding_of_a_column_is_capped(engine):
    with pytest.raises(Exception, match="padding"):
        engine.sql("SELECT LPAD(name, k * 1000000, 'b') FROM u").collect()
