"""Substrait plans in JSON against SQL over the same tables."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from orrery.errors import PlanError, TypeMismatch, Unsupported
from orrery.plans import ingest, substrait
from tests.harness import DATA, duck, duck_rows, spark_rows

NAMES = ["equal:any_any", "gt:any_any", "multiply:fp64_fp64", "sum:fp64", "count:", "max:i64", "divide:i64_i64", "like:str_str", "concat:str_str", "and:bool", "not:bool", "avg:fp64"]
EXTENSIONS = [{"extensionFunction": {"extensionUriReference": 1, "functionAnchor": k, "name": n}} for k, n in enumerate(NAMES)]
AT = {n.split(":")[0]: k for k, n in enumerate(NAMES)}
TYPE = {"int": "i32", "bigint": "i64", "double": "fp64", "string": "string", "timestamp_ntz": "timestamp"}


def field(k):
    return {"selection": {"directReference": {"structField": {"field": k} if k else {}}, "rootReference": {}}}


def call(name, *args):
    return {"scalarFunction": {"functionReference": AT[name], "arguments": [{"value": a} for a in args]}}


def measure(name, *args, **more):
    return {"measure": {"functionReference": AT[name], "arguments": [{"value": a} for a in args], **more}}


def lit(**kind):
    return {"literal": kind}


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


def read(table, name, **more):
    schema = table(name).dtypes
    return {"read": {"baseSchema": {"names": [c for c, _ in schema], "struct": {"types": [{TYPE[t]: {}} for _, t in schema]}}, "namedTable": {"names": [name]}, **more}}


def plan(rel, names):
    return {"extensions": EXTENSIONS, "relations": [{"root": {"input": rel, "names": names}}]}


def same(table, rel, names, sql):
    got = substrait.to_frame(json.dumps(plan(rel, names)), table)
    assert spark_rows(got) == duck_rows(duck(), sql)


def test_join_filter_aggregate_sort_fetch(table):
    orders, customer = read(table, "orders"), read(table, "customer", filter=call("gt", field(3), lit(fp64=0.0)))
    joined = {"join": {"left": orders, "right": customer, "type": "JOIN_TYPE_INNER", "expression": call("equal", field(1), field(6))}}
    kept = {"filter": {"input": joined, "condition": call("and", call("gt", field(3), lit(fp64=1000.0)), call("not", call("like", field(5), lit(string="1%"))))}}
    made = {"project": {"common": {"emit": {"outputMapping": [10, 11, 0]}}, "input": kept, "expressions": [call("multiply", field(3), lit(fp64=2.0))]}}
    grouped = {"aggregate": {"input": made, "groupings": [{"groupingExpressions": [field(0)]}], "measures": [measure("count"), measure("max", field(2)), measure("avg", field(1))]}}
    ordered = {"fetch": {"input": {"sort": {"input": grouped, "sorts": [{"expr": field(0), "direction": "SORT_DIRECTION_ASC_NULLS_FIRST"}]}}, "offset": "1", "count": "3"}}
    same(table, ordered, ["seg", "n", "top", "mean"], """SELECT c_mktsegment AS seg, COUNT(*) AS n, MAX(o_orderkey) AS top, AVG(o_totalprice * 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_acctbal > 0 AND o_totalprice > 1000 AND o_orderpriority NOT LIKE '1%' GROUP BY 1 ORDER BY 1 LIMIT 3 OFFSET 1""")  # fmt: skip


@pytest.mark.parametrize("kind,word", [("INNER", ""), ("LEFT", "LEFT"), ("RIGHT", "RIGHT"), ("OUTER", "FULL")])
def test_self_joins(table, kind, word):
    nation = read(table, "nation", projection={"select": {"structItems": [{}, {"field": 2}]}})
    joined = {"join": {"left": nation, "right": nation, "type": f"JOIN_TYPE_{kind}", "expression": call("equal", field(0), field(3))}}
    same(table, joined, ["a", "b", "c", "d"], f"SELECT x.n_nationkey AS a, x.n_regionkey AS b, y.n_nationkey AS c, y.n_regionkey AS d FROM nation AS x {word} JOIN nation AS y ON x.n_nationkey = y.n_regionkey")


def test_shared_groupings_and_scalars(table):
    rel = {"aggregate": {"input": read(table, "lineitem"), "groupingExpressions": [field(8), field(3)], "groupings": [{"expressionReferences": [1]}], "measures": [measure("sum", field(4))]}}
    same(table, rel, ["k", "s"], "SELECT l_linenumber AS k, SUM(l_quantity) AS s FROM lineitem GROUP BY 1")
    same(table, {"aggregate": {"input": read(table, "nation"), "measures": [measure("count")]}}, ["n"], "SELECT COUNT(*) AS n FROM nation")


def test_literals_and_conditionals(spark):
    decimal = {"decimal": {"value": base64.b64encode((-1205).to_bytes(16, "little", signed=True)).decode(), "precision": 10, "scale": 2}}
    values = [
        lit(**decimal), lit(date=19_000), lit(timestamp="1000001"), lit(null={"i64": {}}), lit(boolean=True), lit(varChar={"value": "x", "length": 3}),
        {"cast": {"type": {"i32": {}}, "input": lit(string="nope"), "failureBehavior": "FAILURE_BEHAVIOR_RETURN_NULL"}}, call("divide", lit(i64="7"), lit(i64="0")), call("concat", lit(string="a"), lit(string="b")),
        {"ifThen": {"ifs": [{"if": call("gt", field(0), lit(i64="1")), "then": lit(string="big")}], "else": lit(string="small")}},
        {"switchExpression": {"match": field(0), "ifs": [{"if": {"i64": "2"}, "then": lit(string="two")}]}},
    ]
    rel = {"project": {"input": {"read": {"baseSchema": {"names": ["a"]}, "namedTable": {"names": ["t"]}}}, "expressions": values}}
    df = spark.createDataFrame([(2,)], "a bigint")
    got = substrait.to_frame(plan(rel, [f"c{k}" for k in range(12)]), lambda _: df)
    kinds = [t for _, t in got.dtypes]
    assert kinds[1:5] == ["decimal(10,2)", "date", "timestamp_ntz", "bigint"]
    row = got.select(*(F.col(c).cast("string") for c in got.columns)).first()
    assert list(row) == ["2", "-12.05", "2022-01-08", "1970-01-01 00:00:01.000001", None, "true", "x", None, None, "ab", "big", "two"]


def test_refused(table):
    nation = read(table, "nation")
    bad = [
        ({"relations": []}, PlanError), ({"relations": [{"rel": nation}, {"rel": nation}]}, Unsupported), ({"version": {"majorNumber": 1}, "relations": [{"rel": nation}]}, Unsupported),
        (plan(nation, ["one"]), PlanError), (plan({"set": {}}, []), Unsupported), (plan({"filter": {"input": nation, "condition": field(9)}}, []), PlanError),
        (plan({"join": {"left": nation, "right": nation, "type": "JOIN_TYPE_LEFT_SEMI", "expression": lit(boolean=True)}}, []), Unsupported),
        (plan({"aggregate": {"input": nation, "measures": [measure("count", invocation="AGGREGATION_INVOCATION_DISTINCT")]}}, []), Unsupported),
        (plan({"project": {"input": nation, "expressions": [{"scalarFunction": {"functionReference": 99}}]}}, []), PlanError),
        (plan({"read": {**nation["read"], "common": {"emit": {"outputMapping": [7]}}}}, []), PlanError),
        (plan({"read": {"baseSchema": {"names": ["n_name"], "struct": {"types": [{"i64": {}}]}}, "namedTable": {"names": ["nation"]}}}, []), TypeMismatch),
    ]
    for p, error in bad:
        with pytest.raises(error):
            substrait.to_frame(p, table)


def test_own_plans_join_a_table_to_itself(spark):
    t = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    read_t = {"rel": "read", "table": "t"}
    p = {"rel": "join", "how": "inner", "left": read_t, "right": read_t, "on": {"call": "equal", "args": [{"field": 1}, {"field": 2}]}}
    found = ingest.to_frame({"rel": "filter", "input": p, "condition": {"call": "gt", "args": [{"field": 3}, {"literal": 0, "type": "i32"}]}}, lambda _: t)
    assert found.columns == ["a", "b", "right.a", "right.b"] and [tuple(r) for r in found.collect()] == [(1, 2, 2, 3)]
