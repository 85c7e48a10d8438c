"""Plans as JSON objects to DataFrames: read, filter, project, aggregate, sort, fetch, join.

An expression is {"field": n}, {"literal": v, "type": t} or {"call": name, "args": [..]}; relations
name their input by "input", joins by "left" and "right". Fields count over the input's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.errors import PlanError, Unsupported
from orrery.functions import scalar as S

TYPES = {
    "bool": "boolean", "i32": "int", "i64": "bigint", "fp32": "float", "fp64": "double", "string": "string", "varchar": "string",
    "fixedchar": "string", "date": "date", "timestamp": "timestamp_ntz", "timestamp_tz": "timestamp",
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b,
    "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b,
    "modulus": S.modulo, "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
}
JOINS = {"inner", "left", "right", "full"}
MEASURES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": lambda c: F.avg(c.cast("double"))}


def type_of(name: str) -> str:
    if name.startswith("decimal"):
        return name
    if name not in TYPES:
        raise Unsupported(f"type {name}")
    return TYPES[name]


def expression(e: dict, columns: list[Column], df: DataFrame) -> Column:
    go = lambda x: expression(x, columns, df)
    if "field" in e:
        if not 0 <= e["field"] < len(columns):
            raise PlanError(f"no field {e['field']}")
        return columns[e["field"]]
    if "literal" in e:
        return F.lit(e["literal"]).cast(type_of(e.get("type", "string")))
    name, args = e["call"], e.get("args", [])
    if name == "cast":
        return go(args[0]).cast(type_of(e["type"]))
    if name in ("if_then", "switch"):
        out = go(e["else"]) if "else" in e else F.lit(None)
        for when, then in reversed(e["cases"]):
            out = F.when(go(when) if name == "if_then" else go(args[0]) == go(when), go(then)).otherwise(out)
        return out
    if name == "like":
        return apply(name, [go(args[0]), args[1]["literal"]], df)
    return apply(name, list(map(go, args)), df)


def apply(name: str, args: list, df: DataFrame) -> Column:
    """A function by name over columns of ``df``; the pattern of "like" is its text."""
    if name in BINARY:
        first, *rest = args
        for r in rest:
            first = BINARY[name](first, r)
        return first
    if name == "divide":
        a, b = args
        kinds = [df.select(x.alias("x")).schema["x"].dataType.simpleString() for x in (a, b)]
        return S.divide(a, b, all(k in ("int", "bigint", "smallint", "tinyint") for k in kinds))
    if name in ("shift_left", "shift_right"):
        return getattr(S, name)(*args)
    if name == "not":
        return ~args[0]
    if name in ("is_null", "is_not_null"):
        return args[0].isNull() if name == "is_null" else args[0].isNotNull()
    if name == "like":
        return S.like(*args)
    if name in ("coalesce", "concat"):
        return getattr(F, name)(*args)
    raise Unsupported(f"function {name}")


def to_frame(plan: dict, table: Callable[[str], DataFrame]) -> DataFrame:
    kind = plan.get("rel")
    if kind == "read":
        df = table(plan["table"])
        return df.select(*plan["columns"]) if "columns" in plan else df
    if kind == "join":
        left, right, how = to_frame(plan["left"], table), to_frame(plan["right"], table), plan["how"]
        if how not in JOINS:
            raise Unsupported(f"{how} join")
        # Names of their own on both sides, so that equal ones and a table joined to itself do no harm.
        names = list(left.columns)
        for c in right.columns:
            name, k = c if c not in names else f"right.{c}", 2
            while name in names:
                name, k = f"right.{c}__{k}", k + 1
            names.append(name)
        places = [f"_{k}" for k in range(len(names))]
        left, right = left.toDF(*places[: len(left.columns)]), right.toDF(*places[len(left.columns) :])
        both = left.limit(0).crossJoin(right.limit(0))
        return left.join(right, expression(plan["on"], [F.col(p) for p in places], both), how).toDF(*names)
    if kind not in ("filter", "project", "aggregate", "sort", "fetch"):
        raise Unsupported(f"relation {kind}")
    df = to_frame(plan["input"], table)
    columns = [df[f"`{c}`"] for c in df.columns]
    if kind == "filter":
        return df.where(expression(plan["condition"], columns, df))
    if kind == "project":
        return df.select(*(expression(e, columns, df).alias(n) for n, e in plan["expressions"]))
    if kind == "aggregate":
        measures = [MEASURES[m](expression(e, columns, df) if e else F.lit(1)).alias(n) for n, m, e in plan["measures"]]
        return df.groupBy(*(columns[k] for k in plan.get("keys", []))).agg(*measures)
    if kind == "sort":
        return df.orderBy(*(getattr(columns[k], f"{d}_nulls_{n}")() for k, d, n in plan["by"]))
    return df.offset(plan.get("offset", 0)).limit(plan["count"])
