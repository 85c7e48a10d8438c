"""Substrait plans in their JSON form to DataFrames.

Relations: read of a named table, filter, project, aggregate, sort, fetch and inner or outer join, each
with its output mapping. Fields count by position, so columns carry names of their own until the root
names them; equal names on both sides of a join, and a table joined to itself, do no harm.
"""

from __future__ import annotations

import base64
import datetime
import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.errors import PlanError, TypeMismatch, Unsupported
from orrery.plans import ingest

#: Fixed values of the format.
JOIN_TYPES = {"JOIN_TYPE_INNER": "inner", "JOIN_TYPE_LEFT": "left", "JOIN_TYPE_RIGHT": "right", "JOIN_TYPE_OUTER": "full"}
DIRECTIONS = {
    "SORT_DIRECTION_ASC_NULLS_FIRST": "asc_nulls_first", "SORT_DIRECTION_ASC_NULLS_LAST": "asc_nulls_last",
    "SORT_DIRECTION_DESC_NULLS_FIRST": "desc_nulls_first", "SORT_DIRECTION_DESC_NULLS_LAST": "desc_nulls_last",
}
KINDS = {"bool": "boolean", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "fp32": "float", "fp64": "double", "string": "string", "varchar": "string", "fixedChar": "string", "date": "date", "timestamp": "timestamp_ntz", "timestampTz": "timestamp"}
PHASES = {None, "AGGREGATION_PHASE_UNSPECIFIED", "AGGREGATION_PHASE_INITIAL_TO_RESULT"}
INVOCATIONS = {None, "AGGREGATION_INVOCATION_UNSPECIFIED", "AGGREGATION_INVOCATION_ALL"}


def the_one(node: dict, what: str, beside: tuple[str, ...] = ()) -> tuple[str, object]:
    """The only member of a choice."""
    found = [(k, v) for k, v in node.items() if k not in beside]
    if len(found) != 1:
        raise PlanError(f"{what} has {len(found)} kinds")
    return found[0]


def type_name(node: dict) -> str:
    """Spark's name of a type."""
    kind, detail = the_one(node, "a type")
    if kind == "decimal":
        return f"decimal({detail['precision']},{detail.get('scale', 0)})"
    if kind not in KINDS:
        raise Unsupported(f"type {kind}")
    return KINDS[kind]


def literal(node: dict) -> Column:
    kind, value = the_one(node, "a literal", ("nullable", "typeVariationReference"))
    if kind == "null":
        return F.lit(None).cast(type_name(value))
    epoch = datetime.datetime(1970, 1, 1)
    if kind == "boolean":
        return F.lit(bool(value))
    if kind == "date":
        return F.lit((epoch + datetime.timedelta(days=int(value))).date())
    if kind in ("timestamp", "timestampTz"):
        text = (epoch + datetime.timedelta(microseconds=int(value))).isoformat(sep=" ")
        return F.lit(text + "+00:00" if kind == "timestampTz" else text).cast(KINDS[kind])
    if kind == "decimal":
        unscaled, scale = int.from_bytes(base64.b64decode(value["value"]), "little", signed=True), value.get("scale", 0)
        digits = str(abs(unscaled)).rjust(scale + 1, "0")
        text = ("-" if unscaled < 0 else "") + digits[: len(digits) - scale] + ("." + digits[-scale:] if scale else "")
        return F.lit(text).cast(f"decimal({value['precision']},{scale})")
    if kind == "varChar":
        return F.lit(value["value"])
    if kind in ("string", "fixedChar"):
        return F.lit(value)
    if kind in ("fp32", "fp64"):
        return F.lit(float(value)).cast(KINDS[kind])
    if kind in ("i8", "i16", "i32", "i64"):
        return F.lit(int(value)).cast(KINDS[kind])
    raise Unsupported(f"literal {kind}")


class Reader:
    """One plan's functions and tables."""

    def __init__(self, plan: dict, table: Callable[[str], DataFrame]):
        self.table, self.fresh = table, itertools.count()
        made = [e["extensionFunction"] for e in plan.get("extensions", []) if "extensionFunction" in e]
        self.functions = {e.get("functionAnchor", 0): e["name"].split(":")[0] for e in made}

    def function(self, node: dict) -> str:
        anchor = node.get("functionReference", 0)
        if anchor not in self.functions:
            raise PlanError(f"no function {anchor}")
        return self.functions[anchor]

    def named(self, df: DataFrame) -> DataFrame:
        return df.toDF(*(f"_{next(self.fresh)}" for _ in df.columns))

    def expression(self, node: dict, df: DataFrame) -> Column:
        kind, e = the_one(node, "an expression")
        go = lambda x: self.expression(x, df)
        if kind == "literal":
            return literal(e)
        if kind == "selection":
            at = e.get("directReference", {}).get("structField")
            if at is None or "child" in at or "outerReference" in e or "expression" in e:
                raise Unsupported("only fields of the input are selected")
            k = at.get("field", 0)
            if not 0 <= k < len(df.columns):
                raise PlanError(f"no field {k}")
            return F.col(df.columns[k])
        if kind == "cast":
            if e.get("failureBehavior") == "FAILURE_BEHAVIOR_RETURN_NULL":
                return go(e["input"]).try_cast(type_name(e["type"]))
            return go(e["input"]).cast(type_name(e["type"]))
        if kind in ("ifThen", "switchExpression"):
            test = (lambda x: go(x["if"])) if kind == "ifThen" else (lambda x: go(e["match"]) == literal(x["if"]))
            out = go(e["else"]) if "else" in e else F.lit(None)
            for x in reversed(e["ifs"]):
                out = F.when(test(x), go(x["then"])).otherwise(out)
            return out
        if kind == "scalarFunction":
            return self.call(e, df)
        raise Unsupported(f"expression {kind}")

    def call(self, e: dict, df: DataFrame) -> Column:
        name, nodes = self.function(e), [a.get("value") for a in e.get("arguments", [])]
        if None in nodes:
            raise Unsupported(f"{name} with an argument that isn't a value")
        if name == "like":
            pattern = nodes[1].get("literal", {}).get("string") if len(nodes) == 2 else None
            if pattern is None:
                raise Unsupported("LIKE takes a constant pattern")
            return ingest.apply(name, [self.expression(nodes[0], df), pattern], df)
        return ingest.apply(name, [self.expression(x, df) for x in nodes], df)

    def relation(self, node: dict) -> DataFrame:
        kind, rel = the_one(node, "a relation")
        if not hasattr(self, f"_{kind}"):
            raise Unsupported(f"relation {kind}")
        df = getattr(self, f"_{kind}")(rel)
        emit = rel.get("common", {}).get("emit")
        if emit is None:
            return df
        chosen = emit.get("outputMapping", [])
        if not chosen or not all(0 <= k < len(df.columns) for k in chosen):
            raise PlanError(f"output mapping {chosen} of {len(df.columns)} columns")
        return df.select(*(F.col(df.columns[k]).alias(f"_{next(self.fresh)}") for k in chosen))

    def _read(self, rel: dict) -> DataFrame:
        if "namedTable" not in rel:
            raise Unsupported("only named tables are read")
        shape = rel["baseSchema"]
        df = self.table(".".join(rel["namedTable"]["names"]))
        missing = [n for n in shape["names"] if n not in df.columns]
        if missing:
            raise PlanError(f"no column {missing[0]}")
        df = df.select(*(F.col(f"`{n}`") for n in shape["names"]))
        for n, t in zip(shape["names"], shape.get("struct", {}).get("types", []), strict=False):
            if df.schema[n].dataType.simpleString() != type_name(t):
                raise TypeMismatch(f"{n} is {df.schema[n].dataType.simpleString()}, not {type_name(t)}")
        df = self.named(df)
        if "filter" in rel:
            df = df.where(self.expression(rel["filter"], df))
        if "projection" in rel:
            items = rel["projection"]["select"]["structItems"]
            df = df.select(*(df.columns[x.get("field", 0)] for x in items))
        return df

    def _filter(self, rel: dict) -> DataFrame:
        df = self.relation(rel["input"])
        return df.where(self.expression(rel["condition"], df))

    def _project(self, rel: dict) -> DataFrame:
        df = self.relation(rel["input"])
        return df.select("*", *(self.expression(e, df).alias(f"_{next(self.fresh)}") for e in rel["expressions"]))

    def _aggregate(self, rel: dict) -> DataFrame:
        df = self.relation(rel["input"])
        sets = rel.get("groupings", [])
        if len(sets) > 1:
            raise Unsupported("several grouping sets")
        keys = []
        if sets:
            shared = rel.get("groupingExpressions", [])
            keys = [shared[k] for k in sets[0]["expressionReferences"]] if "expressionReferences" in sets[0] else sets[0].get("groupingExpressions", [])
        measures = [self.measure(m, df) for m in rel.get("measures", [])]
        if not measures and not keys:
            raise PlanError("an aggregate of nothing")
        grouping = [self.expression(k, df).alias(f"_{next(self.fresh)}") for k in keys]
        return df.groupBy(*grouping).agg(*measures) if measures else df.select(*grouping).distinct()

    def measure(self, node: dict, df: DataFrame) -> Column:
        m = node["measure"]
        if "filter" in node or m.get("sorts") or m.get("invocation") not in INVOCATIONS or m.get("phase") not in PHASES:
            raise Unsupported("measures with a filter, an order, DISTINCT or a partial phase")
        name, args = self.function(m), m.get("arguments", [])
        if name not in ingest.MEASURES:
            raise Unsupported(f"measure {name}")
        if len(args) != 1 and not (name == "count" and not args):
            raise PlanError(f"{name} of {len(args)} arguments")
        return ingest.MEASURES[name](self.expression(args[0]["value"], df) if args else F.lit(1)).alias(f"_{next(self.fresh)}")

    def _sort(self, rel: dict) -> DataFrame:
        df = self.relation(rel["input"])
        order = []
        for s in rel["sorts"]:
            if s.get("direction") not in DIRECTIONS:
                raise Unsupported(f"sort direction {s.get('direction')}")
            order.append(getattr(self.expression(s["expr"], df), DIRECTIONS[s["direction"]])())
        return df.orderBy(*order)

    def _fetch(self, rel: dict) -> DataFrame:
        df = self.relation(rel["input"]).offset(int(rel.get("offset", 0)))
        count = int(rel.get("count", -1))  # -1 stands for all
        return df if count == -1 else df.limit(count)

    def _join(self, rel: dict) -> DataFrame:
        if rel.get("type") not in JOIN_TYPES:
            raise Unsupported(f"join {rel.get('type')}")
        left, right = self.relation(rel["left"]), self.relation(rel["right"])
        if "expression" not in rel:
            raise PlanError("a join without a condition")
        # An empty frame of both sides' columns gives the condition's fields their places.
        both = left.limit(0).crossJoin(right.limit(0))
        found = left.join(right, self.expression(rel["expression"], both), JOIN_TYPES[rel["type"]])
        return found.where(self.expression(rel["postJoinFilter"], found)) if "postJoinFilter" in rel else found


def to_frame(plan: str | dict, table: Callable[[str], DataFrame]) -> DataFrame:
    """The DataFrame of a plan with one relation, its columns named by the root where there is one."""
    plan = json.loads(plan) if isinstance(plan, str) else plan
    if plan.get("version", {}).get("majorNumber", 0):
        raise Unsupported(f"version {plan['version']['majorNumber']}")
    relations = plan.get("relations", [])
    if not relations:
        raise PlanError("a plan without relations")
    if len(relations) > 1:
        raise Unsupported("several relations")
    reader = Reader(plan, table)
    kind, root = the_one(relations[0], "the plan's relation")
    df = reader.relation(root["input"] if kind == "root" else root)
    names = root.get("names", []) if kind == "root" else []
    if names and len(names) != len(df.columns):
        raise PlanError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names) if names else df
