"""Joins with kept sides, DISTINCT ON, deduplicated grouping sets, TOTALS."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.errors import PlanError, TypeMismatch, Unsupported

JOINS = {"inner", "left", "right", "full", "cross"}


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] = (), how: str = "inner", where: Column | None = None) -> DataFrame:
    """Equi-join on pairs of names, both sides kept: a right column whose name is taken becomes right.c, then right.c__2.

    Keys must have one type. ``where`` (over the output's names) makes an inner or cross join a theta join.
    """
    if how not in JOINS:
        raise Unsupported(f"{how} join")
    taken, names = set(left.columns), {}
    for c in right.columns:
        name, n = c, 1
        while name in taken:
            name, n = f"right.{c}" + (f"__{n}" if n > 1 else ""), n + 1
        taken.add(name)
        names[c] = name
    for a, b in on:
        if a not in left.columns or b not in right.columns:
            raise PlanError(f"no key {a} = {b}")
        if left.schema[a].dataType != right.schema[b].dataType:
            raise TypeMismatch(f"{a} is {left.schema[a].dataType.simpleString()}, {b} is {right.schema[b].dataType.simpleString()}")
    other = right.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    if on:
        keys = reduce(lambda x, y: x & y, (left[f"`{a}`"] == other[f"`{names[b]}`"] for a, b in on))
        found = left.join(other, keys, how)
    else:
        if how not in ("inner", "cross"):
            raise Unsupported("outer joins need equal keys")
        found = left.crossJoin(other)
    return found.where(where) if where is not None else found


def using(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    return join(left, right, [(n, n) for n in names], how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise PlanError("no common column")
    return using(left, right, shared, how)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).where("__row = 1").drop("__row")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """One pass over the rows for all sets; a set given twice counts once."""
    unique = list(dict.fromkeys(tuple(sorted(s)) for s in sets))
    keys = list(dict.fromkeys(k for s in sets for k in s))
    if len(keys) > 12:
        raise Unsupported("more than 12 grouping columns")
    return df.groupingSets([[F.col(k) for k in s] for s in unique], *(F.col(k) for k in keys)).agg(*aggregates)


def with_totals(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return grouping_sets(df, [keys, []], *aggregates)


def exists(outer: DataFrame, inner: DataFrame, on: Column, negated: bool = False) -> DataFrame:
    """Correlated [NOT] EXISTS as a semi or anti join."""
    return outer.join(inner, on, "left_anti" if negated else "left_semi")
