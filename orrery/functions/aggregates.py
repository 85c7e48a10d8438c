"""Aggregates by the engine's result types; the builder's default names are sum_x, count_x and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(column: Column | None = None) -> Column:
    return F.count(F.lit(1) if column is None else column)


def count_distinct(column: Column) -> Column:
    return F.count_distinct(column)


def sum_(column: Column, kind: str | None = None) -> Column:
    """Booleans count; a FLOAT sum stays FLOAT, a decimal one has precision 38."""
    if kind == "boolean":
        return F.sum(column.cast("bigint"))
    if kind == "float":
        return F.sum(column).cast("float")
    if kind and kind.startswith("decimal"):
        return F.sum(column.cast("decimal(38," + kind.split(",")[1]))
    return F.sum(column)


def avg(column: Column, kind: str | None = None) -> Column:
    return F.avg(column.cast("int").cast("double") if kind == "boolean" else column.cast("double"))


def min_(column: Column) -> Column:
    return F.min(column)


def max_(column: Column) -> Column:
    return F.max(column)


var_pop, var_samp, stddev_pop, stddev_samp = F.var_pop, F.var_samp, F.stddev_pop, F.stddev_samp


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
