"""The lazy builder: scan, filter, select, group_by, agg; a bad name is kept and raised at schema() or collect()."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.errors import PlanError
from orrery.sources.engine import Engine


class Builder:
    def __init__(self, frame: DataFrame | None, error: str | None = None):
        self._frame, self._error = frame, error

    @staticmethod
    def scan(engine: Engine, name: str, columns: list[str] | None = None) -> Builder:
        try:
            df = engine.table(name)
        except PlanError as e:
            return Builder(None, str(e))
        return Builder(df).select(*columns) if columns else Builder(df)

    @staticmethod
    def from_plan(df: DataFrame) -> Builder:
        return Builder(df)

    def _then(self, step) -> Builder:
        if self._error or self._frame is None:
            return self
        try:
            return Builder(step(self._frame))
        except AnalysisException as e:
            return Builder(self._frame, str(e).splitlines()[0])

    def select(self, *columns: str | Column) -> Builder:
        named = [c if isinstance(c, Column) else F.col(c) for c in columns]
        return self._then(lambda df: df.select(*named))

    def filter(self, condition: Column) -> Builder:
        return self._then(lambda df: df.where(condition))

    def group_by(self, *keys: str | Column) -> Grouped:
        return Grouped(self, keys)

    def into_plan(self) -> DataFrame:
        if self._error or self._frame is None:
            raise PlanError(self._error or "no plan")
        return self._frame

    @property
    def validation_error(self) -> str | None:
        return self._error

    def schema(self) -> StructType:
        return self.into_plan().schema

    def collect(self) -> pa.Table:
        return self.into_plan().toArrow()


class Grouped:
    def __init__(self, builder: Builder, keys: tuple):
        self.builder, self.keys = builder, keys

    def agg(self, *aggregates: Column) -> Builder:
        return self.builder._then(lambda df: df.groupBy(*self.keys).agg(*aggregates) if self.keys else df.agg(*aggregates))
