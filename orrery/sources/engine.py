"""The engine: named tables, SQL text, plan rewrites by the user, EXPLAIN."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from difflib import get_close_matches
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from orrery.errors import CapExceeded, PlanError, TypeMismatch
from orrery.metrics import Metrics
from orrery.plans import recursive
from orrery.plans.rewrite import parsed, tokens, written
from orrery.session import configure

#: Rows that a client gets at most.
RESULT_CAP = 16 << 20
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

Batch = DataFrame | pa.Table | pa.RecordBatch


def set_apart(df: DataFrame) -> DataFrame:
    """A name that a join repeats becomes right.c, then right.c__2 and so on."""
    if len(set(df.columns)) == len(df.columns):
        return df
    names: list[str] = []
    for c in df.columns:
        name, k = c if c not in names else f"right.{c}", 2
        while name in names:
            name, k = f"right.{c}__{k}", k + 1
        names.append(name)
    return df.toDF(*names)


class Engine:
    """Tables are temporary views; a lazy one is loaded when a query first names it."""

    def __init__(self, spark: SparkSession):
        self.spark = configure(spark)
        self.tables: dict[str, DataFrame] = {}
        self.lazy: dict[str, tuple[StructType, Callable[[], Iterable[Batch]]]] = {}
        self.rewrites: list[Callable[[DataFrame], DataFrame]] = []
        self.metrics = Metrics()

    def _frame(self, batch: Batch) -> DataFrame:
        if isinstance(batch, DataFrame):
            return batch
        return self.spark.createDataFrame(pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch)

    def _put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def register_table(self, name: str, batch: Batch) -> None:
        if name in self.tables or name in self.lazy:
            raise PlanError(f"table {name} exists")
        self._put(name, self._frame(batch))

    def register_batch(self, name: str, batch: Batch) -> None:
        """Append."""
        self._put(name, self.table(name).unionByName(self._frame(batch)))

    def replace_table(self, name: str, batch: Batch) -> None:
        self.lazy.pop(name, None)
        self._put(name, self._frame(batch))

    def register_table_stream(self, name: str, schema: StructType, batches: Iterable[Batch]) -> None:
        """All batches at once; each must have the schema, and there must be one. Nothing stays of a failed call."""
        if name in self.tables or name in self.lazy:
            raise PlanError(f"table {name} exists")
        self._put(name, self._union(name, schema, batches))

    def _union(self, name: str, schema: StructType, batches: Iterable[Batch]) -> DataFrame:
        frames = [self._frame(b) for b in batches]
        if not frames:
            raise PlanError(f"no batch for {name}")
        shape = lambda s: [(f.name, f.dataType) for f in s.fields]
        for f in frames:
            if shape(f.schema) != shape(schema):
                raise TypeMismatch(f"a batch of {name} is {f.schema.simpleString()}, not {schema.simpleString()}")
        return reduce(DataFrame.unionByName, frames)

    def register_table_stream_lazy(self, name: str, schema: StructType, producer: Callable[[], Iterable[Batch]]) -> None:
        if name in self.tables or name in self.lazy:
            raise PlanError(f"table {name} exists")
        self.lazy[name] = (schema, producer)

    def register_parquet(self, folder: str, names: Iterable[str] = TABLES) -> Engine:
        for n in names:
            self.replace_table(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def table(self, name: str) -> DataFrame:
        if name in self.lazy:
            schema, producer = self.lazy[name]
            self._put(name, self._union(name, schema, producer()))
            del self.lazy[name]
        if name not in self.tables:
            raise PlanError(f"no table {name}")
        return self.tables[name]

    def with_rewrite(self, rule: Callable[[DataFrame], DataFrame]) -> Engine:
        """A rule for results of ``sql``; it must keep their schema. Rules run in the order they came in."""
        self.rewrites.append(rule)
        return self

    def sql(self, text: str) -> DataFrame:
        with self.metrics.phase("plan"):
            self.metrics.add("queries")
            found = self._planned(text)
            for rule in self.rewrites:
                made = rule(found)
                if made.schema != found.schema:
                    raise PlanError("a rewrite changed the schema")
                found = made
        return found

    def _planned(self, text: str) -> DataFrame:
        listed = tokens(text)
        words = {t.strip("`") for t in listed}
        for name in [n for n in self.lazy if n in words]:
            self.table(name)
        self._check_quoted(listed)
        nodes = parsed(text, self._types(words), self._columns)
        try:
            found = recursive.run(self.spark, nodes)
            return set_apart(self.spark.sql(written(nodes)) if found is None else found)
        except AnalysisException as e:
            raise self._named(e, words) from e

    def _names(self, words: set[str]) -> set[str]:
        """Tables, and columns of those that a text names."""
        return {*self.tables, *self.lazy, *(c for n, df in self.tables.items() if n in words for c in df.columns)}

    def _check_quoted(self, listed: list[str]) -> None:
        """A quoted name is taken as it is written, capitals included, unless the text makes it an alias."""
        known = self._names({t.strip("`") for t in listed})
        aliases = {b for a, b in pairwise(listed) if a.upper() == "AS"}
        for t in listed:
            name = t[1:-1]
            if t[0] == "`" and t not in aliases and name not in known and (other := next((k for k in known if k.lower() == name.lower()), None)):
                raise PlanError(f'no name "{name}"; did you mean "{other}"?')

    def _named(self, error: AnalysisException, words: set[str]) -> Exception:
        """An unknown table or column by its name, with the closest known one."""
        kind, found = error.getCondition() or "", error.getMessageParameters() or {}
        name = found.get("relationName") if "TABLE_OR_VIEW_NOT_FOUND" in kind else found.get("objectName") if kind.startswith("UNRESOLVED_COLUMN") else None
        if not name:
            return error
        bare = name.split(".")[-1].strip("`")
        close = get_close_matches(bare.lower(), sorted(self._names(words)), 1, 0.6)
        return PlanError(f"no {'table' if 'TABLE' in kind else 'column'} {bare}" + (f"; did you mean {close[0]}?" if close else ""))

    def _columns(self, text: str) -> list[tuple[str, str]] | None:
        """Names and types of a query's columns, by analysis alone; None if it can't be analysed by itself."""
        try:
            return self.spark.sql(text).dtypes
        except (AnalysisException, ParseException):
            return None

    def _types(self, words: set[str]) -> dict[str, str]:
        """Types of the columns of the tables that the text names; a name with several types is left out."""
        found: dict[str, set[str]] = {}
        for name, df in self.tables.items():
            if name in words:
                for c, kind in df.dtypes:
                    found.setdefault(c.lower(), set()).add(kind)
        return {c: next(iter(kinds)) for c, kinds in found.items() if len(kinds) == 1}

    def explain_sql(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def fetch(self, query: str | DataFrame, cap: int = RESULT_CAP) -> pa.Table:
        """A result for a client, as Arrow; more rows than the cap are an error."""
        planned = (self.sql(query) if isinstance(query, str) else query).limit(cap + 1)
        with self.metrics.phase("run"):
            found = planned.toArrow()
        self.metrics.add("rows", len(found))
        if len(found) > cap:
            raise CapExceeded(f"more than {cap} rows")
        return found
