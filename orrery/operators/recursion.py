"""Recursive queries that Spark's own WITH RECURSIVE doesn't evaluate: sets, non-linear and mutual ones.

Each step's rows are written to the shared folder, which cuts the lineage; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from orrery.errors import CapExceeded
from orrery.session import shared_dir

CAP = 1000
#: Parts of a result whose union is read as it is.
MOST_PARTS = 24


def _kept(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class _Rows:
    """All rows so far, as what each step added; written anew as one only when there are many such parts."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.parts)

    def add(self, new: DataFrame) -> None:
        self.parts.append(new)
        if len(self.parts) > MOST_PARTS:
            self.parts = [_kept(self.all())]


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], cap: int = CAP) -> DataFrame:
    """WITH RECURSIVE .. UNION, by new rows only: the step must be linear in its argument."""
    new = _kept(anchor.distinct())
    total = _Rows(new)
    for _ in range(cap):
        new = _kept(step(new).toDF(*anchor.columns).subtract(total.all()))
        if new.isEmpty():
            return total.all()
        total.add(new)
    raise CapExceeded(f"no fixed point after {cap} steps")


def linear(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], cap: int = CAP) -> DataFrame:
    """WITH RECURSIVE .. UNION ALL with one reference: each step sees the rows of the one before."""
    new = _kept(anchor)
    total = _Rows(new)
    for _ in range(cap):
        new = _kept(step(new).toDF(*anchor.columns))
        if new.isEmpty():
            return total.all()
        total.add(new)
    raise CapExceeded(f"no fixed point after {cap} steps")


def naive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], cap: int = CAP, distinct: bool = False) -> DataFrame:
    """Non-linear recursion: each step makes anchor and step(all so far) anew, until the number of rows stays."""
    now = _kept(anchor.distinct() if distinct else anchor)
    n = now.count()
    for _ in range(cap):
        found = anchor.unionAll(step(now).toDF(*anchor.columns))
        now = _kept(found.distinct() if distinct else found)
        m = now.count()
        if m == n:
            return now
        n = m
    raise CapExceeded(f"no fixed point after {cap} steps")


def mutual(
    anchors: dict[str, DataFrame], steps: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], cap: int = CAP, bags: frozenset[str] = frozenset()
) -> dict[str, DataFrame]:
    """Mutually recursive relations in lockstep: every step sees what all relations had before it.

    Relations are sets, but those named in ``bags`` (UNION ALL), which get all rows of every step. The end
    is where no set has grown and no bag has got a row.
    """
    now = {k: _kept(v if k in bags else v.distinct()) for k, v in anchors.items()}
    counts = {k: v.count() for k, v in now.items()}
    for _ in range(cap):
        grown = {k: now[k].unionAll(steps[k](now).toDF(*now[k].columns)) if k in steps else now[k] for k in now}
        now = {k: _kept(v if k in bags else v.distinct()) for k, v in grown.items()}
        after = {k: v.count() for k, v in now.items()}
        if after == counts:
            return now
        counts = after
    raise CapExceeded(f"no fixed point after {cap} steps")
