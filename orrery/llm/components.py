"""Connected components of a large graph, by alternating large and small stars.

Each round is two joins on a node's least neighbour. Counts and hashes of the edges, observed as they are
written, tell when nothing changes; edges are written to the shared folder each round, which cuts the lineage.
Least neighbours are broadcast where the counted edges are few. Beyond that a hub's edges are far more than a
task should hold: least neighbours are dealt out once more, so that both sides of a join come from plain
exchanges and adaptive execution can split the hub's side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint

#: Edges up to which least neighbours, of which there are no more, are broadcast: 16 bytes each.
MOST_BROADCAST = 500_000


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges in the shared folder, how many they are, and their hash."""
    seen = Observation()
    done = checkpoint(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")))
    return done, (seen.get["n"], seen.get["h"] or 0)


def splittable(small: DataFrame, key: str) -> DataFrame:
    """One row for each key, from an aggregate: dealt out again, so that a join's other side may be split by skew."""
    return small.repartition(F.xxhash64(key))


def _least(edges: DataFrame, few: bool) -> DataFrame:
    found = edges.groupBy("u").agg(F.min("v").alias("m"))
    return F.broadcast(found) if few else splittable(found, "u")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(_least(both, few), "u").where("v > u")
    return met.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = _least(edges, few)
    met = edges.join(least, "u")
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the least node of its component.

    Loops and repeated edges do no harm; nodes without an edge to another are not listed.
    """
    now, state = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        if not state[0]:
            break
        # A round never makes more edges than there are nodes and edges: twice the bound at most.
        few, before = state[0] <= most_broadcast, state
        now, state = _written(_small_star(_large_star(now, few), few))
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
