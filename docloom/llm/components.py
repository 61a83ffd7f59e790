"""Problem 4: consolidating pairwise matches into groups by randomised contraction.

Every round each vertex hooks to the vertex of its closed neighbourhood that comes first
in a fresh hash order; edges are relabelled and deduplicated, loops fall away, and the
rounds go on until no edge is left (Boegeholz, Brand, Todor 2020). Then the mappings are
expanded from the last round back to the first. Fresh orders shrink any graph, long chains
and stars alike, by a constant factor a round in expectation. No group is ever gathered:
minima are pre-aggregated, and joins on a hot vertex are split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut


def _undirected(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def contract(edges: DataFrame, seed: int = 17) -> DataFrame:
    """vertex, label for each vertex of an edge (a, b): equal labels, and only those, are connected.

    edges may repeat, be in either direction, or be loops (a loop alone makes its vertex a
    component); rows with a null end are ignored. No edges: no rows. The label is a vertex.
    """
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("vertex"))
    live = cut(edges.where(F.col("a") != F.col("b")).select(*_undirected("a", "b")).distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        order = lambda v: F.struct(F.xxhash64(v, F.lit(seed + len(rounds))).alias("h"), v.alias("v"))  # noqa: E731, B023
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e"))
        hooks = (
            ends.select("e.v", "e.w")
            .groupBy("v")
            .agg(F.min(order(F.col("w"))).alias("first"))
            .select("v", F.least(F.col("first"), order(F.col("v")))["v"].alias("to"))
        )
        hooks = cut(hooks)
        rounds.append(hooks)
        to_a, to_b = hooks.select(F.col("v").alias("a"), F.col("to").alias("ta")), hooks.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        moved = live.join(to_a, "a").join(to_b, "b").where(F.col("ta") != F.col("tb"))
        live = cut(moved.select(*_undirected("ta", "tb")).distinct())

    def expand(later: DataFrame, earlier: DataFrame) -> DataFrame:
        step = later.select(F.col("v").alias("to"), F.col("to").alias("further"))
        return earlier.join(step, "to", "left").select("v", F.coalesce("further", "to").alias("to"))

    if not rounds:
        return loops.distinct().select("vertex", F.col("vertex").alias("label"))
    whole = reduce(expand, reversed(rounds)).select(F.col("v").alias("vertex"), F.col("to").alias("label"))
    return whole.unionByName(loops.distinct().join(whole, "vertex", "left_anti").select("vertex", F.col("vertex").alias("label")))
