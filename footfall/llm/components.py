"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import settled


def _least(sides: DataFrame) -> DataFrame:
    """(u, least): the least node among u and its neighbours; merges map-side for hubs."""
    return sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    sides = edges.union(edges.select("v", "u")).toDF("u", "v")
    return (sides.join(_least(sides), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("least").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(least.select("u", "least")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs), root its component's least node.

    Each round is settled, so lineage stays short; it ends when a round changes nothing.
    """
    state = settled(edges.where("u <> v").dropDuplicates(), "edges")
    mark = None
    for _ in range(most_rounds):
        state = settled(_small_star(_large_star(state)).where("u <> v").dropDuplicates(), "stars")
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return (state.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(state.select("v", "v").dropDuplicates()))
