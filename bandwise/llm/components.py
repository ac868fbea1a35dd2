"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import scratch

MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of ``links``: root is the smallest node that can
    be reached. Rows with a null end are dropped; a loop gives a node of its own.

    A node's smallest neighbour is found with map-side aggregation and written,
    so that the join back to the links of a node with very many can be split.
    """
    edges = scratch.cut(
        links.where(f"{a} IS NOT NULL AND {b} IS NOT NULL")
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    loops = edges.where("u = v").select("u")
    edges = edges.where("u <> v")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        edges = _small_star(_large_star(edges))
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    own = edges.select("v").union(loops).distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return roots.union(own.join(roots.select("node"), "node", "left_anti"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = scratch.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    return scratch.cut(
        both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct(), "links")


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = scratch.cut(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    linked = edges.join(smallest, "u")
    return scratch.cut(
        linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
