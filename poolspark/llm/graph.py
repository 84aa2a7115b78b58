"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import cut_lineage, join_narrow

#: Edges a task works on; small tables take few tasks and leave few files.
TASK_EDGES = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b) the smallest node reachable from it.

    Each round points the larger neighbours of a node to its smallest neighbour, then the smaller ones.
    The edge table never grows, a hub's edges are never gathered, and no node passes through the driver.
    Loops and nulls are ignored; no edges give an empty table.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    )
    n = now.count()
    if not n:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tasks = -(-n // TASK_EDGES)
    now, before = now.coalesce(tasks), None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut_lineage(_star(both, both.where("v > u"), tasks).coalesce(tasks))
        small = cut_lineage(_star(large, large, tasks).coalesce(tasks))
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = small
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _star(every: DataFrame, moved: DataFrame, tasks: int) -> DataFrame:
    """Edges (u > v): each ``moved`` neighbour of u, and u itself, points to the smallest of u and its neighbours."""
    least = cut_lineage(every.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
    moved = join_narrow(moved, least, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
