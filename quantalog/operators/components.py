"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import dealt, removed, shared_path, written

#: Edges of a task, and of a node that is not gathered in one.
TASK_EDGES, HOT_EDGES = 1_000_000, 100_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge, component being the least node that it is connected with.

    Each round links every node's larger neighbours, then its smaller ones, to the least node nearby, so paths halve and the
    rounds needed grow with the logarithm of the longest one. A round is two aggregations (combined before the shuffle) and
    two joins back to the edges, written to the shared folder; only a count and a checksum reach the driver. The star of a
    large component is never gathered in a task (see _joined). Edges that are null at an end or join a node to itself are ignored.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    at = shared_path(spark, "edges")
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "edges", at)
    state = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        least = written(least, "least", of_large := shared_path(spark, "least"))
        large = _joined(both.where("v > u"), least, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "edges", middle := shared_path(spark, "edges"))
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least", of_small := shared_path(spark, "least"))
        linked = _joined(large, least, state[0])
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        following = shared_path(spark, "edges")
        now = written(small, "edges", following)
        for folder in (of_large, of_small, middle, at):
            removed(spark, folder)
        at, before, state = following, state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _joined(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """Edges with the least node m near u. Nodes with over HOT_EDGES edges (n) are few: theirs are sent to every task."""
    hot = F.broadcast(least.where(F.col("n") > HOT_EDGES).select("u", "m"))
    rest = dealt(edges.join(hot.select("u"), "u", "left_anti"), count, TASK_EDGES, "u")
    cold = dealt(least.where(F.col("n") <= HOT_EDGES).select("u", "m"), count, TASK_EDGES, "u")
    return edges.join(hot, "u").unionByName(rest.join(cold, "u"))


def _state(edges: DataFrame) -> tuple:
    # A sum of hashes as decimals: no overflow, the same in any order.
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
