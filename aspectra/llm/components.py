"""Connected components of an edge table, all in Spark: alternating large and small stars.

No edge, label or component goes to the driver; each round is written to the
shared folder and read again, and the one before is removed. A node's smallest
neighbour is a map-side minimum, so a node with very many edges stays cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import drop_written, written_with


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour points to the smallest of the neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges as a table, with their number and an order-free digest."""
    out, seen = written_with(edges.distinct(), "edges", F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("digest"))
    return out, (seen["n"], seen["digest"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, root) of every node that is not its component's smallest, from edges (a, b) of longs.

    Self loops and repeated edges are allowed; null ends are dropped.
    """
    now, mark = _kept(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(rounds):
        if not mark[0]:
            break
        then, seen = _kept(_small_star(_large_star(now)))
        drop_written(now)
        now = then
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select("a", F.col("b").alias("root"))
