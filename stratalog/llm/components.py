"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node it reaches) of every node of the edges (a, b).

    Every round links neighbours to the smallest node around them, first larger, then smaller ones; the
    edges end up as one star per component after about log(n) rounds. Nulls and loops are no edges.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        # the smallest node around each one; a table of its own, so that the join can split the rows of a node with many neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("m")))
        large = now.join(least, F.col("b") == F.col("node")).select(F.greatest("a", "m").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        down = large
        lowest = down.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        two = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = down.join(lowest, F.col("a") == F.col("node")).select(F.explode(two).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, now = now, materialize(small)
        discard(before, least)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
