"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node u that has edges and is not the least of its
    component, with that least node v.

    Each round hooks all neighbours of a node to its least neighbour
    (larger ones, then smaller ones) until nothing moves: the number of
    rounds is logarithmic in practice, a round's rows never outgrow the
    edges, and every round is checkpointed to the shared folder."""
    checkpoint_dir(edges.sparkSession)
    now = edges.select("u", "v").filter("u <> v").distinct().checkpoint()
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or tuple(state) == seen:
            return now
        seen = tuple(state)
        now = _small_star(_large_star(now)).checkpoint()
