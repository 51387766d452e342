"""Dot products of sparse vectors by an inverted index: vectors meet on the
components that they share, and only there.

The index is an equi-join on the component.  A component that many vectors
have is dealt out: the left vectors over salts, each with all the right ones,
so that no task holds more than about ``HOT_ROWS`` left rows of a component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 2000


def shared_dots(left: DataFrame, right: DataFrame, left_key: list[str], right_key: list[str],
                keep: dict[str, Column] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left_key``, ``right_key``, ``ab``: the dot product of every left
    vector with every right one that it shares a component with.

    ``left`` has ``left_key``, ``component``, ``va``; ``right`` has
    ``right_key``, ``component``, ``vb``.  ``keep`` names further aggregates
    over the joined rows (as the norms that both sides carry)."""
    counts = left.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    salts = counts.select("component", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    lhs, rhs, on = left, right, ["component"]
    if counts.take(1):
        one, on = F.coalesce("_salts", F.lit(1)), ["component", "_salt"]
        lhs = left.join(salts, "component", "left").withColumn("_salt", F.pmod(F.xxhash64(*left_key), one).cast("int")).drop("_salts")
        rhs = right.join(salts, "component", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    extra = [c.alias(n) for n, c in (keep or {}).items()]
    return (lhs.join(rhs, on).groupBy(*left_key, *right_key)
            .agg(F.sum(F.col("va") * F.col("vb")).alias("ab"), *extra))
