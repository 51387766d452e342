"""Flagship query: for each predicate of the cleaned profile, the most
probable (subject, object) pair (F-PAT -> B6 -> E1 -> top pair)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cleaning import clean
from tessera.operators.space import probabilities
from tessera.sources import views as V


def top_pair_per_predicate(probs: DataFrame) -> DataFrame:
    """Highest ``prob`` per predicate (tie: smallest pair); a partial
    aggregate, so a predicate owning many patterns is combined map-side."""
    best = probs.groupBy("predicate").agg(F.min_by(
        F.struct("subject", "object", "pair", "prob"),
        F.struct((-F.col("prob")).alias("neg_prob"), F.col("pair"))).alias("b"))
    return best.select("predicate", "b.subject", "b.object", "b.pair",
                       F.round("b.prob", 6).alias("prob"))


def most_probable_pairs(spark: SparkSession, sf_dir: str, min_freq: int = 1) -> DataFrame:
    cleaned = clean(V.patterns(spark, sf_dir), kw="widget", min_freq=min_freq)
    return top_pair_per_predicate(probabilities(cleaned))
