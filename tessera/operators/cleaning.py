"""Pattern cleaning (B2-B7): keyword, rare-pair, frequency and
small-predicate filters.

The count-based filters are an aggregate (partial, map-side combined)
followed by a semi/anti join on the key.  A hot key (one pair or one
predicate holding a large share of all rows) is collapsed by the partial
aggregate before the shuffle, and AQE's skew-join split handles the big
side of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ci_search
from tessera.session import checkpoint_dir
from tessera.sources.patterns import pair_col


def drop_keyword_predicates(df: DataFrame, kw: str = "wiki") -> DataFrame:
    """B2: removes patterns whose predicate matches ``kw`` (regex search,
    case-insensitive)."""
    return df.filter(~F.coalesce(ci_search(F.col("predicate"), kw), F.lit(False)))


def rare_pair_keys(df: DataFrame, n: int = 1) -> DataFrame:
    """Pair strings of the (subject, object) groups with at most ``n`` rows."""
    return (df.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("size"))
            .filter(F.col("size") <= n).select(pair_col().alias("pair")).distinct())


def drop_rare_pairs(df: DataFrame, n: int = 1) -> DataFrame:
    """Removes patterns whose (subject, object) pair occurs in at most
    ``n`` rows (rows are counted, not frequency).  Removal is by pair string,
    as the count is keyed by the two columns and the filter by the string."""
    return df.join(rare_pair_keys(df, n), "pair", "left_anti")


def drop_infrequent(df: DataFrame, min_excl: int = 10, statistic: str = "frequency") -> DataFrame:
    """Keeps patterns whose statistic is strictly above ``min_excl``."""
    return df.filter(F.col(statistic) > min_excl)


def small_predicates(df: DataFrame, n: int = 1) -> DataFrame:
    return (df.groupBy("predicate").agg(F.count(F.lit(1)).alias("size"))
            .filter(F.col("size") <= n).select("predicate"))


def drop_small_predicates(df: DataFrame, n: int = 1) -> DataFrame:
    """Removes predicates having at most ``n`` patterns."""
    return df.join(small_predicates(df, n), "predicate", "left_anti")


def clean(df: DataFrame, kw: str = "wiki", pair_n: int = 1, min_freq: int = 10,
          pred_n: int = 1, statistic: str = "frequency") -> DataFrame:
    """B2 -> B3 -> B4 -> B5, each count taken on the previous output.
    The output of B2 is checkpointed: the counts and the rows read it, and
    the source is read once."""
    checkpoint_dir(df.sparkSession)
    out = drop_keyword_predicates(df, kw).checkpoint()
    out = drop_rare_pairs(out, pair_n)
    out = drop_infrequent(out, min_freq, statistic)
    return drop_small_predicates(out, pred_n)


def clean_from_summary(df: DataFrame, kw: str = "wiki", min_freq: int = 10,
                       statistic: str = "frequency") -> DataFrame:
    """Notebook variant.  Unrepeated pairs (fewer than 2 rows) and
    predicates with fewer than 2 rare (statistic < 2) patterns are computed
    on the uncleaned input, then: keyword filter, drop those pairs, keep
    statistic > ``min_freq``, drop those predicates.  The input is
    checkpointed, as three steps read it."""
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    t5 = (df.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("size"))
          .filter(F.col("size") < 2).select(pair_col().alias("pair")).distinct())
    t4 = (df.filter(F.col(statistic) < 2).groupBy("predicate")
          .agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") < 2).select("predicate"))
    out = drop_keyword_predicates(df, kw)
    out = out.join(t5, "pair", "left_anti")
    out = out.filter(F.col(statistic) > min_freq)
    return out.join(t4, "predicate", "left_anti")
