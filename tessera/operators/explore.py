"""Profile exploration (C1-C16): distributions, summaries, removal impact,
histograms and pair-set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


def _cnt():
    return F.count(F.lit(1))


def predicate_distribution(df: DataFrame) -> DataFrame:
    """Patterns per predicate, ascending (tie: predicate)."""
    return (df.groupBy("predicate").agg(_cnt().alias("n_patterns"))
            .orderBy("n_patterns", "predicate"))


def rare_patterns(df: DataFrame, statistic: str = "frequency") -> DataFrame:
    """C2 (t_2): patterns with statistic < 2."""
    return df.filter(F.col(statistic) < 2)


def single_pattern_predicates(df: DataFrame) -> DataFrame:
    """C3 (t_3): predicates with fewer than 2 patterns, with their size."""
    return df.groupBy("predicate").agg(_cnt().alias("size")).filter(F.col("size") < 2)


def single_rare_predicates(df: DataFrame, statistic: str = "frequency") -> DataFrame:
    """C4 (t_4): predicates with fewer than 2 patterns among the rare ones.
    A predicate may still own other, frequent patterns."""
    return single_pattern_predicates(rare_patterns(df, statistic))


def unrepeated_pairs(df: DataFrame) -> DataFrame:
    """C5 (t_5): (subject, object) pairs found in fewer than 2 patterns."""
    return (df.groupBy("subject", "object").agg(_cnt().alias("size"))
            .filter(F.col("size") < 2))


def profile_summary(df: DataFrame, statistic: str = "frequency") -> DataFrame:
    """One row with six counters.  Two grouped passes (per predicate and
    per pair), unioned and folded by one global aggregate; nothing reaches
    the driver."""
    per_pred = (df.groupBy("predicate")
                .agg(_cnt().alias("n"), F.count_if(F.col(statistic) < 2).alias("rare_n"))
                .select(F.lit("p").alias("kind"), "n", "rare_n"))
    per_pair = (df.groupBy("subject", "object").agg(_cnt().alias("n"))
                .select(F.lit("q").alias("kind"), "n", F.lit(0).cast("bigint").alias("rare_n")))
    u = per_pred.unionByName(per_pair)
    is_p = F.col("kind") == "p"
    is_q = F.col("kind") == "q"
    return u.agg(
        F.coalesce(F.sum(F.when(is_p, F.col("n"))), F.lit(0)).cast("bigint").alias("patterns"),
        F.coalesce(F.sum(F.when(is_p, F.col("rare_n"))), F.lit(0)).cast("bigint").alias("patterns_freq1"),
        F.count_if(is_p).alias("predicates"),
        F.count_if(is_p & (F.col("n") < 2)).alias("single_pattern_predicates"),
        F.count_if(is_p & (F.col("rare_n") == 1)).alias("single_rare_predicates"),
        F.count_if(is_q & (F.col("n") < 2)).alias("unrepeated_pairs"))


def removal_impact(df: DataFrame, statistic: str = "frequency", ndigits: int | None = 6) -> DataFrame:
    """For every predicate owning a rare pattern, size and statistic
    total before/after removing the rare patterns, deltas and percentages.
    One grouped pass with conditional aggregates."""
    s = F.col(statistic)
    g = (df.groupBy("predicate")
         .agg(_cnt().alias("size_before"),
              F.sum(s).cast("bigint").alias("sum_before"),
              F.count_if(s > 1).alias("size_after"),
              F.coalesce(F.sum(F.when(s > 1, s)), F.lit(0)).cast("bigint").alias("sum_after"),
              F.min(s).alias("_min"))
         .filter(F.col("_min") < 2).drop("_min"))
    g = (g.withColumn("size_delta", F.col("size_before") - F.col("size_after"))
         .withColumn("sum_delta", F.col("sum_before") - F.col("sum_after")))
    size_pct = F.col("size_delta") * 100.0 / F.col("size_before")
    sum_pct = F.col("sum_delta") * 100.0 / F.col("sum_before")
    if ndigits is not None:
        size_pct, sum_pct = F.round(size_pct, ndigits), F.round(sum_pct, ndigits)
    return g.withColumn("size_delta_pct", size_pct).withColumn("sum_delta_pct", sum_pct)


def impact_histogram(impact: DataFrame, col: str = "sum_delta_pct", bins: int = 40) -> DataFrame:
    """Equal-width histogram of ``col`` over [min, max], last bin closed
    on the right; empty bins included.  One small action reads min/max."""
    stats = impact.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = stats["lo"], stats["hi"]
    spark = impact.sparkSession
    if lo is None:
        lo, hi = 0.0, 1.0
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(col) - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)),
                F.lit(bins - 1)).cast("bigint")
    counts = impact.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(_cnt().alias("n"))
    edges = spark.range(bins).select(
        F.col("id").alias("bin"),
        F.round(F.lit(lo) + F.col("id") * F.lit(width), 6).alias("bin_lo"),
        F.round(F.lit(lo) + (F.col("id") + 1) * F.lit(width), 6).alias("bin_hi"))
    return (edges.join(counts, "bin", "left")
            .select("bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def impact_extremes(impact: DataFrame, hi: float = 90, lo: float = 10,
                    col: str = "sum_delta_pct") -> DataFrame:
    """Rows above ``hi`` (side 'high') and below ``lo`` (side 'low')."""
    high = impact.filter(F.col(col) > hi).withColumn("side", F.lit("high"))
    low = impact.filter(F.col(col) < lo).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def namespace_share(preds: DataFrame, needle: str = "dbpedia.org/property",
                    col: str = "predicate") -> DataFrame:
    """Of the distinct predicates given, how many contain ``needle``
    (case-sensitive substring) and the percentage (null without a predicate)."""
    d = preds.select(col).distinct()
    return d.agg(_cnt().alias("touched"),
                 F.count_if(F.col(col).contains(needle)).alias("with_needle")).withColumn(
        "pct", F.round(F.try_divide(F.col("with_needle") * 100.0, F.col("touched")), 6))


def touched_predicates(df: DataFrame, statistic: str = "frequency") -> DataFrame:
    """Distinct predicates of the rare patterns (input of C10)."""
    return rare_patterns(df, statistic).select("predicate").distinct()


def lookup_predicate(df: DataFrame, value: str) -> DataFrame:
    """C11: the patterns of one predicate (equality, pushed to the scan)."""
    return df.filter(F.col("predicate") == value)


def list_predicates(rows: DataFrame, needle: str, col: str = "predicate") -> DataFrame:
    """Row labels containing ``needle`` (case-sensitive)."""
    return rows.select(col).distinct().filter(F.col(col).contains(needle))


def predicates_with_n_patterns(df: DataFrame, n: int = 5) -> DataFrame:
    """Predicates having exactly ``n`` patterns."""
    return (df.groupBy("predicate").agg(_cnt().alias("size"))
            .filter(F.col("size") == n).select("predicate"))


def pair_sets(df: DataFrame, preds: DataFrame) -> DataFrame:
    """C14: sorted set of pairs of each selected predicate, as an array: the
    selection (C13: predicates with exactly n patterns) bounds every set by
    n.  ``equal_pair_sets`` compares sets of any size."""
    src = df.join(preds.select("predicate"), "predicate", "left_semi")
    return src.groupBy("predicate").agg(F.array_sort(F.collect_set("pair")).alias("pairs"))


def equal_pair_sets(df: DataFrame, n: int | None = 5) -> DataFrame:
    """For every predicate with exactly ``n`` patterns (None: for every
    predicate), the group of predicates sharing exactly its pair set.

    Output is linear in the predicates: ``set_rep`` (smallest predicate of
    the group, the group's id) and ``n_equal`` (other members).  The members
    of a group are ``predicate`` where ``set_rep`` matches.  Sets may be of
    any size: predicates are compared by an order-free fingerprint (count,
    and sum and exclusive or of two hashes of each pair), and then pair by
    pair with the group's ``set_rep``; a predicate that shares the
    fingerprint alone is grouped again without it."""
    checkpoint_dir(df.sparkSession)
    if n is not None:
        df = df.join(predicates_with_n_patterns(df, n), "predicate", "left_semi")
    pairs = df.select("predicate", "pair").distinct().checkpoint()
    a, b = F.xxhash64("pair"), F.xxhash64(F.lit("pair"), "pair")
    total = F.sum(a.cast("decimal(38,0)"))
    prints = pairs.groupBy("predicate").agg(_cnt().alias("size"), F.bit_xor(a).alias("xa"), F.bit_xor(b).alias("xb"), total.alias("s"))
    left, done = prints.checkpoint(), []
    while True:
        w = ["size", "xa", "xb", "s"]
        reps = left.groupBy(*w).agg(F.min("predicate").alias("set_rep"))
        grouped = left.join(reps, w)
        # pairs of each member that its set_rep has too: all of them, if the sets are equal
        own = pairs.join(grouped.filter(F.col("predicate") != F.col("set_rep")).select("predicate", "set_rep"), "predicate")
        theirs = pairs.select(F.col("predicate").alias("set_rep"), "pair")
        differs = own.join(theirs, ["set_rep", "pair"], "left_anti").select("predicate").distinct().checkpoint()
        done.append(grouped.join(differs, "predicate", "left_anti").select("predicate", "set_rep"))
        if differs.isEmpty():
            break
        left = left.join(differs, "predicate", "left_semi").checkpoint()
    sets = done[0]
    for more in done[1:]:
        sets = sets.unionByName(more)
    members = sets.groupBy("set_rep").agg(_cnt().alias("members"))
    return sets.join(members, "set_rep").select("predicate", "set_rep", (F.col("members") - 1).alias("n_equal"))


def relation_counts(sent: DataFrame) -> DataFrame:
    """Sentences per undirected relation."""
    return sent.groupBy("rel").agg(_cnt().alias("n_sentences"))
