"""Operators the reference plans but never implements (I1-I4); I5 and I6
are parameters of existing operators (``build_space(property_list=None)``
with ``nearest_property``; the ``statistic`` argument of A1/B4/E1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir, scratch_path


def _array_mode(arr):
    """Most frequent element of an array (tie: smallest); null if empty."""
    counted = F.transform(F.array_distinct(arr), lambda t: F.struct(
        (-F.size(F.filter(arr, lambda x: x == t))).alias("m"), t.alias("t")))
    return F.array_min(counted)["t"]


def majority_type(spans: DataFrame, tags: DataFrame, key: str = "sentence") -> DataFrame:
    """The most frequent tag (not ``O``) over all tokens of each entity
    span (tie: smallest tag); null when the span has none.  One join with
    the per-sentence tags (``tag_arrays``); the counting happens inside the
    row (a span is bounded by its sentence)."""
    from tessera.operators.sentences import tag_arrays, tag_at

    tm = tag_arrays(tags, key)
    j = spans.join(tm, key, "left")

    def span_tags(a, b):
        s, e = F.col(a).cast("bigint"), F.col(b).cast("bigint")
        pos = F.when(e >= s, F.sequence(s, e)).otherwise(F.array().cast("array<bigint>"))
        look = F.transform(pos, lambda p: tag_at(tm, p))
        return F.filter(look, lambda t: t.isNotNull() & (t != F.lit("O")))

    return (j.withColumn("e1_major", _array_mode(span_tags("e1_start", "e1_end")))
            .withColumn("e2_major", _array_mode(span_tags("e2_start", "e2_end")))
            .drop(*[c for c in tm.columns if c != key]))


def _type_counts(df: DataFrame, rel: str, cols) -> DataFrame:
    """(rel, k, t, n): how often each single type occurs in the type lists of
    column number ``k``, of each relation.  Equal lists are counted before
    they are cut."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(cols)])
    lists = df.select(rel, F.explode(cells).alias("c")).groupBy(rel, "c.k", "c.v").agg(F.count(F.lit(1)).alias("n"))
    return (lists.select(rel, "k", F.explode(F.split("v", ",")).alias("t"), "n").filter(F.col("t") != "")
            .groupBy(rel, "k", "t").agg(F.sum("n").alias("n")))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, as the counts and the output both read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MAX_BROADCAST_RELATIONS = 100_000


def _per_relation(table: DataFrame) -> DataFrame:
    """A table of one row per relation, written once; broadcast up to
    ``MAX_BROADCAST_RELATIONS`` rows, so that a relation with a large share
    of the sentences does not end in one task."""
    checkpoint_dir(table.sparkSession)
    written = table.checkpoint()
    return F.broadcast(written) if written.count() <= MAX_BROADCAST_RELATIONS else written


def impute_types(df: DataFrame, rel: str = "rel", cols=("e1_type_CNLP", "e2_type_CNLP")) -> DataFrame:
    """An empty type cell takes the most frequent type of its relation
    (tie: smallest type); cells already typed are unchanged."""
    df = _written(df, "impute")
    most = [F.min(F.when(F.col("k") == k, F.struct((-F.col("n")).alias("m"), "t")))["t"].alias(f"_mode_{c}") for k, c in enumerate(cols)]
    out = df.join(_per_relation(_type_counts(df, rel, cols).groupBy(rel).agg(*most)), rel, "left")
    return out.withColumns({c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.coalesce(F.col(f"_mode_{c}"), F.lit("")))
                            .otherwise(F.col(c)) for c in cols}).drop(*[f"_mode_{c}" for c in cols])


def resolve_types(df: DataFrame, rel: str = "rel", cols=("e1_type_CNLP", "e2_type_CNLP")) -> DataFrame:
    """A cell with several types keeps the one most frequent for its
    relation (counted over all cells of the relation; tie: smallest)."""
    df = _written(df, "resolve")
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("k") == k, F.struct("t", "n")))).alias(f"_cnt_{c}") for k, c in enumerate(cols)]
    out = df.join(_per_relation(_type_counts(df, rel, cols).groupBy(rel).agg(*maps)), rel, "left")

    def best(c):
        cand = F.filter(F.split(F.col(c), ","), lambda x: x != F.lit(""))
        ranked = F.transform(cand, lambda x: F.struct((-F.coalesce(F.element_at(F.col(f"_cnt_{c}"), x), F.lit(0))).alias("m"),
                                                       x.alias("t")))
        several = F.contains(F.col(c), F.lit(",")) & (F.size(cand) > 1)  # most cells are not cut
        return F.when(several, F.array_min(ranked)["t"]).otherwise(F.col(c))

    return out.withColumns({c: best(c) for c in cols}).drop(*[f"_cnt_{c}" for c in cols])


def clones_from_mapping(mapping: DataFrame, sep: str = "_@") -> DataFrame:
    """I4: properties targeted by more than one relation get one clone per
    relation (``prop_@k``, k from 1 in relation order): (rel, prop, clone)."""
    shared = mapping.groupBy("prop").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    w = Window.partitionBy("prop").orderBy("rel")  # one group per shared property (mapping-sized)
    return (mapping.join(shared.select("prop"), "prop", "left_semi")
            .withColumn("k", F.row_number().over(w))
            .select("rel", "prop", F.concat(F.col("prop"), F.lit(sep), F.col("k").cast("string")).alias("clone")))
