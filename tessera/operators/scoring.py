"""Scoring against the property space and the training losses (H1-H8).

Projections are ``array<double>`` or ``map<bigint,double>`` columns; the
space stays sparse, so its width does not matter.  A space of checked size
is searched by the pruned index of ``tessera.functions.nearest``, which every
task holds: projections stay where they are.  A larger one is an inverted
index that projections meet component by component; where that would make
too many pairs, the nearest row is sought in blocks of the space
(``tessera.functions.dealt``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dealt import add_nearest_dealt
from tessera.functions.index import dense_index
from tessera.functions.nearest import add_nearest, add_scores, space_index
from tessera.functions.sparse_join import shared_dots
from tessera.functions.vectors import argmax_first, cosine, dense_from_map, dot, embedding_cosine, sq_norm
from tessera.operators.space import Space, to_dense

#: Entries and rows of a space that a task holds as an index.
MAX_INDEX_ENTRIES = 8_000_000
#: Pairs of entries with a common component that an inverted index may make,
#: for each entry of the projections and of the space.
MAX_PAIRS_PER_ENTRY = 64
# ranking key precision: engines differ in the last bits of a dot product
RANK_DIGITS = 12
LOG_CLAMP = -100.0


def space_from_long(long_df: DataFrame) -> Space:
    """A Space from (predicate, row_order, component, value) rows."""
    rows = long_df.select("predicate", F.col("row_order").cast("bigint")).distinct()
    entries = (long_df.filter(F.col("component").isNotNull())
               .select("predicate", F.col("component").cast("bigint"), F.col("value").cast("double")))
    dims = entries.select("component").distinct().withColumn(
        "label", F.concat(F.lit("c"), F.col("component").cast("string")))
    return Space(rows, entries, dims)


def dense_rows(space: Space, max_dims: int = 1_000_000) -> DataFrame:
    """(predicate, row_order, vec, sq): dense space rows with squared norms."""
    d = to_dense(space, max_dims=max_dims)
    return d.withColumn("sq", sq_norm(F.col("vec")))


def _fits(space: Space, max_entries: int) -> bool:
    """Whether rows and entries together are at most ``max_entries``."""
    sizes = space.entries.agg(F.count(F.lit(1)).alias("n")).unionAll(space.rows.agg(F.count(F.lit(1)).alias("n")))
    return sum(r["n"] for r in sizes.collect()) <= max_entries


def _vector_entries(queries: DataFrame, id_cols: list[str], vec: str) -> DataFrame:
    """id columns, component, va, qsq of every non-zero of the vectors."""
    is_map = dict(queries.dtypes)[vec].startswith("map")
    sq = sq_norm(F.map_values(F.col(vec)) if is_map else F.col(vec))
    each = queries.select(*id_cols, sq.alias("qsq"), (F.explode if is_map else F.posexplode)(F.col(vec)).alias("component", "va"))
    return each.select(*id_cols, "qsq", F.col("component").cast("bigint").alias("component"),
                       F.col("va").cast("double").alias("va")).filter(F.col("va") != 0)


def _meets_few(queries: DataFrame, id_cols: list[str], vec: str, space: Space) -> bool:
    """Whether an inverted index makes at most ``MAX_PAIRS_PER_ENTRY``."""
    a = _vector_entries(queries, id_cols, vec).groupBy("component").agg(F.count(F.lit(1)).cast("double").alias("a"))
    b = space.entries.filter(F.col("value") != 0).groupBy("component").agg(F.count(F.lit(1)).cast("double").alias("b"))
    n = a.join(b, "component", "full_outer").agg(
        F.sum(F.col("a") * F.col("b")).alias("pairs"), F.sum(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("entries")).first()
    return (n["pairs"] or 0) <= MAX_PAIRS_PER_ENTRY * (n["entries"] or 0)


def _joined_cosines(queries: DataFrame, id_cols: list[str], vec: str, space: Space, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(id columns, place, sim) of every query and row that share a
    component, by the inverted index; and the rows with their ``place`` (from
    0, in the given order)."""
    sort_keys = [f"_o{k}" for k in range(len(order))]
    rows = space.rows.select("predicate", "row_order", *[c.alias(k) for k, c in zip(sort_keys, order)])
    placed = dense_index(rows, sort_keys, "place").select("predicate", "row_order", "place").checkpoint()
    norms = space.entries.groupBy("predicate").agg(F.sum(F.col("value") * F.col("value")).alias("sq"))
    right = space.entries.filter(F.col("value") != 0).join(placed, "predicate").join(norms, "predicate").select(
        "place", "component", F.col("value").alias("vb"), "sq")
    dots = shared_dots(_vector_entries(queries, id_cols, vec), right, id_cols, ["place"],
                       {"qsq": F.max("qsq"), "sq": F.max("sq")})
    return dots.select(*id_cols, "place", cosine(F.col("ab"), F.col("qsq"), F.col("sq")).alias("sim")), placed


def _best_row(queries: DataFrame, id_cols: list[str], vec: str, space: Space, ties: str = "first",
              max_entries: int | None = None) -> DataFrame:
    """queries + ``nearest``, ``nearest_order``, ``sim`` (cosine, norms
    clamped, so a zero vector scores 0 everywhere and gets the first row).
    ``ties='first'``: lowest row order wins a tie; ``'last'``: highest.  With
    an empty space every query is kept with nulls.

    Up to ``max_entries`` rows and entries the space is an index in every
    task and the queries do not move.  Beyond, queries and rows meet on
    shared components if these are shared by few; rows that share none have
    cosine 0, of which the first is the first place missing among those met.
    Components that many share would make nearly all pairs; queries then go
    to the blocks of the space that can hold their nearest row."""
    limit = MAX_INDEX_ENTRIES if max_entries is None else max_entries
    if _fits(space, limit):
        return add_nearest(queries, vec, space_index(space.long()), ties == "last")
    if not _meets_few(queries, id_cols, vec, space):
        return add_nearest_dealt(queries, vec, space.rows, space.entries, ties == "last")
    order = [F.col("row_order"), F.col("predicate")] if ties == "first" else [-F.col("row_order"), F.col("predicate")]
    met, placed = _joined_cosines(queries, id_cols, vec, space, order)
    n_rows = placed.count()
    # places are met in order until one is missing
    met = met.withColumn("_gap", F.row_number().over(Window.partitionBy(*id_cols).orderBy("place")) - 1)
    best = met.groupBy(*id_cols).agg(
        F.max(F.struct(F.round("sim", RANK_DIGITS).alias("k"), (-F.col("place")).alias("t"), F.col("sim"))).alias("b"),
        F.coalesce(F.min(F.when(F.col("place") != F.col("_gap"), F.col("_gap"))), F.count(F.lit(1))).cast("bigint").alias("gap"))
    out = queries.join(best, id_cols, "left").withColumn("gap", F.coalesce("gap", F.lit(0).cast("bigint")))
    unmet = F.when(F.col("gap") < n_rows, F.struct(F.lit(0.0).alias("k"), (-F.col("gap")).alias("t"), F.lit(0.0).alias("sim")))
    out = out.withColumn("b", F.greatest("b", unmet)).withColumn("place", -F.col("b.t"))
    names = placed.select("place", F.col("predicate").alias("nearest"), F.col("row_order").alias("nearest_order"))
    return out.join(names, "place", "left").select(*queries.columns, "nearest", "nearest_order", F.col("b.sim").alias("sim"))


def nearest_property(projections: DataFrame, space: Space, id_cols=("id",), vec: str = "vec",
                     max_entries: int | None = None) -> DataFrame:
    """H1: nearest space row by cosine; the first maximum in row order wins.
    The space is an index in every task up to ``max_entries`` rows and
    entries, otherwise an inverted index."""
    return _best_row(projections, list(id_cols), vec, space, "first", max_entries)


def inverse_mapping(mapping: DataFrame) -> DataFrame:
    """prop -> rel (the largest relation name when several share a prop)."""
    return mapping.groupBy("prop").agg(F.max("rel").alias("rel"))


def gated_predict(projections: DataFrame, space: Space, mapping: DataFrame, id_cols=("id",),
                  vec: str = "vec", gate: str = "gate", threshold: float = 0.5,
                  candidates: str = "mapped", max_entries: int | None = None) -> DataFrame:
    """H2: gate below ``threshold`` -> nearest row (H1) mapped back to its
    relation; otherwise ``no_relation``.  ``candidates='mapped'`` only
    searches rows that are mapping targets; ``'all'`` searches every row and
    yields a null relation for an unmapped one.  ``unexpected`` flags a
    nearest ``no_relation`` row."""
    inv = inverse_mapping(mapping)
    if candidates == "mapped":
        props = inv.select(F.col("prop").alias("predicate"))
        space = Space(space.rows.join(props, "predicate", "left_semi"),
                      space.entries.join(props, "predicate", "left_semi"), space.dims)
    elif candidates != "all":
        raise ValueError("candidates must be 'mapped' or 'all'")
    near = _best_row(projections, list(id_cols), vec, space, "first", max_entries)
    near = near.join(inv.select(F.col("prop").alias("nearest"), F.col("rel").alias("_nrel")),
                     "nearest", "left")
    return (near.withColumn("y_pred", F.when(F.col(gate) < threshold, F.col("_nrel"))
                            .otherwise(F.lit("no_relation")))
            .withColumn("unexpected", (F.col(gate) < threshold) & (F.col("nearest") == "no_relation"))
            .drop("_nrel"))


def class_scores(projections: DataFrame, space: Space, id_cols=("id",), vec: str = "vec",
                 max_entries: int | None = None) -> DataFrame:
    """``scores``: cosine of the projection with every space row, in row
    order (an array of numbers as long as the space has rows, which is the
    output itself).  Beyond ``max_entries`` the cosines of rows that share a
    component come from the inverted index; the others are 0."""
    limit = MAX_INDEX_ENTRIES if max_entries is None else max_entries
    if _fits(space, limit):
        return add_scores(projections, vec, space_index(space.long()))
    id_cols = list(id_cols)
    met, placed = _joined_cosines(projections, id_cols, vec, space, [F.col("row_order"), F.col("predicate")])
    found = met.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(F.struct("place", "sim"))).alias("_m"))
    none = F.create_map().cast("map<bigint,double>")
    return projections.join(found, id_cols, "left").withColumn(
        "scores", dense_from_map(F.coalesce("_m", none), placed.count())).drop("_m")


def integer_labels(mapping: DataFrame) -> DataFrame:
    """G2 (used by H3/H7): index of the prop in the sorted list of mapping
    values, i.e. the number of mapping entries with a smaller prop."""
    w = Window.orderBy("prop")  # mapping-sized input
    return mapping.withColumn("int_label", (F.rank().over(w) - 1).cast("bigint"))


def top_class(df: DataFrame, mapping: DataFrame, scores: str = "scores") -> DataFrame:
    """H3: index of the largest score (first on ties) -> the property at that
    position of the sorted mapping values -> relation (the inverse mapping)."""
    # class i = the i-th entry of the mapping values sorted as strings
    # (duplicates keep their positions); mapping-sized window
    pos = mapping.withColumn("_cls", (F.row_number().over(Window.orderBy("prop", "rel")) - 1).cast("bigint"))
    lab = (pos.select("_cls", F.col("prop").alias("_prop"))
           .join(inverse_mapping(mapping).withColumnRenamed("prop", "_prop"), "_prop")
           .select("_cls", F.col("rel").alias("y_pred")))
    out = df.withColumn("_cls", argmax_first(F.col(scores)).cast("bigint"))
    return out.join(F.broadcast(lab), "_cls", "left").drop("_cls")


def projection_loss_col(proj: str, target: str, no_rel: str):
    """Per row 1 - cosine(projection, target); 0 for a no-relation row."""
    cos = embedding_cosine(dot(F.col(proj), F.col(target)), sq_norm(F.col(proj)), sq_norm(F.col(target)))
    return F.when(F.col(no_rel), F.lit(0.0)).otherwise(F.lit(1.0) - cos)


def _safe_log_col(c):
    # ln(0) is null in Spark; the clamp makes it -100 as in the reference
    return F.coalesce(c, F.lit(LOG_CLAMP))


def projection_loss(df: DataFrame, proj: str = "vec", target: str = "target",
                    no_rel: str = "is_no_relation") -> DataFrame:
    """H4: mean over all rows (no-relation rows count as 0)."""
    return df.agg(F.avg(projection_loss_col(proj, target, no_rel)).alias("projection_loss"))


def _gate_terms(gate: str, attr: str):
    p, y = F.col(gate), F.col(attr)
    lp = F.greatest(_safe_log_col(F.log(p)), F.lit(LOG_CLAMP))
    l1p = F.greatest(_safe_log_col(F.log(F.lit(1.0) - p)), F.lit(LOG_CLAMP))
    return -(y * lp + (F.lit(1.0) - y) * l1p)


def gate_loss(df: DataFrame, gate: str = "gate", attr: str = "attribute") -> DataFrame:
    """H5: mean binary cross-entropy of the gate against the 0/1 flag."""
    return df.agg(F.avg(_gate_terms(gate, attr)).alias("gate_loss"))


def composed_loss(df: DataFrame, proj: str = "vec", target: str = "target",
                  no_rel: str = "is_no_relation", gate: str = "gate", attr: str = "attribute",
                  by: list[str] | None = None) -> DataFrame:
    """H6: projection loss + gate loss, and both parts (per group if ``by``)."""
    pl = F.avg(projection_loss_col(proj, target, no_rel)).alias("projection_loss")
    gl = F.avg(_gate_terms(gate, attr)).alias("gate_loss")
    g = df.groupBy(*by).agg(pl, gl) if by else df.agg(pl, gl)
    return g.withColumn("loss", F.col("projection_loss") + F.col("gate_loss"))


def cross_entropy(df: DataFrame, scores: str = "scores", label: str = "int_label") -> DataFrame:
    """H7: mean of log-sum-exp(scores) - scores[label] (stable form)."""
    s = F.col(scores)
    m = F.array_max(s)
    lse = m + F.log(F.aggregate(F.transform(s, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x))
    per_row = lse - F.element_at(s, F.col(label).cast("int") + 1)
    return df.agg(F.avg(per_row).alias("cross_entropy"))


def epoch_loss(df: DataFrame, batch: str = "batch_id", **cols) -> DataFrame:
    """H8: unweighted mean of the per-batch composed losses."""
    per_batch = composed_loss(df, by=[batch], **cols)
    return per_batch.agg(F.avg("loss").alias("epoch_loss"),
                         F.avg("projection_loss").alias("epoch_projection_loss"),
                         F.avg("gate_loss").alias("epoch_gate_loss"),
                         F.count(F.lit(1)).alias("n_batches"))
