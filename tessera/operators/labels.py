"""Label encoding and data-quality checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.index import dense_index
from tessera.functions.text import tokens
from tessera.functions.vectors import array_sum
from tessera.operators.scoring import _best_row, dense_rows, integer_labels  # noqa: F401
from tessera.operators.space import Space
from tessera.session import checkpoint_dir, scratch_path

# Reserved ids of the sequence encoder.
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
RESERVED = [PAD, UNK, CLS, SEP]

#: Numbers (rows x width) of a vector table that is broadcast.
DEFAULT_MAX_BROADCAST_CELLS = 8_000_000


def map_relations(sent: DataFrame, mapping: DataFrame, on_missing: str = "error") -> DataFrame:
    """G1: ``prop`` of every ``rel``.  An unmapped relation fails the query (``'error'``) or gives
    null (``'null'``)."""
    out = sent.join(mapping.select("rel", "prop"), "rel", "left")
    if on_missing == "error":
        return out.withColumn("prop", F.when(F.col("prop").isNotNull(), F.col("prop")).otherwise(
            F.raise_error(F.concat(F.lit("unmapped relation: "), F.coalesce(F.col("rel"), F.lit("null"))))))
    if on_missing != "null":
        raise ValueError("on_missing must be 'error' or 'null'")
    return out


def unmapped_count(sent: DataFrame, mapping: DataFrame) -> DataFrame:
    """Number of rows whose relation has no mapping."""
    return (sent.join(mapping.select("rel"), "rel", "left_anti")
            .agg(F.count(F.lit(1)).alias("n_unmapped")))


def no_relation_flag(df: DataFrame, rel: str = "rel") -> DataFrame:
    """``is_no_relation`` and its 0.0/1.0 form ``attribute``."""
    flag = F.col(rel) == F.lit("no_relation")
    return (df.withColumn("is_no_relation", flag)
            .withColumn("attribute", F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))))


def _broadcast_if_small(dense: DataFrame, vec: str, max_cells: int) -> DataFrame:
    """Broadcast hint for a vector table of at most ``max_cells`` numbers
    (rows x width); a larger one is left to a shuffle join."""
    cells = dense.agg(F.coalesce(F.sum(F.size(vec)), F.lit(0))).first()[0]
    return F.broadcast(dense) if cells <= max_cells else dense


def label_vectors(rows: DataFrame, mapping: DataFrame, space: Space, rel: str = "rel",
                  max_dims: int = 1_000_000, max_broadcast_cells: int = DEFAULT_MAX_BROADCAST_CELLS) -> DataFrame:
    """Every row gets the dense vector (``target``) of its mapped
    property.  The space side is broadcast up to ``max_broadcast_cells``."""
    dense = dense_rows(space, max_dims).select(F.col("predicate").alias("prop"), F.col("vec").alias("target"))
    mapped = map_relations(rows, mapping) if "prop" not in rows.columns else rows
    return mapped.join(_broadcast_if_small(dense, "target", max_broadcast_cells), "prop", "left")


def check_label_vectors(stored: DataFrame, rows: DataFrame, mapping: DataFrame, space: Space,
                        id_col: str = "id", vec: str = "target") -> DataFrame:
    """Rows whose stored vector differs from the recomputed one, and the
    number of no-relation rows."""
    fresh = label_vectors(rows, mapping, space).select(id_col, "rel", F.col("target").alias("_fresh"))
    j = fresh.join(stored.select(id_col, F.col(vec).alias("_stored")), id_col, "left")
    return j.agg(F.count_if(~F.coalesce(F.col("_fresh") == F.col("_stored"), F.lit(False))).alias("n_mismatch"),
                 F.count_if(F.col("rel") == "no_relation").alias("n_no_relation"))


def check_nearest(vectors: DataFrame, space: Space, id_cols=("id",), vec: str = "vec",
                  prop: str = "prop") -> DataFrame:
    """Nearest space row of every vector by cosine (the *last* row wins
    a tie); only rows where it is not the expected property, with the
    vector's sum and the similarity."""
    near = _best_row(vectors, list(id_cols), vec, space, "last")
    return (near.filter(~F.col("nearest").eqNullSafe(F.col(prop)))
            .select(*id_cols, prop, "nearest", array_sum(F.col(vec)).alias("vec_sum"), "sim"))


def content_hash(vec: str) -> list:
    """128 bits of a vector's content, as two columns."""
    return [F.xxhash64(F.col(vec)).alias("_h1"), F.xxhash64(F.lit("vector"), F.col(vec)).alias("_h2")]


def check_vector_owner(vectors: DataFrame, space: Space, mapping: DataFrame, id_col: str = "id",
                       vec: str = "target", rel: str = "rel") -> DataFrame:
    """The space row equal to each vector must be the mapped property.
    Returns one row: rows checked, rows owned by their property, mismatches.

    Vectors meet on 128 bits of their content, never on the array.  Rows of
    one relation with one content are counted before the join (a vector that
    many rows have is one row there), together with the least and the
    greatest vector of the group, whose equality proves that all are equal;
    the owner's vector is compared with it after the join."""
    v = map_relations(vectors.select(id_col, rel, vec), mapping, "null")
    per_id = v.select(id_col, "prop", vec, *content_hash(vec))
    groups = per_id.groupBy("prop", "_h1", "_h2").agg(F.count_distinct(id_col).alias("n"), F.min(vec).alias("lo"), F.max(vec).alias("hi"))
    dense = dense_rows(space).select(F.col("predicate").alias("owner"), F.col("vec").alias("own_vec"), *content_hash("vec"))
    same = F.col("lo").eqNullSafe(F.col("own_vec")) & F.col("hi").eqNullSafe(F.col("own_vec"))
    met = groups.join(dense, ["_h1", "_h2"], "left").withColumn("_ok", F.coalesce(same & (F.col("owner") == F.col("prop")), F.lit(False)))
    each = met.groupBy("prop", "_h1", "_h2").agg(F.max("n").alias("n"), F.max("_ok").alias("_ok"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    owned = F.coalesce(F.sum(F.when(F.col("_ok"), F.col("n")).otherwise(0)), F.lit(0))
    return each.agg(total.alias("n_rows"), owned.alias("n_owned"), (total - owned).alias("n_mismatch"))


def corruption_check(vectors: DataFrame, space: Space, id_cols=("id",), vec: str = "vec",
                     tol: float = 1e-12) -> DataFrame:
    """Vectors with no space row at cosine 1 (within ``tol``)."""
    near = _best_row(vectors, list(id_cols), vec, space, "first")
    return near.withColumn("corrupt", F.col("sim") < F.lit(1.0 - tol))


def sentence_tokens(col, lower: bool = True):
    c = F.lower(col) if lower else col
    return tokens(c)


def build_vocabulary(df: DataFrame, col: str = "sentence", lower: bool = True) -> DataFrame:
    """Token -> id by descending count (tie: token); ids start after the
    reserved ones.  One dense-index pass over the distinct tokens."""
    counts = (df.select(F.explode(sentence_tokens(F.col(col), lower)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = dense_index(counts.withColumn("_neg", -F.col("n")), ["_neg", "token"], "idx")
    return ranked.select("token", "n", (F.col("idx") + len(RESERVED)).alias("token_id"))


#: Tokens looked up where the sentence is, and the lists that they are dealt to.
HOT_TOKENS, HOT_LISTS = 4096, 2048


def _hot_ids(vocab: DataFrame, toks: Column) -> Column:
    """The id of each token of the array ``toks`` that is among the
    ``HOT_TOKENS`` least ids, null for the others.  A vocabulary numbers
    frequent tokens first (G9), so few are left to be joined.  The table is a
    constant: lists of a few tokens each, by hash."""
    def place(c):
        return F.pmod(F.hash(c), F.lit(HOT_LISTS))

    hot = (vocab.filter(F.col("token").isNotNull() & F.col("token_id").isNotNull()).orderBy("token_id", "token").limit(HOT_TOKENS)
           .select("token", F.col("token_id").cast("int").alias("token_id"), place(F.col("token")).alias("at")).collect())
    lists = [{} for _ in range(HOT_LISTS)]
    for r in hot:
        lists[r["at"]][r["token"]] = r["token_id"]
    table = F.from_json(F.lit(json.dumps(lists)), "array<map<string,int>>")
    return F.transform(toks, lambda t: F.try_element_at(F.get(table, place(t)), t))


def _grouped_sequences(df: DataFrame, vocab: DataFrame, id_col: str, kept) -> DataFrame:
    """(id, ``_ids``) for every row; rows of one id share their tokens, by position."""
    toks = df.select(id_col, F.posexplode(kept).alias("pos", "token"))
    ids = (toks.join(vocab.select("token", "token_id"), "token", "left")
           .withColumn("token_id", F.coalesce("token_id", F.lit(RESERVED.index(UNK))).cast("int")))
    seq = ids.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("_s"))
    return df.select(id_col).join(seq, id_col, "left").select(
        id_col, F.coalesce(F.transform("_s", lambda x: x["token_id"]), F.array().cast("array<int>")).alias("_ids"))


def _sequences(df: DataFrame, vocab: DataFrame, id_col: str, col: str, max_length: int, lower: bool,
               keep: list[str]) -> tuple[DataFrame, DataFrame | None, int]:
    """Unpadded encodings ``_enc`` of the rows whose id does not repeat, with
    the columns ``keep``; those of the others (None if there is none), without
    them; and the longest one's length.  A row without an id has no tokens.

    Rows are written once with the ids found in place; what is left of a row
    meets the vocabulary under the row's number, not its id or its text.  Rows
    of repeated ids, and all if a token of the vocabulary repeats, are grouped
    by id."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    # cut before the lookup: what is beyond ``max_length`` never leaves its row
    kept = F.slice(sentence_tokens(F.col(col), lower), 1, max_length - 2)
    vocab = vocab.select("token", "token_id")
    none = F.array().cast("array<string>")
    rows = df.select(id_col, *keep, F.when(F.col(id_col).isNotNull(), F.coalesce(kept, none)).otherwise(none).alias("_toks"))
    rows = rows.withColumn("_ids", _hot_ids(vocab, F.col("_toks")))
    left = F.when(F.exists("_ids", lambda x: x.isNull()), F.filter(
        F.transform("_ids", lambda x, i: F.when(x.isNull(), F.struct(i.alias("pos"), F.get("_toks", i).alias("token")))), lambda x: x.isNotNull()))
    rows = rows.select(id_col, *keep, "_ids", left.alias("_left"), F.monotonically_increasing_id().alias("_row"))
    path = scratch_path(spark, "sequences")
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)

    h, many = F.xxhash64(id_col), None
    again = vocab.filter(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = rows.filter(F.col(id_col).isNotNull()).groupBy(h.alias("_h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_h").checkpoint()
    if not again.isEmpty():
        rows, many = rows.filter(F.lit(False)), df
    elif not several.isEmpty():
        own = F.when(F.col(id_col).isNotNull(), h)
        many = df.withColumn("_h", own).join(several, "_h", "left_semi").drop("_h")
        rows = rows.withColumn("_h", own).join(several, "_h", "left_anti").drop("_h")

    rest = (rows.filter(F.col("_left").isNotNull()).select("_row", F.explode("_left").alias("t"))
            .select("_row", "t.pos", "t.token").join(vocab, "token", "left")
            .select("_row", "pos", F.coalesce("token_id", F.lit(RESERVED.index(UNK))).cast("int").alias("token_id")))
    rest = rest.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token_id"))).alias("_rest"))
    filled = F.transform("_ids", lambda x, i: F.coalesce(x, F.try_element_at("_rest", i)))
    longest = rows.agg(F.max(F.size("_ids"))).first()[0] or 0
    rows = rows.drop("_left").join(rest, "_row", "left").withColumn("_ids", F.when(F.col("_rest").isNull(), F.col("_ids")).otherwise(filled))

    def enc(some, *cols):
        return some.select(id_col, *cols, F.concat(F.array(F.lit(RESERVED.index(CLS))), "_ids", F.array(F.lit(RESERVED.index(SEP)))).alias("_enc"))

    if many is not None:
        many = enc(_grouped_sequences(many, vocab, id_col, kept)).checkpoint()
        longest = max(longest, (many.agg(F.max(F.size("_enc"))).first()[0] or 0) - 2)
    return enc(rows, *keep), many, longest + 2


def _padded(seq: DataFrame, longest: int, *cols: str) -> DataFrame:
    gap = F.lit(longest) - F.size("_enc")
    return seq.select(
        *cols, F.concat("_enc", F.array_repeat(F.lit(RESERVED.index(PAD)), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_enc")), F.array_repeat(F.lit(0), gap)).alias("attention_mask"))


def encode_sequences(df: DataFrame, vocab: DataFrame, id_col: str = "id", col: str = "sentence",
                     max_length: int = 160, lower: bool = True) -> DataFrame:
    """``input_ids`` = [CLS] ids [SEP], truncated to ``max_length``,
    right-padded with [PAD] to the longest row of the set; ``attention_mask``
    1 for real tokens, 0 for padding.  The first tokens of the vocabulary are
    looked up where the sentence is, the others by an equi-join (unknown ->
    [UNK]).  Rows that share an id share their tokens."""
    rows, many, longest = _sequences(df, vocab, id_col, col, max_length, lower, [])
    return _padded(rows if many is None else rows.unionByName(many), longest, id_col)


def check_encoding(encoded: DataFrame, df: DataFrame, vocab: DataFrame, id_col: str = "id",
                   col: str = "sentence", max_length: int = 160) -> DataFrame:
    """Rows whose stored ids differ from a fresh encoding (padding
    removed before comparing)."""
    rows, many, _ = _sequences(df, vocab, id_col, col, max_length, True, [])
    fresh = rows if many is None else rows.unionByName(many)
    real = F.filter(F.arrays_zip("input_ids", "attention_mask"), lambda x: x["attention_mask"] == 1)
    h = F.xxhash64(id_col).alias("_h")  # numbers are sorted faster than ids
    a = fresh.select(h, id_col, F.col("_enc").alias("_a"))
    b = encoded.select(h, id_col, F.transform(real, lambda x: x["input_ids"]).alias("_b"))
    return (a.join(b, ["_h", id_col], "full_outer")
            .filter(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).select(id_col))


def mini_batches(df: DataFrame, size: int = 128, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Rows in a seeded shuffled order cut into batches of ``size`` (the
    last one may be short): ``batch_id`` and ``pos_in_batch``.  The order is
    that of the md5 of ``seed:id``, which other engines have too."""
    keyed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    idx = dense_index(keyed, ["_h", id_col], "_idx")
    return (idx.withColumn("batch_id", F.floor(F.col("_idx") / size).cast("bigint"))
            .withColumn("pos_in_batch", (F.col("_idx") % size).cast("bigint")).drop("_h", "_idx"))


def training_rows(sent: DataFrame, mapping: DataFrame, space: Space, vocab: DataFrame,
                  id_col: str = "id", max_length: int = 160) -> DataFrame:
    """The eight fields of one training row: input ids, attention mask,
    label vector, relation, property, integer label, no-relation flag and
    its 0/1 float."""
    rows, many, longest = _sequences(sent, vocab, id_col, "sentence", max_length, True, ["rel"])
    if many is not None:
        rows = rows.unionByName(many.join(sent.select(id_col, "rel"), id_col).select(*rows.columns))
    enc = _padded(rows.filter(F.col(id_col).isNotNull()), longest, id_col, "rel")
    lv = label_vectors(enc, mapping, space)
    il = F.broadcast(integer_labels(mapping).select("prop", "int_label").distinct())
    return no_relation_flag(lv.join(il, "prop", "left")).select(
        id_col, "input_ids", "attention_mask", "target", "rel", "prop", "int_label", "is_no_relation", "attribute")
