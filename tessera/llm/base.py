"""Shared pieces: table readers, Arrow maps and row identity."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import bound_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package


def per_process(key, make: Callable):
    """What ``make`` builds, kept for later tasks of the same Python worker
    (tables that are bounded, and costly to build again for each task).  A
    worker keeps the tables of one operator at a time."""
    kept = sys.__dict__.setdefault("_tessera_worker_kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def free_worker() -> None:
    """Lets go of the tables of other operators at the start of a task."""
    sys.__dict__.setdefault("_tessera_worker_kept", {}).clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``: further columns, whatever their names,
    never meet the columns an operator makes."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                     F.col("text").cast("string").alias("text"))


def text_key() -> list[Column]:
    """Identity of a row for joining a verdict back: equal (doc_id, text)
    rows always get equal verdicts, so repeated ids need no other key."""
    return [F.col("doc_id").cast("bigint").alias("_key_id"),
            F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_key_text")]


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text) is in ``keys``
    (columns of ``text_key``); all columns of ``docs`` are kept."""
    cols = docs.columns
    tagged = docs.select("*", text_key()[0].alias("__tessera_id"), text_key()[1].alias("__tessera_text"))
    cond = (F.col("__tessera_id").eqNullSafe(F.col("_key_id"))
            & (F.col("__tessera_text") == F.col("_key_text")))
    return tagged.join(keys.select("_key_id", "_key_text"), cond, "left_anti").select(*[F.col(f"`{c}`") for c in cols])


def keep_rows(docs: DataFrame, make_mask: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Rows of ``docs`` for which the mask over ``text`` is true.
    ``make_mask`` runs once per task and returns the function that maps a
    list of texts (null: None) to a list of booleans."""
    at = docs.columns.index("text")
    bound_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        mask = make_mask()
        for b in batches:
            yield b.filter(pa.array(mask(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


#: Keys with over 1 in ``HOT_SHARE`` of all rows are joined by broadcast.
HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row per key, with the number of
    rows of the key in ``count``; ``total`` is the sum of all counts).  The
    facts of hot keys are fewer than ``HOT_SHARE`` by arithmetic and are
    broadcast; no key left for the shuffle holds more than its share.
    ``facts`` is read twice: give a written or checkpointed table."""
    hot = facts.filter(F.col(count) * HOT_SHARE > total)
    cold = facts.filter(F.col(count) * HOT_SHARE <= total)
    there = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return there.unionByName(rest.join(cold, key, how))
