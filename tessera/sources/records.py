"""Marked-sentence records (A2) and the keep-last-label dedupe (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.index import lines_in_file_order, numbered_lines

_RECORD_LINES = 4


def sentence_from_line(value):
    """Characters after ``<TAB>"`` up to, not including, the final quote.
    Without a tab the text starts at the second character."""
    tab = F.instr(value, "\t")
    length = F.greatest(F.length(value) - tab - F.lit(2), F.lit(0))
    return F.substring(value, tab + F.lit(2), length)


def assemble_records(lines: DataFrame, file: str = "file") -> DataFrame:
    """Groups numbered lines (``file``, ``line_no``, ``value``) four at a
    time; a trailing record missing its fourth line is dropped."""
    rec = F.floor(F.col("line_no") / _RECORD_LINES).cast("bigint")
    k = F.col("line_no") % _RECORD_LINES
    g = (lines.groupBy(file, rec.alias("rec_id"))
         .agg(F.max(F.when(k == 0, F.col("value"))).alias("_l1"),
              F.max(F.when(k == 1, F.col("value"))).alias("relation"),
              F.count(F.lit(1)).alias("_n")))
    return (g.filter(F.col("_n") == _RECORD_LINES)
            .select(file, "rec_id", sentence_from_line(F.col("_l1")).alias("sentence"), "relation"))


def read_marked_records(spark: SparkSession, path: str, by_number: bool = False) -> DataFrame:
    """A2: (file, rec_id, sentence, relation) from 4-line text records.
    ``by_number``: with ``file_no``, the file's place in the order of the
    paths, instead of its path, which is many times longer than a record."""
    if by_number:
        return assemble_records(numbered_lines(spark, path), "file_no")
    return assemble_records(lines_in_file_order(spark, path))


def dedupe_last_label(df: DataFrame, key: str = "sentence", order: str = "ord",
                      label: str = "relation") -> DataFrame:
    """A3: one row per ``key``: position of the first occurrence
    (``first_ord``) and the label of the last occurrence (an exact tie in
    ``order`` takes the larger label).  Both aggregates combine map-side,
    so a repeated key does not pile up in one task; ``max`` of a struct is
    cheaper here than ``max_by``."""
    last = F.max(F.struct(F.col(order).alias("o"), F.col(label).alias("v")))
    return (df.groupBy(key).agg(F.min(order).alias("first_ord"), last.alias("_last"))
            .select(key, "first_ord", F.col("_last.v").alias(label)))
