"""Dense 0-based ordering ids without a single-partition window.

The ordered data is range-partitioned and sorted inside each partition;
per-partition row counts (one row per partition) give each partition its
starting offset.  Range bounds come from sampling, so the sorted data is
checkpointed to the shared checkpoint folder first: the count pass and
the id pass then read identical partitions, and a lost executor re-reads
the checkpoint instead of re-sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


def _offsets(tagged: DataFrame, part_cols: list[str]) -> DataFrame:
    """Start offset of every chunk.  One row per chunk (a partition or a
    file split), so this window works on metadata-sized input."""
    starts = tagged.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("_n"),
                                            F.min("_mid").alias("_m0"))
    w = Window.orderBy(*part_cols).rowsBetween(Window.unboundedPreceding, -1)
    return starts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def dense_index(df: DataFrame, order_cols: list[str], out: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = 0-based position of each row in ``order_cols`` order.

    Ties are broken by the full row order of ``order_cols``; give unique keys
    for a repeatable id.  Runs two small jobs (checkpoint + offsets)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(n, *order_cols)
               .sortWithinPartitions(*order_cols)
               .checkpoint(eager=True))
    tagged = (ordered.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    offs = _offsets(tagged, ["_pid"])
    # one row per partition: a proven size bound
    out_df = tagged.join(F.broadcast(offs), "_pid")
    return (out_df.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("bigint"))
            .drop("_pid", "_mid", "_n", "_m0", "_off"))


def lines_in_file_order(spark, path: str) -> DataFrame:
    """Text lines with ``file`` and 0-based ``line_no`` inside their file.

    File splits are read in a deterministic layout, so the row position in a
    split (from ``monotonically_increasing_id``) plus the rows of the earlier
    splits of the same file gives the line number; no shuffle of the lines."""
    return numbered_lines(spark, path).select("file", "line_no", "value")


def numbered_lines(spark, path: str) -> DataFrame:
    """``lines_in_file_order`` with ``file_no``, the place of the file in the
    order of the paths: a number to sort and group by instead of the path."""
    lines = (spark.read.text(path)
             .select("value",
                     F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("_blk"),
                     F.monotonically_increasing_id().alias("_mid")))
    offs = _chunk_offsets(lines).withColumn("file_no", F.dense_rank().over(Window.orderBy("file")).cast("bigint"))
    # one row per file split: a proven size bound, and the lines stay where they are read
    return (lines.join(F.broadcast(offs), ["file", "_blk"])
            .withColumn("line_no", (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("bigint"))
            .select("file", "file_no", "line_no", "value"))


def _chunk_offsets(lines: DataFrame) -> DataFrame:
    starts = lines.groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_mid").alias("_m0"))
    w = (Window.partitionBy("file").orderBy("_blk")
         .rowsBetween(Window.unboundedPreceding, -1))
    return starts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
