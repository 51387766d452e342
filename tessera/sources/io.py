"""Sources and sinks (A4-A8) and writers for the text formats read by A1/A2.

Tables are exchanged as parquet; the wide CSV of the property space is an
export of ``to_wide``.  Writers never funnel data through one task: every
file format here is written by all partitions in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.index import dense_index, lines_in_file_order
from tessera.operators.space import Space, to_wide


# ------------------------------------------------------------------ A2 writer
def write_marked_records(df: DataFrame, path: str, order_cols: list[str], compression: str | None = None) -> None:
    """Writes (sentence, relation) as 4-line records (``id<TAB>"sentence"``,
    relation, ``Comment:``, blank) in ``order_cols`` order.  The output is
    range-partitioned, so part-file order is record order.  ``compression``
    names a codec of Spark's text files, such as ``gzip``, which the readers
    undo; a file is then read by one task."""
    rec = (df.orderBy(*order_cols)
           .select(F.concat_ws("\n",
                               F.concat(F.monotonically_increasing_id().cast("string"), F.lit('\t"'),
                                        F.col("sentence"), F.lit('"')),
                               F.col("relation"), F.lit("Comment:"), F.lit("")).alias("value")))
    rec.write.mode("overwrite").text(path, compression=compression)


# ------------------------------------------------------------------ A4
def write_sentences(df: DataFrame, path: str) -> None:
    """A4 (dump): the prepared sentence table as parquet."""
    df.write.mode("overwrite").parquet(path)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """A4 (reload)."""
    return spark.read.parquet(path)


# quotes inside a field are doubled, as data-frame dumps write them
_CSV_KEEP_SPACES = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
                    "quote": '"', "escape": '"', "multiLine": True}


def _without_index(df: DataFrame) -> DataFrame:
    """Drops the unnamed first column of a data-frame dump."""
    first = df.columns[0]
    return df.drop(first) if first in ("", "_c0", "Unnamed: 0") else df


def write_sentences_csv(df: DataFrame, path: str) -> None:
    """A4 as CSV with a header; entity text keeps its surrounding blanks and
    an empty type string is written as an empty field."""
    df.write.mode("overwrite").options(**_CSV_KEEP_SPACES).csv(path)


def read_sentences_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4 reload from CSV (all columns strings), from ``write_sentences_csv``
    or a data-frame dump with an unnamed index column.  An empty type comes
    back missing (null)."""
    return _without_index(spark.read.options(**_CSV_KEEP_SPACES).csv(path))


# ------------------------------------------------------------------ A5
def write_space(space: Space, path: str) -> None:
    """A5 (dump): the three tables of a space as parquet folders."""
    space.rows.write.mode("overwrite").parquet(f"{path}/rows")
    space.entries.write.mode("overwrite").parquet(f"{path}/entries")
    space.dims.write.mode("overwrite").parquet(f"{path}/dims")


def read_space(spark: SparkSession, path: str) -> Space:
    """A5 (reload)."""
    return Space(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/entries"),
                 spark.read.parquet(f"{path}/dims"))


def write_space_wide_csv(space: Space, path: str, max_cols: int = 1000) -> None:
    """A5 wide export: predicate and row order first, one column ``c<k>`` per
    component."""
    to_wide(space, max_cols).write.mode("overwrite").option("header", True).csv(path)


def read_space_wide_csv(spark: SparkSession, path: str) -> Space:
    """A5 reload of a wide table as a sparse space (zeros dropped).

    Reads the export above, and data-frame dumps: there the first, unnamed
    column holds the predicates, rows are in file order, and every other
    column is a component named by its label (a number or ``add<k>``).
    Components are numbered in column order and keep their labels."""
    wide = spark.read.options(**_CSV_KEEP_SPACES).csv(path)
    if "predicate" in wide.columns and "row_order" in wide.columns:
        keys, order = wide.columns[:2], F.col("row_order").cast("bigint")
        wide = wide.withColumn("row_order", order)
    else:
        first = wide.columns[0]
        named = wide.withColumnRenamed(first, "predicate").withColumns(
            {"_file": F.col("_metadata.file_path"), "_mid": F.monotonically_increasing_id()})
        wide = dense_index(named, ["_file", "_mid"], "row_order").drop("_file", "_mid")
        keys = ["predicate", "row_order"]
    comp = [c for c in wide.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias("component"), F.col(f"`{c}`").cast("double").alias("value"))
                      for k, c in enumerate(comp)])
    entries = (wide.select("predicate", F.explode(pairs).alias("e")).select("predicate", "e.component", "e.value")
               .filter(F.col("value") != 0))
    dims = spark.createDataFrame(list(enumerate(comp)), "component bigint, label string")
    return Space(wide.select("predicate", "row_order"), entries, dims)


# ------------------------------------------------------------------ A6
def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{relation: property}`` as (rel, prop)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,string>")
    return raw.select(F.explode(m).alias("rel", "prop"))


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Writes (rel, prop) as one JSON object (a mapping is dictionary-sized)."""
    obj = mapping.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("rel", "prop")))).alias("value"))
    obj.write.mode("overwrite").text(path)


# ------------------------------------------------------------------ A7
def read_property_list(spark: SparkSession, path: str) -> DataFrame:
    """One predicate per line, in file order (files in name order, as
    Spark names its part files), stopping at the first blank line
    (trailing whitespace removed); (predicate, row_order).  Files are
    placed by a prefix sum over per-file line counts (one row per file)."""
    lines = lines_in_file_order(spark, path).withColumn("v", F.regexp_replace("value", r"\s+$", ""))
    per_file = lines.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offs = per_file.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    g = lines.join(offs, "file").withColumn("row_order", (F.col("_off") + F.col("line_no")).cast("bigint"))
    stop = g.filter(F.col("v") == "").agg(F.min("row_order")).first()[0]
    if stop is not None:
        g = g.filter(F.col("row_order") < F.lit(stop))
    return g.select(F.col("v").alias("predicate"), "row_order")


def write_lines(df: DataFrame, col: str, path: str, order_cols: list[str]) -> None:
    """One value per line, range-partitioned in ``order_cols`` order."""
    df.orderBy(*order_cols).select(F.col(col).alias("value")).write.mode("overwrite").text(path)


# ------------------------------------------------------------------ A8
def materialise_label_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Write the label vectors once and return the reloaded table (the
    written copy also cuts the lineage of the computation)."""
    vectors.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)
