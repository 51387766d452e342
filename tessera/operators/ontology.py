"""Ontology expansion over edge tables.

The reference asks a remote endpoint one value at a time; here the
ontology facts are DataFrames supplied by the caller:

* ``subclass`` (child, parent)
* ``equiv``    (a, b)               equivalent classes or properties, directed as stored
* ``labels``   (resource, label, lang)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


def values_frame(spark: SparkSession, values, col: str = "value") -> DataFrame:
    """A list of strings (bounded by the caller) or a one-column DataFrame."""
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).alias(col))
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


def equivalents(values: DataFrame, equiv: DataFrame, col: str = "value") -> DataFrame:
    """One hop ``value -> equivalent`` (set semantics, not transitive; the
    inputs themselves are not included)."""
    v = values.select(F.col(col).alias("a")).distinct()
    return equiv.join(v, "a", "left_semi").select(F.col("b").alias(col)).distinct()


def equivalent_properties(values: DataFrame, equiv: DataFrame, col: str = "value") -> DataFrame:
    """D3."""
    return equivalents(values, equiv, col)


def equivalent_classes(types: DataFrame, equiv: DataFrame, col: str = "value") -> DataFrame:
    """D6."""
    return equivalents(types, equiv, col)


def subtypes(types: DataFrame, subclass: DataFrame, col: str = "value") -> DataFrame:
    """Reflexive-transitive closure downwards (``child subClassOf* root``)
    as distinct (root, type); every root is included even without edges.

    Path doubling: the pairs at a distance of 1, 2, 4, ... edges come from
    joining the pairs of half the distance with themselves, and each table
    carries what is reached so far that much further, so after the table of
    2^i every distance below 2^(i+1) is covered.  The number of jobs is the
    logarithm of the depth.  In a tree each table has at most one pair for
    each type below it.  The loop ends when no pair is that far apart, or, as cycles
    have pairs at any distance, when the distance exceeds the number of
    edges.  Every table is checkpointed to the shared folder."""
    checkpoint_dir(types.sparkSession)
    steps = subclass.select(F.col("parent").alias("type"), F.col("child")).distinct().checkpoint()
    reach = types.select(F.col(col).alias("root"), F.col(col).alias("type")).distinct().checkpoint()
    longest, distance = steps.count(), 1
    while distance <= longest:
        further = reach.join(steps, "type").select("root", F.col("child").alias("type"))
        reach = reach.unionByName(further).distinct().checkpoint()
        distance *= 2
        if distance > longest:
            break
        on = steps.select(F.col("type").alias("child"), F.col("child").alias("_next"))
        steps = steps.join(on, "child").select("type", F.col("_next").alias("child")).distinct().checkpoint()
        if steps.isEmpty():
            break
    return reach


def subtypes_match(types: DataFrame, subclass: DataFrame, equiv: DataFrame,
                   col: str = "value") -> DataFrame:
    """All subtypes (D5) plus the equivalent classes of those (D6, one
    hop, not closed again), as distinct ``col``."""
    sub = subtypes(types, subclass, col).select(F.col("type").alias(col))
    return sub.unionByName(equivalent_classes(sub, equiv, col)).distinct()


def lang_matches(lang, wanted: str):
    """SPARQL ``langMatches(lang, wanted)`` for a plain range: equal, or a
    sub-tag (``wanted-...``), ignoring case."""
    lw = F.lower(lang)
    w = wanted.lower()
    return (lw == F.lit(w)) | lw.startswith(w + "-")


def resource_labels(resources: DataFrame, labels: DataFrame, lang: str = "en",
                    col: str = "resource", missing: str = "NULL") -> DataFrame:
    """One label per resource in the wanted language (the smallest when
    several), ``"NULL"`` when it has none."""
    lab = (labels.filter(lang_matches(F.col("lang"), lang))
           .groupBy("resource").agg(F.min("label").alias("label")))
    r = resources.select(F.col(col).alias("resource")).distinct()
    return (r.join(lab, "resource", "left")
            .select("resource", F.coalesce("label", F.lit(missing)).alias("label")))
