"""End-to-end compositions of the operators, for users of the original
profile -> space and dataset-preparation steps.  Each is a plain chain of
library calls and returns lazy DataFrames (the closure loop and the dense
ids run their small actions as documented on those operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.cleaning import clean
from tessera.operators.derive import PROFILE_RULES, Rule, artificial_properties, extend_profile
from tessera.operators.sentences import prepare_sentences
from tessera.operators.space import PROFILE_CLONES, Space, build_space
from tessera.sources.io import read_property_list
from tessera.sources.patterns import read_patterns
from tessera.sources.records import read_marked_records


def profile_table(spark: SparkSession, profile_dir: str, subclass: DataFrame | None = None,
                  equiv_classes: DataFrame | None = None, equiv_props: DataFrame | None = None,
                  statistic: str = "frequency", do_clean: bool = True,
                  rules: list[Rule] | None = PROFILE_RULES) -> DataFrame:
    """A1 -> B6 (optional) -> D10 + D11.  Without ``subclass`` a root stands
    for itself alone."""
    df = read_patterns(spark, profile_dir, statistic)
    if do_clean:
        df = clean(df, statistic=statistic)
    if rules:
        if subclass is None:
            subclass = spark.createDataFrame([], "child string, parent string")
        art = artificial_properties(df, rules, subclass, equiv_classes, equiv_props, statistic)
        df = extend_profile(df, art, statistic)
    return df


def relation_space(spark: SparkSession, profile: DataFrame, property_list_path: str | None,
                   clones: list[str] | None = PROFILE_CLONES, statistic: str = "frequency") -> Space:
    """E10 over the listed properties (A7), with the clone rows and the
    ``no_relation`` filler; ``property_list_path=None`` keeps every predicate."""
    plist = read_property_list(spark, property_list_path) if property_list_path else None
    return build_space(profile, plist, clones, statistic=statistic)


def prepared_dataset(spark: SparkSession, records_path: str, tags: DataFrame) -> DataFrame:
    """A2 -> F7: (sentence, relation, rel, e1, e2, e1_type_CNLP, e2_type_CNLP).
    ``tags`` is the tagger output keyed by sentence."""
    from pyspark.sql import functions as F
    recs = read_marked_records(spark, records_path, by_number=True).withColumn("ord", F.struct("file_no", "rec_id"))
    return prepare_sentences(recs.select("sentence", "relation", "ord"), tags)
