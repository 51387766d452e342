"""Pattern selection and derived ("artificial") predicates (D1, D2, D4,
D9-D11)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ci_search, keyword_alternation
from tessera.operators.ontology import equivalent_properties, subtypes, values_frame
from tessera.session import checkpoint_dir

POSITIONS = ("subject", "predicate", "object")


def _check_position(position: str) -> None:
    if position not in POSITIONS:
        raise ValueError(f"position must be one of {POSITIONS}")


# a Python value list up to this size becomes an IN filter, which reaches
# the parquet scan (row-group skipping); longer lists are a broadcast semi-join
MAX_IN_LIST = 1000


def filter_exact(df: DataFrame, position: str, values) -> DataFrame:
    """Patterns whose ``position`` is one of ``values``.  A short Python
    list is an ``IN`` filter pushed to the scan; a longer list is
    broadcast; a DataFrame is a semi-join sized by AQE."""
    _check_position(position)
    if not isinstance(values, DataFrame) and len(set(values)) <= MAX_IN_LIST:
        return df.filter(F.col(position).isin(sorted(set(values))))
    v = values_frame(df.sparkSession, values, position)
    if not isinstance(values, DataFrame):
        v = F.broadcast(v)  # a list the driver already holds and ships with the plan
    return df.join(v.distinct(), position, "left_semi")


def filter_contains(df: DataFrame, position: str, keywords, escape: bool = False) -> DataFrame:
    """Case-insensitive regex search for any keyword; blanks inside a
    keyword split it into alternatives.  ``escape`` matches literally."""
    _check_position(position)
    return df.filter(F.coalesce(ci_search(F.col(position), keyword_alternation(keywords, escape)),
                                F.lit(False)))


def approximate_match(df: DataFrame, keywords, position: str = "predicate",
                      equiv: DataFrame | None = None) -> DataFrame:
    """Distinct predicates of the patterns matching the keywords at
    ``position``, plus their equivalent properties (one hop)."""
    preds = filter_contains(df, position, keywords).select(F.col("predicate").alias("value")).distinct()
    if equiv is None:
        return preds
    return preds.unionByName(equivalent_properties(preds, equiv)).distinct()


def artificial_property(df: DataFrame, label: str, preds, subjects=None, objects=None,
                        statistic: str = "frequency") -> DataFrame:
    """Keep patterns whose predicate is in ``preds``, object in
    ``objects`` and subject in ``subjects`` (``None`` or an empty list means
    no constraint), relabel the predicate and sum the statistic per
    (subject, predicate, object, pair); ordered by the sum, descending."""
    out = filter_exact(df, "predicate", preds)
    if objects is not None and (isinstance(objects, DataFrame) or len(objects) > 0):
        out = filter_exact(out, "object", objects)
    if subjects is not None and (isinstance(subjects, DataFrame) or len(subjects) > 0):
        out = filter_exact(out, "subject", subjects)
    out = (out.withColumn("predicate", F.lit(label))
           .groupBy("subject", "predicate", "object", "pair")
           .agg(F.sum(statistic).alias(statistic)))
    return out.orderBy(F.col(statistic).desc(), "subject", "object")


@dataclass
class Rule:
    """One derived predicate: predicate keywords (D4), subject roots and
    object roots expanded by D7, or explicit object values."""
    label: str
    keywords: list[str]
    subject_roots: list[str] | None = None
    object_roots: list[str] | None = None
    objects: list[str] | None = field(default=None)


def expand_roots(roots: DataFrame, subclass: DataFrame, equiv_classes: DataFrame | None) -> DataFrame:
    """(root, value): D7 for every root at once (one closure loop for all)."""
    closure = subtypes(roots, subclass, "value")
    out = closure.select("root", F.col("type").alias("value"))
    if equiv_classes is not None:
        eq = (closure.join(equiv_classes.select(F.col("a").alias("type"), "b"), "type")
              .select("root", F.col("b").alias("value")))
        out = out.unionByName(eq)
    return out.distinct()


def rule_members(df: DataFrame, rules: list[Rule], subclass: DataFrame | None,
                 equiv_classes: DataFrame | None, equiv_props: DataFrame | None):
    """Membership tables (rule, value) for predicates, subjects and objects,
    plus (rule, has_subjects, has_objects).  All subject/object roots of all
    rules are expanded by a single closure."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    # every rule's keywords are tried on a predicate at once, in one pass over
    # the distinct predicates; the small result is written, so its uses share it
    tried = F.array(*[F.when(ci_search(F.col("predicate"), keyword_alternation(r.keywords)), F.lit(r.label))
                      for r in rules])
    preds = (df.select("predicate").distinct()
             .select(F.explode(F.filter(tried, lambda label: label.isNotNull())).alias("rule"), "predicate")
             .checkpoint())
    if equiv_props is not None:
        also = (equiv_props.select(F.col("a").alias("predicate"), "b").join(preds, "predicate")
                .select("rule", F.col("b").alias("predicate")))
        preds = preds.unionByName(also)
    roots, fixed = [], []
    for r in rules:
        roots += [(r.label, "subject", x) for x in (r.subject_roots or [])]
        roots += [(r.label, "object", x) for x in (r.object_roots or [])]
        if not r.object_roots:
            fixed += [(r.label, "object", x) for x in (r.objects or [])]
    side_schema = "rule string, side string, value string"
    members = spark.createDataFrame(fixed, side_schema)
    if roots:
        rt = spark.createDataFrame(roots, "rule string, side string, root string")
        expanded = expand_roots(rt.select(F.col("root").alias("value")).distinct(), subclass,
                                equiv_classes)
        members = members.unionByName(F.broadcast(rt).join(expanded, "root").select("rule", "side", "value"))
    members = members.distinct()
    subs = members.filter(F.col("side") == "subject").select("rule", F.col("value").alias("subject"))
    objs = members.filter(F.col("side") == "object").select("rule", F.col("value").alias("object"))
    flags = spark.createDataFrame(
        [(r.label, bool(r.subject_roots), bool(r.object_roots or r.objects)) for r in rules],
        "rule string, has_subjects boolean, has_objects boolean")
    return preds.distinct(), subs, objs, flags


def artificial_properties(df: DataFrame, rules: list[Rule], subclass: DataFrame | None = None,
                          equiv_classes: DataFrame | None = None,
                          equiv_props: DataFrame | None = None,
                          statistic: str = "frequency") -> DataFrame:
    """Every rule applied to the same input, results concatenated.

    The patterns are read twice: once for their distinct predicates, which
    all rules' keywords are matched against, and once to be joined to the
    (rule, predicate) table (a pattern fans out only to the few rules naming
    its predicate) and
    checked against the (rule, subject) and (rule, object) tables; rules
    without a constraint on a side pass it."""
    preds, subs, objs, flags = rule_members(df, rules, subclass, equiv_classes, equiv_props)
    cand = df.join(preds, "predicate").join(F.broadcast(flags), "rule")  # flags: one row per rule
    s_ok = subs.withColumn("_s_ok", F.lit(True))
    o_ok = objs.withColumn("_o_ok", F.lit(True))
    cand = (cand.join(s_ok, ["rule", "subject"], "left").join(o_ok, ["rule", "object"], "left")
            .filter((~F.col("has_subjects") | F.col("_s_ok").isNotNull())
                    & (~F.col("has_objects") | F.col("_o_ok").isNotNull())))
    return (cand.groupBy("subject", F.col("rule").alias("predicate"), "object", "pair")
            .agg(F.sum(statistic).alias(statistic)))


def extend_profile(cleaned: DataFrame, artificial: DataFrame, statistic: str = "frequency",
                   artificial_src: int = 2) -> DataFrame:
    """Cleaned patterns followed by the derived ones (not cleaned
    again).  Derived rows get ``src`` = 2, after object (0) and datatype (1)
    patterns, so "first row wins" stays defined downstream."""
    cols = ["subject", "predicate", "object", statistic, "pair", "src"]
    art = artificial.withColumn("src", F.lit(artificial_src))
    return cleaned.select(*cols).unionByName(art.select(*cols))


# The derived-predicate rules of the reference profile
# (label, predicate keywords, subject root, object classes).
ORG = "http://dbpedia.org/ontology/Organisation"
PERSON = "http://dbpedia.org/ontology/Person"
CITY = ["http://dbpedia.org/ontology/City", "http://schema.org/City",
        "http://www.wikidata.org/entity/Q515", "http://wikidata.dbpedia.org/ontology/City"]
COUNTRY = ["http://dbpedia.org/ontology/Country", "http://schema.org/Country",
           "http://www.wikidata.org/entity/Q6256", "http://wikidata.dbpedia.org/ontology/Country"]
REGION = ["http://dbpedia.org/ontology/AdministrativeRegion", "http://schema.org/AdministrativeArea",
          "http://www.wikidata.org/entity/Q3455524",
          "http://wikidata.dbpedia.org/ontology/AdministrativeRegion"]
PROFILE_RULES = [
    Rule("org:city_of_headquarters", ["headquarter"], [ORG], objects=CITY),
    Rule("org:country_of_headquarters", ["headquarter"], [ORG], objects=COUNTRY),
    Rule("org:stateorprovince_of_headquarters", ["headquarter"], [ORG], objects=REGION),
    Rule("per:cities_of_residence", ["residence"], [PERSON], objects=CITY),
    Rule("per:countries_of_residence", ["residence"], [PERSON], objects=COUNTRY),
    Rule("per:stateorprovinces_of_residence", ["residence"], [PERSON], objects=REGION),
    Rule("org:alternate_names", ["alias", "alternatename"], [ORG]),
    Rule("per:alternate_names", ["alias", "alternatename"], [PERSON]),
    Rule("org:members", ["employee", "member"], [ORG], object_roots=[ORG]),
    Rule("per:employee_of", ["employee", "member"], [PERSON], object_roots=[ORG]),
    Rule("org:top_members_employees", ["employee", "member"], [ORG], object_roots=[PERSON]),
]
