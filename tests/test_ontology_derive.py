from conftest import pat_df, rows
from tessera.operators import derive as D
from tessera.operators import ontology as O


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_closure_handles_cycles_and_isolated_roots(spark):
    sub = edges(spark, [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")])
    got = rows(O.subtypes(O.values_frame(spark, ["a", "zz"]), sub))
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("zz", "zz")]


def test_equivalents_one_hop_directed(spark):
    eq = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert rows(O.equivalents(O.values_frame(spark, ["a"]), eq)) == [("b",)]


def test_subtypes_match_adds_equivalents_once(spark):
    sub = edges(spark, [("b", "a")])
    eq = spark.createDataFrame([("b", "B2"), ("B2", "B3")], "a string, b string")
    assert rows(O.subtypes_match(O.values_frame(spark, ["a"]), sub, eq)) == [("B2",), ("a",), ("b",)]


def test_resource_labels_lang_matches(spark):
    lab = spark.createDataFrame([("r1", "zeta", "en-US"), ("r1", "alpha", "EN"), ("r1", "x", "fr"),
                                 ("r2", "y", "english")], "resource string, label string, lang string")
    res = O.values_frame(spark, ["r1", "r2", "r3"], "resource")
    assert rows(O.resource_labels(res, lab, "en")) == [("r1", "alpha"), ("r2", "NULL"), ("r3", "NULL")]


def test_filter_contains_splits_multiword_keywords(spark):
    df = pat_df(spark, [("s", "birthPlace", "o", 1), ("s", "deathDate", "o", 1), ("s", "name", "o", 1)])
    got = rows(D.filter_contains(df, "predicate", ["birth death"]), "predicate")
    assert got == [("birthPlace",), ("deathDate",)]


def test_artificial_property_and_rules_table_agree(spark):
    df = pat_df(spark, [("Org", "hq", "City", 5), ("SubOrg", "hq", "City", 7), ("Person", "hq", "City", 1),
                        ("Org", "hq", "Lake", 2), ("Org", "other", "City", 9)])
    sub = edges(spark, [("SubOrg", "Org")])
    eq = spark.createDataFrame([], "a string, b string")
    subs = O.subtypes_match(O.values_frame(spark, ["Org"]), sub, eq)
    single = D.artificial_property(df, "org:hq_city", D.approximate_match(df, ["hq"]), subs, ["City"])
    table = D.artificial_properties(df, [D.Rule("org:hq_city", ["hq"], ["Org"], objects=["City"])], sub, eq, eq)
    cols = ("subject", "predicate", "object", "frequency")
    assert rows(single, *cols) == rows(table, *cols) == [("Org", "org:hq_city", "City", 5),
                                                         ("SubOrg", "org:hq_city", "City", 7)]


def test_rule_without_object_constraint(spark):
    df = pat_df(spark, [("Org", "alias", "x", 5), ("Org", "alias", "y", 2), ("P", "alias", "x", 1)])
    out = D.artificial_properties(df, [D.Rule("org:alternate_names", ["alias"], ["Org"])],
                                  edges(spark, []), None, None)
    assert rows(out, "subject", "object") == [("Org", "x"), ("Org", "y")]


def test_closure_of_a_deep_chain_takes_few_jobs(spark):
    edges = spark.createDataFrame([(f"t{i + 1}", f"t{i}") for i in range(1000)], "child string, parent string")
    group = "closure-of-a-chain"
    spark.sparkContext.setJobGroup(group, "")
    try:
        got = O.subtypes(O.values_frame(spark, ["t0", "t990"]), edges)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.groupBy("root").count().orderBy("root").collect() == [("t0", 1001), ("t990", 11)]
    assert jobs <= 12 * 12  # a round is a few jobs; a round a level would be thousands


def test_closure_of_a_cycle_and_of_shared_children(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "d"), ("e", "a"), ("d", "d")], "child string, parent string")
    got = sorted(map(tuple, O.subtypes(O.values_frame(spark, ["a", "d", "x"]), edges).collect()))
    assert got == sorted([("a", t) for t in "abcde"] + [("d", "d"), ("d", "e"), ("x", "x")])
