from pyspark.sql import functions as F

from conftest import pat_df, rows
from tessera.operators import cleaning as B
from tessera.operators import explore as C
from tessera.sources.patterns import read_patterns


def test_keyword_filter_ignores_case(spark):
    df = pat_df(spark, [("a", "WikiPageID", "b", 20), ("a", "name", "b", 20), ("a", "x_wIKI", "c", 3)])
    assert rows(B.drop_keyword_predicates(df, "wiki"), "predicate") == [("name",)]


def test_rare_pairs_count_rows_not_frequency(spark):
    df = pat_df(spark, [("s", "p1", "o", 100), ("s", "p2", "o", 1), ("t", "p1", "o", 500)])
    # (t, o) occurs in one row only -> removed, whatever its frequency
    assert rows(B.drop_rare_pairs(df, 1), "subject", "predicate") == [("s", "p1"), ("s", "p2")]


def test_rare_pair_removal_is_by_pair_string(spark):
    # ('a#-#b','c') and ('a','b#-#c') share the pair string; the first is rare,
    # so both rows go, as a membership test on the string does
    df = pat_df(spark, [("a#-#b", "p", "c", 5), ("a", "p", "b#-#c", 5), ("a", "q", "b#-#c", 5)])
    assert B.drop_rare_pairs(df, 1).count() == 0


def test_clean_steps_do_not_commute(spark):
    # after the frequency filter p1 keeps one pattern and is dropped by B5
    df = pat_df(spark, [("s", "p1", "o", 50), ("s", "p1", "o2", 5), ("s", "p2", "o", 50), ("s", "p2", "o2", 50),
                        ("x", "p3", "y", 50)])
    out = rows(B.clean(df, kw="wiki", pair_n=1, min_freq=10, pred_n=1), "predicate", "object")
    assert out == [("p2", "o"), ("p2", "o2")]


def test_clean_property_every_predicate_keeps_more_than_n(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["p", "q", "wiki", "r"]),
                              st.sampled_from("xyz"), st.integers(0, 30)), min_size=1, max_size=25))
    def check(data):
        out = B.clean(pat_df(spark, data), min_freq=5, pred_n=1)
        counts = out.groupBy("predicate").count().collect()
        assert all(r["count"] > 1 for r in counts)
        assert out.filter(F.col("frequency") <= 5).count() == 0
        assert out.filter(F.col("predicate").contains("wiki")).count() == 0

    check()


def test_null_becomes_nan_and_groups(spark, tmp_dir):
    import os
    os.makedirs(tmp_dir + "/p", exist_ok=True)
    with open(tmp_dir + "/p/object_akp.txt", "w") as f:
        f.write("A;;B;3\nA;knows;B;4\n")
    with open(tmp_dir + "/p/datatype_akp.txt", "w") as f:
        f.write(";knows;B;1\n")
    df = read_patterns(spark, tmp_dir + "/p")
    got = rows(df, "subject", "predicate", "object", "frequency", "src", "pair")
    assert got == [("A", "knows", "B", 4, 0, "A#-#B"), ("A", "nan", "B", 3, 0, "A#-#B"),
                   ("nan", "knows", "B", 1, 1, "nan#-#B")]


def test_summary_and_single_rare_keeps_code_meaning(spark):
    df = pat_df(spark, [("s", "p1", "o", 1), ("s", "p1", "o2", 50), ("t", "p2", "o", 1), ("t", "p2", "o3", 1),
                        ("u", "p3", "v", 7)])
    s = C.profile_summary(df).first().asDict()
    assert s == {"patterns": 5, "patterns_freq1": 3, "predicates": 3, "single_pattern_predicates": 1,
                 "single_rare_predicates": 1, "unrepeated_pairs": 5}
    # p1 has one rare pattern but also a frequent one: still listed
    assert rows(C.single_rare_predicates(df), "predicate") == [("p1",)]


def test_removal_impact(spark):
    df = pat_df(spark, [("s", "p1", "o", 1), ("s", "p1", "o2", 9), ("t", "p2", "o", 1), ("u", "p3", "v", 7)])
    got = {r["predicate"]: r for r in C.removal_impact(df).collect()}
    assert set(got) == {"p1", "p2"}
    assert (got["p1"]["size_delta"], got["p1"]["sum_delta"], got["p1"]["sum_delta_pct"]) == (1, 1, 10.0)
    assert (got["p2"]["size_after"], got["p2"]["sum_after"], got["p2"]["size_delta_pct"]) == (0, 0, 100.0)


def test_histogram_includes_empty_bins_and_closed_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.0,), (2.4,)], "x double")
    h = {r["bin"]: r["n"] for r in C.impact_histogram(df, "x", 4).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 2}
    same = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert sum(r["n"] for r in C.impact_histogram(same, "x", 10).collect()) == 2


def test_equal_pair_sets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("c", "z"),
                                ("d", "x")], "predicate string, pair string")
    got = rows(C.equal_pair_sets(df, 2))
    assert got == [("a", "a", 1), ("b", "a", 1), ("c", "c", 0)]


def test_namespace_share_distinct_input(spark):
    df = spark.createDataFrame([("dbpedia.org/property/x",), ("dbpedia.org/property/x",), ("y",)], "predicate string")
    r = C.namespace_share(df, "dbpedia.org/property").first()
    assert (r["touched"], r["with_needle"], r["pct"]) == (2, 1, 50.0)


def test_equal_pair_sets_of_any_size(spark):
    data = [("s", p, f"o{k}", 1) for p in ("x", "y", "z") for k in range(3000 if p != "z" else 2999)] + [("s", "w", "o1", 1)]
    got = rows(C.equal_pair_sets(pat_df(spark, data), None))
    assert got == [("w", "w", 0), ("x", "x", 1), ("y", "x", 1), ("z", "z", 0)]


def test_sets_with_one_fingerprint_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(C.F, "xxhash64", lambda *a: F.lit(1).cast("bigint"))  # all pairs look alike
    data = [("s", p, o, 1) for p, os in (("a", "xy"), ("b", "xy"), ("c", "yz"), ("d", "yz"), ("e", "zz")) for o in os]
    got = rows(C.equal_pair_sets(pat_df(spark, data), None))
    assert got == [("a", "a", 1), ("b", "a", 1), ("c", "c", 1), ("d", "c", 1), ("e", "e", 0)]
