"""Plan checks: the physical plans keep the shapes the design relies on."""

from conftest import pat_df
from tessera.operators import derive as D
from tessera.operators import explore as C
from tessera.operators import similarity as ES
from tessera.operators import space as SP


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_product_in_all_pairs(spark):
    data = [(f"s{i % 5}", f"p{i % 11}", f"o{(i * 3) % 7}", i % 5 + 1) for i in range(60)]
    space = SP.build_space(pat_df(spark, data), None, None, filler=None)
    p = plan(ES.all_pairs_similarity(space, 3))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_exact_filter_pushes_short_lists_and_broadcasts_long_ones(spark, tmp_dir):
    pat_df(spark, [("a", "p", "b", 1), ("a", "z", "b", 2)]).write.parquet(tmp_dir + "/pat")
    df = spark.read.parquet(tmp_dir + "/pat")
    p = plan(D.filter_exact(df, "predicate", ["p", "q"]))
    assert "PushedFilters: [In(predicate, [p,q])]" in p or "In(predicate, [p,q])" in p
    long_list = [f"v{i}" for i in range(D.MAX_IN_LIST + 1)] + ["p"]
    p2 = plan(D.filter_exact(df, "predicate", long_list))
    assert "BroadcastHashJoin" in p2 and "LeftSemi" in p2
    assert [r["predicate"] for r in D.filter_exact(df, "predicate", long_list).collect()] == ["p"]


def test_lookup_is_pushed_to_the_scan(spark, tmp_dir):
    pat_df(spark, [("a", "p", "b", 1), ("a", "q", "b", 2)]).write.parquet(tmp_dir + "/pat")
    df = spark.read.parquet(tmp_dir + "/pat")
    p = plan(C.lookup_predicate(df, "p"))
    assert "PushedFilters: [IsNotNull(predicate), EqualTo(predicate,p)]" in p


def test_counts_and_totals_use_aggregates_not_windows(spark):
    from tessera.operators import cleaning as B
    data = [(f"s{i % 3}", f"p{i % 4}", f"o{i % 5}", i + 1) for i in range(40)]
    df = pat_df(spark, data)
    for out in (B.drop_rare_pairs(df), B.drop_small_predicates(df), SP.probabilities(df)):
        p = plan(out)
        assert "Window" not in p and "HashAggregate" in p


def test_nearest_row_search_has_no_pair_product(spark):
    from tessera.operators import scoring as H
    long = spark.createDataFrame([("A", 0, 0, 1.0), ("B", 1, 1, 1.0)],
                                 "predicate string, row_order bigint, component bigint, value double")
    sp = H.space_from_long(long)
    q = spark.createDataFrame([(1, [0.2, 0.9]), (2, [0.7, 0.1])], "id int, vec array<double>")
    near = H.nearest_property(q, sp, ["id"])
    p = plan(near)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert {r["id"]: r["nearest"] for r in near.collect()} == {1: "B", 2: "A"}
