import numpy as np
from pyspark.sql import functions as F

from conftest import pat_df, rows
from tessera.functions.index import dense_index
from tessera.operators import similarity as ES
from tessera.operators import space as SP


def sample(spark):
    return pat_df(spark, [("a", "p", "x", 3), ("a", "p", "y", 1), ("b", "q", "x", 2), ("b", "q", "y", 2),
                          ("c", "r", "z", 7), ("a", "s", "x", 1), ("b", "s", "z", 3)])


def test_probability_arithmetic_kept(spark):
    p = {(r["predicate"], r["pair"]): r["prob"] for r in SP.probabilities(sample(spark)).collect()}
    assert p[("p", "a#-#x")] == ((3 * 100) / 4) * 0.01
    assert p[("s", "b#-#z")] == ((3 * 100) / 4) * 0.01


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select(F.format_string("k%05d", (F.col("id") * 7919) % 5000).alias("k"))
    got = dense_index(df.repartition(7), ["k"], "i").collect()
    assert sorted(r["i"] for r in got) == list(range(5000))
    assert all(r["k"] == f"k{r['i']:05d}" for r in got)


def test_first_row_wins_on_duplicate_pattern(spark):
    obj = pat_df(spark, [("a", "p", "x", 1), ("a", "p", "y", 3)], src=0)
    dt = pat_df(spark, [("a", "p", "x", 4)], src=1)
    probs = SP.probabilities(obj.unionByName(dt))  # tot = 8 for p
    fp = {r["pair"]: r["value"] for r in SP.first_prob(probs).collect()}
    assert fp["a#-#x"] == ((1 * 100) / 8) * 0.01  # the object pattern, not the datatype one


def test_build_space_rows_zero_row_clones_filler(spark):
    space = SP.build_space(sample(spark), ["p", "missing", "s"], ["p_@1", "p_@2"])
    sums = {r["predicate"]: (r["row_order"], round(r["row_sum"], 9)) for r in SP.row_sums(space).collect()}
    d = SP.n_dims(space)
    assert sums == {"missing": (0, 0.0), "s": (1, 1.0), "p_@1": (2, 2.0), "p_@2": (3, 2.0),
                    "no_relation": (4, -float(d))}
    labels = rows(space.dims, "component", "label")
    assert [lab for _, lab in labels] == ["a#-#x", "a#-#y", "b#-#z", "add1", "add2"]


def test_build_space_equals_stepwise(spark):
    df = sample(spark)
    step = SP.restrict_to(SP.full_space(SP.probabilities(df)), ["p", "missing", "s"])
    step = SP.add_constant_row(SP.disambiguate(SP.drop_zero_dims(step), ["p_@1"]))
    one = SP.build_space(df, ["p", "missing", "s"], ["p_@1"])
    assert rows(step.long()) == rows(one.long())


def test_missing_clone_base_fails(spark):
    import pytest
    space = SP.build_space(sample(spark), ["p"], None, filler=None)
    with pytest.raises(Exception):
        SP.disambiguate(space, ["nothere_@1"]).long().collect()


def test_wide_long_round_trip(spark):
    space = SP.build_space(sample(spark), None, None, filler=None)
    wide = SP.to_wide(space)
    back = SP.to_long(wide)
    assert rows(back, "predicate", "component", "value") == rows(space.entries, "predicate", "component", "value")


def dense_np(space):
    d = SP.to_dense(space).orderBy("row_order").collect()
    return [r["predicate"] for r in d], np.array([r["vec"] for r in d])


def test_similarities_match_numpy(spark):
    space = SP.build_space(sample(spark), None, None, filler=None)
    names, X = dense_np(space)
    a, b = names.index("p"), names.index("s")
    r = ES.pair_similarity(space, "p", "s", ndigits=None).first()
    assert abs(r["euclidean"] - np.linalg.norm(X[a] - X[b])) < 1e-12
    cos = X[a] @ X[b] / np.linalg.norm(X[a]) / np.linalg.norm(X[b])
    assert abs(r["cosine"] - (1 - cos)) < 1e-12
    sims = {x["predicate"]: x for x in ES.similarities(space, "p", 1, ndigits=None).collect()}
    assert set(sims) == {names[0], names[1]}


def test_zero_row_has_null_cosine(spark):
    space = SP.build_space(sample(spark), ["p", "missing"], None, filler=None)
    r = ES.pair_similarity(space, "p", "missing").first()
    assert r["cosine"] is None and r["euclidean"] > 0


def test_all_pairs_topk_matches_brute_force_and_is_symmetric(spark):
    data = [(f"s{i % 5}", f"p{i % 11}", f"o{(i * 3) % 7}", (i * 13) % 17 + 1) for i in range(120)]
    space = SP.build_space(pat_df(spark, data), None, None, filler=None)
    names, X = dense_np(space)
    k = 4
    got = ES.all_pairs_similarity(space, k)
    eu = {}
    for r in got.filter(F.col("metric") == "euclidean").collect():
        eu.setdefault(r["predicate"], []).append((r["rank"], r["neighbor"], r["distance"]))
    for i, n in enumerate(names):
        d = np.linalg.norm(X - X[i], axis=1)
        expect = sorted((round(d[j], 6), names[j]) for j in range(len(names)))[:k]
        assert [(x[2], x[1]) for x in sorted(eu[n])] == expect
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the shuffle joins
    try:
        shuffled = ES.all_pairs_similarity(space, k, hot_rows=2, levels=1)
        assert rows(shuffled) == rows(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    dist = {(r["predicate"], r["neighbor"]): r["distance"] for r in got.collect()}
    for (a, b), v in dist.items():
        if (b, a) in dist:
            assert abs(dist[(b, a)] - v) < 1e-9


def test_pca_matches_svd_up_to_sign(spark):
    data = [(f"s{i % 4}", f"p{i % 9}", f"o{(i * 5) % 6}", (i * 7) % 11 + 1) for i in range(90)]
    space = SP.build_space(pat_df(spark, data), None, None, filler=None)
    names, X = dense_np(space)
    got = ES.pca(space, 2).orderBy("row_order").collect()
    Xc = X - X.mean(0)
    U, S, _ = np.linalg.svd(Xc, full_matrices=False)
    for j in range(2):
        a = np.array([r[f"pc{j + 1}"] for r in got])
        b = U[:, j] * S[j]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
