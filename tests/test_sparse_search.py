"""Inverted-index and pruned searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import nearest as N
from tessera.operators import labels as G
from tessera.operators import scoring as H
from tessera.operators import similarity as ES
from tessera.operators import space as SP


def sparse_space(spark, vectors):
    """Space of {component: value} vectors named as given."""
    rows = spark.createDataFrame([(p, k) for k, (p, _) in enumerate(vectors)], "predicate string, row_order bigint")
    entries = spark.createDataFrame([(p, c, float(v)) for p, m in vectors for c, v in m.items()],
                                    "predicate string, component bigint, value double")
    return SP.Space(rows, entries, entries.select("component").distinct().withColumn("label", F.col("component").cast("string")))


def brute_top(vectors, k):
    out = []
    for p, a in vectors:
        na = sum(v * v for v in a.values())
        by = {"euclidean": [], "cosine": []}
        for q, b in vectors:
            nb = sum(v * v for v in b.values())
            ab = sum(v * b.get(c, 0) for c, v in a.items())
            by["euclidean"].append((round(max(na + nb - 2 * ab, 0) ** 0.5, 6), q))
            by["cosine"].append((round(1 - ab / (na ** 0.5 * nb ** 0.5), 6) if na and nb else float("inf"), q))
        for m, ds in by.items():
            out += [(p, m, r + 1, q, None if d == float("inf") else d) for r, (d, q) in enumerate(sorted(ds)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.predicate, r.metric, r["rank"], r.neighbor, r.distance) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,hub,zeros,levels", [(0, False, 0, None), (1, True, 3, 1), (2, True, 40, 1), (3, False, 1, 2)])
def test_all_pairs_with_a_hub_zero_rows_and_tied_norms(spark, seed, hub, zeros, levels):
    rng = np.random.default_rng(seed)
    vectors = [(f"n{k:02}" if k % 2 else f"a{k:02}", {int(c): float(rng.choice([0.5, 1.0, 0.25])) for c in rng.choice(25, 3)}) for k in range(45)]
    vectors += [(f"z{k:02}", {}) for k in range(zeros)]
    vectors += [("hub", {c: -1.0 for c in range(25)})] if hub else []
    rng.shuffle(vectors)
    got = ES.all_pairs_similarity(sparse_space(spark, vectors), 5, hot_rows=4, levels=levels)
    assert found(got) == brute_top(vectors, 5)


def test_all_pairs_of_few_and_of_no_rows(spark):
    vectors = [("a", {0: 1.0}), ("b", {})]
    assert found(ES.all_pairs_similarity(sparse_space(spark, vectors), 5)) == brute_top(vectors, 5)
    one = sparse_space(spark, vectors)
    none = SP.Space(one.rows.limit(0), one.entries.limit(0), one.dims)
    assert ES.all_pairs_similarity(none, 5).count() == 0


def test_all_pairs_never_compare_rows_that_share_nothing(spark):
    vectors = [(f"p{k}", {k: 1.0}) for k in range(30)]
    space = sparse_space(spark, vectors)
    plan = ES.all_pairs_similarity(space, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


WIDE = 1_200_000


@pytest.mark.parametrize("max_entries", [0, None])
def test_a_space_of_1_200_000_dimensions_is_searched(spark, max_entries):
    rng = np.random.default_rng(5)
    vectors = [(f"p{k}", {int(c): float(rng.normal()) for c in rng.choice(WIDE, 6)}) for k in range(40)]
    vectors.append(("last", {WIDE - 1: 1.0}))
    space = sparse_space(spark, vectors)
    asked = [(k, {c: v + 0.01 for c, v in vectors[k][1].items()}) for k in range(0, 41, 3)] + [(99, {7: -1.0})]
    df = spark.createDataFrame(asked, "id bigint, vec map<bigint,double>")
    near = H.nearest_property(df, space, max_entries=max_entries).collect()
    assert {r.id: r.nearest for r in near} == {**{k: vectors[k][0] for k in range(0, 41, 3)}, 99: "p0"}
    scores = H.class_scores(df, space, max_entries=max_entries).collect()
    assert all(len(r.scores) == 41 and (r.id == 99 or int(np.argmax(r.scores)) == r.id) for r in scores)


@pytest.mark.parametrize("last", [False, True])
def test_pruned_search_equals_all_rows_and_skips_most(last):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 12))
    X = np.concatenate([c + 0.02 * rng.normal(size=(60, 12)) for c in centres] + [np.zeros((3, 12))])
    X = np.concatenate([X, X[:50]])  # tied rows
    r, c = np.nonzero(X)
    index = N.SpaceIndex([f"p{k}" for k in range(len(X))], np.arange(len(X)) * 3, r, c, X[r, c])
    Q = np.concatenate([centres + 0.02 * rng.normal(size=centres.shape), X[:20], -X[:5], np.zeros((2, 12)), 1e-9 * X[:3]])
    offsets, column = np.arange(len(Q) + 1) * 12, np.tile(np.arange(12), len(Q))
    index.looked_at = 0
    row, sim = index.best(offsets, column, Q.ravel(), last)
    norm = lambda A: np.maximum(np.linalg.norm(A, axis=1), 1e-8)
    all_sims = np.round(Q @ X.T / np.outer(norm(Q), norm(X)), 12)
    want = [np.flatnonzero(s == s.max())[-1 if last else 0] for s in all_sims]
    assert row.tolist() == [int(w) for w in want]
    assert np.allclose(sim, all_sims[np.arange(len(Q)), want], atol=1e-9)
    assert index.looked_at < 0.4 * len(Q) * len(X)


def test_the_query_vector_is_not_shuffled(spark):
    space = sparse_space(spark, [("a", {0: 1.0}), ("b", {1: 1.0})])
    df = spark.createDataFrame([(1, [0.1, 0.9]), (2, [0.3, 0.1]), (3, None)], "id bigint, vec array<double>")
    near = H.nearest_property(df, space)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r.id: r.nearest for r in near.collect()} == {1: "b", 2: "a", 3: "a"}  # no vector: as a zero one


def test_vector_owner_meets_on_a_hash_not_on_the_array(spark):
    space = sparse_space(spark, [("pa", {0: 1.0}), ("pb", {1: 1.0}), ("pc", {0: 1.0})])
    mapping = spark.createDataFrame([("ra", "pa"), ("rb", "pb"), ("rc", "pc")], "rel string, prop string")
    rows = [(1, "ra", [1.0, 0.0]), (2, "rb", [1.0, 0.0]), (3, "rc", [1.0, 0.0]), (4, "rb", [0.0, 1.0]), (5, "rb", None), (6, "none", [0.0, 1.0])]
    rows += [(k, "ra", [1.0, 0.0]) for k in range(10, 200)]  # a hot vector
    df = spark.createDataFrame(rows, "id bigint, rel string, target array<double>")
    out = G.check_vector_owner(df, space, mapping)
    assert tuple(out.first()) == (196, 193, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("_h1" in line for line in joins) and not any("target" in line or "vec" in line for line in joins)
