"""Principal components and model fits against direct solutions."""

import numpy as np
import pytest

from tessera.operators import fits as FT
from tessera.operators import similarity as ES
from tessera.operators import space as SP


def matrix_space(spark, X):
    e = [(f"p{i}", j, float(v)) for (i, j), v in np.ndenumerate(X) if v]
    entries = spark.createDataFrame(e, "predicate string, component bigint, value double")
    rows = spark.createDataFrame([(f"p{i}", i) for i in range(len(X))], "predicate string, row_order bigint")
    return SP.Space(rows, entries, entries.select("component").distinct().withColumn("label", entries["component"].cast("string")))


def test_pca_of_twenty_close_eigenvalues(spark):
    rng = np.random.default_rng(0)
    n, d = 40, 30
    U = np.linalg.qr(rng.normal(size=(n, d)))[0]
    U = np.linalg.qr(U - U.mean(0))[0]
    values = np.array([1.0, 0.9, *np.linspace(0.895, 0.85, 20), *[0.1] * 8])
    X = U @ np.diag(values) @ np.linalg.qr(rng.normal(size=(d, d)))[0].T + 3
    space = matrix_space(spark, X)
    out = ES.pca(space, 2)
    got = out.orderBy("row_order").toPandas()
    for j in range(2):
        a, b = got[f"pc{j + 1}"].to_numpy(), U[:, j] * values[j]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert [tuple(r)[1:] for r in ES.pca_residual(space, out).collect()] == [(0.0, 0.0, 0.0)] * 2
    with pytest.raises(ValueError, match="not found"):
        ES.pca(space, 2, max_steps=1)


@pytest.mark.parametrize("X", [np.ones((5, 2)), np.array([[1.0, 2.0]]), np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])])
def test_pca_of_equal_rows_of_one_and_of_few(spark, X):
    got = ES.pca(matrix_space(spark, X), 2).orderBy("row_order").toPandas()[["pc1", "pc2"]].to_numpy()
    U, S, _ = np.linalg.svd(X - X.mean(0), full_matrices=False)
    want = np.zeros((len(X), 2))
    want[:, :len(S)] = (U * S)[:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)


def test_gate_is_the_minimum(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 4))
    y = (rng.random(300) < 1 / (1 + np.exp(-(X @ [1, -2, 0.5, 0] + 0.3)))).astype(float)
    df = spark.createDataFrame([(i, x.tolist(), float(v)) for i, (x, v) in enumerate(zip(X, y))], "id int, vec array<double>, attribute double")
    w, out = FT.fit_gate(df)
    A = np.c_[X, np.ones(300)]
    p = 1 / (1 + np.exp(-A @ w))
    assert np.abs(A.T @ (p - y) / 300 + 1e-6 * w).max() < 1e-8
    assert np.allclose([r.gate for r in out.orderBy("id").collect()], p)
    assert {r.gradient for r in FT.gate_gradient(out, w).collect()} == {0.0}


def test_gate_of_separable_flags_ends(spark):
    df = spark.createDataFrame([(i, [float(i)], float(i > 5)) for i in range(12)], "id int, vec array<double>, attribute double")
    _, out = FT.fit_gate(df)
    assert all((r.gate > 0.5) == (r.id > 5) for r in out.collect())


@pytest.mark.parametrize("kind", ["map", "array"])
def test_projector_of_200_000_components(spark, kind):
    rng = np.random.default_rng(2)
    width = 200_000 if kind == "map" else 7
    X = rng.normal(size=(60, 3))
    Y = [{int(c): float(rng.normal()) for c in rng.choice(width, 4)} for _ in X]
    Y[0] = {width - 1: 1.0}
    made = [(i, x.tolist(), y if kind == "map" else [y.get(c, 0.0) for c in range(width)], i % 10 == 9) for i, (x, y) in enumerate(zip(X, Y))]
    df = spark.createDataFrame(made, f"id int, vec array<double>, target {'map<bigint,double>' if kind == 'map' else 'array<double>'}, is_no_relation boolean")
    weights = FT.fit_projector(df.repartition(3))
    A = np.c_[X, np.ones(60)][[i % 10 != 9 for i in range(60)]]
    comps = sorted({c for i, y in enumerate(Y) for c in y if i % 10 != 9})
    B = np.array([[y.get(c, 0.0) for c in comps] for i, y in enumerate(Y) if i % 10 != 9])
    W = np.linalg.solve(A.T @ A + 1e-3 * np.eye(4), A.T @ B)
    got = {r.component: r.w for r in weights.collect()}
    assert sorted(got) == comps and all(np.allclose(got[c], W[:, k]) for k, c in enumerate(comps))
    assert {r.residual for r in FT.projector_residual(df, weights).collect()} == {0.0}
    out = {(r.id, r.component): r.value for r in FT.project(df, weights, ["id"], block=16).collect()}
    P = np.c_[X, np.ones(60)] @ W
    want = {(i, c): P[i, k] for i in range(60) for k, c in enumerate(comps) if P[i, k] > 0}
    assert out.keys() == want.keys() and all(abs(out[k] - v) < 1e-9 for k, v in want.items())
