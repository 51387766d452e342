"""The classifier with ReLU units: gradients, early stopping, odd rows."""

import numpy as np
import pytest

from tessera.operators import network as NW


def rows(spark, X, y):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in x], k) for i, (x, k) in enumerate(zip(X, y))],
                                 "vec_id int, vec array<double>, int_label int").repartition(3)


def corners(n=240):
    rng = np.random.default_rng(4)
    X = rng.uniform(-1, 1, (n, 2))
    X += 0.2 * np.sign(X)
    return X, [int(a * b > 0) for a, b in X]


def test_gradients_are_those_of_the_summed_loss(spark):
    rng = np.random.default_rng(2)
    X, y = rng.normal(size=(40, 3)), rng.integers(0, 4, 40).tolist()
    df = rows(spark, X, y).selectExpr("vec as x", "cast(int_label as bigint) y")
    layers = [(w, rng.normal(size=b.shape)) for w, b in NW._start([3, 5, 4], 1)]

    def loss(values):
        return NW._sums(df, values, False)[1]

    s = NW._sums(df, layers, True)
    assert s[0] == 40 and np.isclose(s[1], loss(layers))
    at = 2
    for i, pair in enumerate(layers):
        for j, a in enumerate(pair):
            place = rng.integers(a.size)
            moved = [[x.copy() for x in p] for p in layers]
            moved[i][j].ravel()[place] += 1e-5
            up = loss(moved)
            moved[i][j].ravel()[place] -= 2e-5
            assert abs((up - loss(moved)) / 2e-5 - s[at + place]) < 1e-4
            at += a.size


def test_corners_need_hidden_units_and_training_stops_early(spark):
    X, y = corners()
    df = rows(spark, X, y)
    net, out = NW.fit_baseline(df, hidden=(16,), size=100, rate=0.05, max_epochs=25, patience=2, delta=1e-3)
    got = out.collect()
    assert np.mean([r.pred_label == r.int_label for r in got]) > 0.95
    ends = len(net.history) - 1
    assert ends == 24 or ends - net.best_epoch == 2
    assert net.history[net.best_epoch] + 1e-3 > max(net.history)
    assert {(r.error, r.label_error) for r in NW.forward_error(out, net).collect()} == {(0.0, 0)}
    again, _ = NW.fit_baseline(df.repartition(5), hidden=(16,), size=100, rate=0.05, max_epochs=2)
    assert np.allclose(again.history, net.history[:2])


def test_a_rate_of_zero_stops_after_the_patience(spark):
    X, y = corners(30)
    net, _ = NW.fit_baseline(rows(spark, X, y), hidden=(4,), rate=0.0, patience=2, delta=0.01, monitor="loss")
    assert len(net.history) == 3 and net.best_epoch == 0


def test_nulls_no_held_out_rows_and_no_rows(spark):
    X = [[0.0, 1.0], [1.0, 0.0], None, [1.0, 1.0]]
    df = rows(spark, X, [0, 1, 1, None])
    net, out = NW.fit_baseline(df, hidden=(4,), held_out=0.0, max_epochs=2)
    got = {r.vec_id: r for r in out.collect()}
    assert got[2].scores is None and got[2].pred_label is None and len(got[3].scores) == 2 and len(net.history) == 2
    with pytest.raises(ValueError, match="no training rows"):
        NW.fit_baseline(df.limit(0))


def test_macro_f1_leaves_out_classes_that_never_occur():
    assert NW.macro_f1(np.array([[2.0, 0, 0], [1, 1, 0], [0, 0, 0]])) == pytest.approx((4 / 5 + 2 / 3) / 2)
