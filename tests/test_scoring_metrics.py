import math

import numpy as np

from conftest import rows
from tessera.operators import metrics as M
from tessera.operators import scoring as H


def space(spark, vecs):
    data = [(name, i, c, float(v)) for i, (name, vec) in enumerate(vecs) for c, v in enumerate(vec) if v != 0]
    long = spark.createDataFrame(data, "predicate string, row_order bigint, component bigint, value double")
    sp = H.space_from_long(long)
    rows_df = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(vecs)], "predicate string, row_order bigint")
    return sp.__class__(rows_df, sp.entries, spark.range(len(vecs[0][1])).selectExpr(
        "id AS component", "concat('c', id) AS label"))


def proj(spark, data):
    return spark.createDataFrame(data, "id int, vec array<double>, gate double")


def test_nearest_first_row_wins_ties_and_zero_vector(spark):
    sp = space(spark, [("A", [1, 0]), ("B", [1, 0]), ("C", [0, 1])])
    p = proj(spark, [(1, [2.0, 0.0], 0.1), (2, [0.0, 0.0], 0.1), (3, [0.1, 5.0], 0.1)])
    got = {r["id"]: r["nearest"] for r in H.nearest_property(p, sp, ["id"]).collect()}
    assert got == {1: "A", 2: "A", 3: "C"}


def test_nearest_blocks_agree_with_single_block(spark):
    rng = np.random.default_rng(1)
    vecs = [(f"P{i}", list(rng.normal(size=5))) for i in range(23)]
    sp = space(spark, vecs)
    q = [(i, [float(x) for x in rng.normal(size=5)], 0.1) for i in range(40)]
    a = rows(H.nearest_property(proj(spark, q), sp, ["id"]), "id", "nearest")
    b = rows(H.nearest_property(proj(spark, q), sp, ["id"], max_entries=10**6), "id", "nearest")
    # the same answer when the space is too big for an index in every task (inverted index)
    c = rows(H.nearest_property(proj(spark, q), sp, ["id"], max_entries=0), "id", "nearest")
    assert a == c
    X = np.array([v for _, v in vecs])
    expect = []
    for i, v, _ in q:
        sims = X @ np.array(v) / np.linalg.norm(X, axis=1) / np.linalg.norm(v)
        expect.append((i, vecs[int(np.argmax(sims))][0]))
    assert a == b == sorted(expect)


def test_gated_predict(spark):
    sp = space(spark, [("pa", [1, 0]), ("pb", [0, 1]), ("clone", [1, 0.1])])
    m = spark.createDataFrame([("ra", "pa"), ("rb", "pb"), ("no_relation", "no_relation")], "rel string, prop string")
    p = proj(spark, [(1, [1.0, 0.1], 0.2), (2, [0.0, 1.0], 0.7), (3, [0.0, 1.0], 0.49)])
    got = {r["id"]: r["y_pred"] for r in H.gated_predict(p, sp, m, ["id"]).collect()}
    assert got == {1: "ra", 2: "no_relation", 3: "rb"}  # the clone is not a candidate
    got_all = {r["id"]: r["y_pred"] for r in H.gated_predict(p, sp, m, ["id"], candidates="all").collect()}
    assert got_all[1] is None


def test_losses_match_numpy(spark):
    data = [(1, [1.0, 2.0], [2.0, 1.0], False, 0.3, 0.0, 0), (2, [0.5, 0.0], [1.0, 1.0], True, 0.9, 1.0, 0),
            (3, [0.0, 1.0], [0.0, 2.0], False, 1.0, 0.0, 1)]
    df = spark.createDataFrame(data, "id int, vec array<double>, target array<double>, is_no_relation boolean, "
                                     "gate double, attribute double, batch_id int")
    r = H.composed_loss(df).first()

    def cos(a, b):
        a, b = np.array(a), np.array(b)
        return a @ b / math.sqrt((a @ a + 1e-12) * (b @ b + 1e-12))
    pl = np.mean([0 if nr else 1 - cos(v, t) for _, v, t, nr, *_ in data])

    def bce(p, y):
        lp = max(math.log(p), -100) if p > 0 else -100
        l1 = max(math.log(1 - p), -100) if p < 1 else -100
        return -(y * lp + (1 - y) * l1)
    gl = np.mean([bce(g, y) for *_, g, y, _ in data])
    assert abs(r["projection_loss"] - pl) < 1e-12 and abs(r["gate_loss"] - gl) < 1e-12
    e = H.epoch_loss(df).first()
    b0 = np.mean([0 if d[3] else 1 - cos(d[1], d[2]) for d in data[:2]]) + np.mean([bce(d[4], d[5]) for d in data[:2]])
    b1 = (1 - cos(data[2][1], data[2][2])) + bce(1.0, 0.0)
    assert abs(e["epoch_loss"] - (b0 + b1) / 2) < 1e-12 and e["n_batches"] == 2


def test_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], 1), ([3.0, -1.0, 0.0], 2)], "scores array<double>, int_label int")
    got = H.cross_entropy(df).first()["cross_entropy"]
    expect = np.mean([np.log(np.exp([1, 2, .5]).sum()) - 2, np.log(np.exp([3, -1, 0]).sum()) - 0])
    assert abs(got - expect) < 1e-12


def report_np(y_true, y_pred, labels):
    out = {}
    for lab in labels:
        tp = sum(t == p == lab for t, p in zip(y_true, y_pred))
        pn = sum(p == lab for p in y_pred)
        sup = sum(t == lab for t in y_true)
        p = tp / pn if pn else 0.0
        r = tp / sup if sup else 0.0
        out[lab] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, sup)
    return out


def test_classification_report_against_numpy_with_unseen_and_outside_labels(spark):
    yt = ["a", "a", "b", "c", "b", "z"]
    yp = ["a", "b", "b", "a", "b", "a"]
    labels = ["a", "b", "c", "d"]
    df = spark.createDataFrame(list(zip(yt, yp)), "y_true string, y_pred string")
    rep = {r["label"]: r for r in M.classification_report(df, labels).collect()}
    exp = report_np(yt, yp, labels)
    for lab in labels:
        assert (rep[lab]["precision"], rep[lab]["recall"], rep[lab]["f1_score"], rep[lab]["support"]) == tuple(
            round(x, 6) if isinstance(x, float) else x for x in exp[lab])
    assert "micro avg" in rep and "accuracy" not in rep  # 'z' is outside the list
    macro_f1 = np.mean([exp[lab][2] for lab in labels])
    assert rep["macro avg"]["f1_score"] == round(macro_f1, 6)
    sup = sum(exp[lab][3] for lab in labels)
    w = sum(exp[lab][2] * exp[lab][3] for lab in labels) / sup
    assert rep["weighted avg"]["f1_score"] == round(w, 6)
    df2 = spark.createDataFrame([("a", "a"), ("b", "a")], "y_true string, y_pred string")
    rep2 = {r["label"]: r for r in M.classification_report(df2, ["a", "b"]).collect()}
    assert rep2["accuracy"]["f1_score"] == 0.5


def test_confusion_matrix_zeros_and_total(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("x", "a")], "y_true string, y_pred string")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(df, ["a", "b"]).collect()}
    assert cm == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}


def test_top_class_positions_follow_sorted_values_with_duplicates(spark):
    m = spark.createDataFrame([("r1", "b"), ("r2", "a"), ("r3", "b"), ("r4", "c")], "rel string, prop string")
    df = spark.createDataFrame([(1, [0.0, 0.0, 5.0, 1.0]), (2, [9.0, 0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0, 2.0]),
                                (4, [1.0, 1.0, 0.0, 0.0])], "id int, scores array<double>")
    got = {r["id"]: r["y_pred"] for r in H.top_class(df, m).collect()}
    # sorted values a, b, b, c; b maps back to its last relation r3
    assert got == {1: "r3", 2: "r2", 3: "r4", 4: "r2"}


def test_projector_matches_numpy_ridge(spark):
    from tessera.operators import fits as FT
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 4))
    W = rng.normal(size=(5, 3))
    Y = np.c_[X, np.ones(60)] @ W
    data = [(i, [float(v) for v in X[i]], [float(v) for v in Y[i]], bool(i % 7 == 0)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, vec array<double>, target array<double>, is_no_relation boolean")
    got = FT.fit_projector(df.repartition(3), ridge=1e-9)
    keep = [i for i in range(60) if i % 7 != 0]
    Xb = np.c_[X[keep], np.ones(len(keep))]
    expect = np.linalg.solve(Xb.T @ Xb + 1e-9 * np.eye(5), Xb.T @ Y[keep])
    assert np.abs(np.array([r.w for r in got.orderBy("component").collect()]).T - expect).max() < 1e-8
    out = FT.with_projection(df, FT.project(df, got, ["id"]), ["id"]).orderBy("id").collect()
    assert len(out) == 60
    assert np.allclose([out[1]["projection"].get(c, 0.0) for c in range(3)], np.maximum(Y[1], 0), atol=1e-6)
