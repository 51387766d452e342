"""Evaluation (H9-H11): classification report, confusion matrix and the
test pass.  Everything is computed from one grouped count of
(y_true, y_pred); the label list is a bounded parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

from tessera.operators.scoring import gated_predict


def _labels_frame(spark: SparkSession, labels: list[str]) -> DataFrame:
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], "label string, label_order int")


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p, r):
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def classification_report(pred: DataFrame, labels: list[str], y_true: str = "y_true",
                          y_pred: str = "y_pred", ndigits: int = 6) -> DataFrame:
    """H9: (label, precision, recall, f1_score, support) for every label of
    the list (unseen labels included with zeros; zero division gives 0),
    then ``accuracy`` (when every observed label is in the list, otherwise
    ``micro avg``), ``macro avg`` and ``weighted avg``.

    One pass over the predictions: each row emits its true label (support),
    its predicted label (predicted count) and, when they agree, a hit; one
    grouped count (combined map-side) gives every per-label figure and the
    number of labels outside the list.  The rest works on label-sized rows."""
    spark = pred.sparkSession
    t, p = F.col(y_true), F.col(y_pred)
    tags = F.array(F.struct(t.alias("label"), F.lit(1).alias("sup"), F.lit(0).alias("pn"), F.lit(0).alias("tp")),
                   F.struct(p.alias("label"), F.lit(0).alias("sup"), F.lit(1).alias("pn"), F.lit(0).alias("tp")),
                   F.struct(t.alias("label"), F.lit(0).alias("sup"), F.lit(0).alias("pn"),
                            F.when(t == p, F.lit(1)).otherwise(F.lit(0)).alias("tp")))
    per_label = (pred.select(F.explode(tags).alias("x"))
                 .groupBy(F.col("x.label").alias("label"))
                 .agg(F.sum("x.sup").cast("bigint").alias("support"), F.sum("x.pn").cast("bigint").alias("pn"),
                      F.sum("x.tp").cast("bigint").alias("tp")))
    lab = F.broadcast(_labels_frame(spark, labels))
    per = (lab.join(per_label, "label", "left").fillna(0, ["tp", "pn", "support"]))
    per = (per.withColumn("precision", _safe_div(F.col("tp"), F.col("pn")))
           .withColumn("recall", _safe_div(F.col("tp"), F.col("support")))
           .withColumn("f1_score", _f1(F.col("precision"), F.col("recall"))))
    outside = per_label.join(lab, "label", "left_anti").select(F.lit(1).alias("o"))
    # per-label rows and the outside marker folded by one aggregate (label-sized input)
    folded = (per.select("tp", "pn", "support", "precision", "recall", "f1_score", F.lit(0).alias("o"),
                         F.lit(1).alias("listed"))
              .unionByName(outside.select(*[F.lit(None).cast(c).alias(n) for n, c in
                                            [("tp", "bigint"), ("pn", "bigint"), ("support", "bigint"),
                                             ("precision", "double"), ("recall", "double"),
                                             ("f1_score", "double")]], "o", F.lit(0).alias("listed"))))
    ls = F.col("listed") == 1
    summary = folded.agg(
        F.sum(F.when(ls, F.col("tp"))).alias("stp"), F.sum(F.when(ls, F.col("pn"))).alias("spn"),
        F.sum(F.when(ls, F.col("support"))).alias("ssup"),
        F.avg(F.when(ls, F.col("precision"))).alias("mp"), F.avg(F.when(ls, F.col("recall"))).alias("mr"),
        F.avg(F.when(ls, F.col("f1_score"))).alias("mf"),
        _safe_div(F.sum(F.when(ls, F.col("precision") * F.col("support"))), F.sum(F.when(ls, F.col("support")))).alias("wp"),
        _safe_div(F.sum(F.when(ls, F.col("recall") * F.col("support"))), F.sum(F.when(ls, F.col("support")))).alias("wr"),
        _safe_div(F.sum(F.when(ls, F.col("f1_score") * F.col("support"))), F.sum(F.when(ls, F.col("support")))).alias("wf"),
        F.sum("o").alias("n_out"))
    micro_p = _safe_div(F.col("stp"), F.col("spn"))
    micro_r = _safe_div(F.col("stp"), F.col("ssup"))
    micro = summary.select(
        F.when(F.col("n_out") == 0, F.lit("accuracy")).otherwise(F.lit("micro avg")).alias("label"),
        micro_p.alias("precision"), micro_r.alias("recall"), _f1(micro_p, micro_r).alias("f1_score"),
        F.col("ssup").alias("support"), F.lit(len(labels)).alias("label_order"))
    macro = summary.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                           F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                           F.col("ssup").alias("support"), F.lit(len(labels) + 1).alias("label_order"))
    weighted = summary.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                              F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                              F.col("ssup").alias("support"), F.lit(len(labels) + 2).alias("label_order"))
    rows = per.select("label", "precision", "recall", "f1_score", "support", "label_order")
    out = rows.unionByName(micro).unionByName(macro).unionByName(weighted)
    return out.select("label", "label_order",
                      *[F.round(c, ndigits).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("bigint").alias("support"))


def confusion_matrix(pred: DataFrame, labels: list[str], y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """(actual, predicted, n) for every pair of listed labels, zeros
    included; pairs outside the list are dropped."""
    spark = pred.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    counts = pred.groupBy(F.col(y_true).alias("actual"), F.col(y_pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_matrix_wide(cm: DataFrame, labels: list[str]) -> DataFrame:
    """The matrix with one column per predicted label, rows in list order."""
    return cm.groupBy("actual").pivot("predicted", labels).agg(F.first("n"))


def evaluate(projections: DataFrame, space, mapping: DataFrame, labels: list[str] | None = None,
             id_cols=("id",), vec: str = "vec", gate: str = "gate", y_true: str = "rel"):
    """H2 over every row, then the report (H9) and matrix.
    The default label list is the mapping's relations (dictionary-sized)."""
    if labels is None:
        labels = sorted(r[0] for r in mapping.select("rel").distinct().collect())  # dictionary-sized
    pred = gated_predict(projections, space, mapping, id_cols, vec, gate)
    checkpoint_dir(pred.sparkSession)
    # scored once: the report and the matrix read the written predictions
    pred = pred.select(*id_cols, F.col(y_true).alias("y_true"), "y_pred").checkpoint()
    return pred, classification_report(pred, labels), confusion_matrix(pred, labels)
