"""A feed-forward classifier with ReLU units, trained on mini-batches
with early stopping.

A step needs the weights of the step before, so steps follow one another.  A
Spark job takes some of them: its task reads the rows of at most
``JOB_ROWS`` rows' mini-batches and passes on the weights, so that jobs and
what comes to the driver are few.  What is measured is added up over all tasks
as a tree.  The driver holds the weights, whose size follows from the layers
and not from the rows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.labels import mini_batches
from tessera.session import checkpoint_dir, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows whose mini-batches one job learns from.
JOB_ROWS = 1 << 16


@dataclass
class Network:
    """``layers``: (weights in x out, bias) of each layer, ReLU between
    them.  ``history``: the monitored value after each epoch."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    history: list[float] = field(default_factory=list)
    best_epoch: int = 0


def _start(widths: list[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(widths, widths[1:])]


def _forward(layers, x: np.ndarray) -> list[np.ndarray]:
    """The input, the units of each layer and the scores."""
    states = [x]
    for i, (w, b) in enumerate(layers):
        z = states[-1] @ w + b
        states.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
    return states


def _log_p(z: np.ndarray) -> np.ndarray:
    log_p = z - z.max(1, keepdims=True)
    return log_p - np.log(np.exp(log_p).sum(1, keepdims=True))


def _gradient(layers, states: list[np.ndarray], log_p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed loss's gradient of every weight, layer by layer."""
    g, parts = np.exp(log_p), []
    g[np.arange(len(y)), y] -= 1
    for i in range(len(layers) - 1, -1, -1):
        parts += [g.sum(0), (states[i].T @ g).ravel()]
        if i:
            g = (g @ layers[i][0].T) * (states[i] > 0)
    return np.concatenate(parts[::-1])


def _shaped(flat: np.ndarray, widths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(widths, widths[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _learn(train: DataFrame, order: list[int], widths: list[int], state: list[np.ndarray], step: int, rate: float) -> list[np.ndarray]:
    """``state`` (weights, first and second moments) after an Adam step on
    each mini-batch of ``order``, in that order."""
    def work(batches):
        import numpy as np
        import pyarrow as pa
        rows = [(b.column(0).flatten().to_numpy().reshape(-1, widths[0]), b.column(1).to_numpy(), b.column(2).to_numpy())
                for b in batches if b.num_rows]
        x, y, of = (np.concatenate(c) for c in zip(*rows))
        (flat, first, second), t = state, step
        for batch in order:
            mine = np.flatnonzero(of == batch)
            layers = _shaped(flat, widths)
            states = _forward(layers, x[mine])
            g, t = _gradient(layers, states, _log_p(states[-1]), y[mine]) / len(mine), t + 1
            first = first + 0.1 * (g - first)
            second = second + 0.001 * (g * g - second)
            flat = flat - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]) for a in (flat, first, second)], ["w", "m", "v"])

    rows = train.filter(F.col("batch_id").isin(order)).select("x", "y", "batch_id")
    made = rows.coalesce(1).mapInArrow(work, "w binary, m binary, v binary").collect()[0]
    return [np.frombuffer(b) for b in made]


def _sums(rows: DataFrame, layers, learn: bool) -> np.ndarray:
    """Added over ``rows`` (x, y): number of rows, loss, then the gradient of
    every weight (``learn``) or the counts of (label, prediction)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    d, k = layers[0][0].shape[0], layers[-1][0].shape[1]
    size = 2 + (sum(w.size + b.size for w, b in layers) if learn else k * k)

    def work(batches):  # shipped to the Python workers by value
        import numpy as np
        import pyarrow as pa
        total = np.zeros(size)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y = batch.column(1).to_numpy()
            states = _forward(layers, batch.column(0).flatten().to_numpy().reshape(n, d))
            log_p = _log_p(states[-1])
            total[0] += n
            total[1] -= log_p[np.arange(n), y].sum()
            if learn:
                total[2:] += _gradient(layers, states, log_p, y)
            else:
                np.add.at(total, 2 + y * k + states[-1].argmax(1), 1)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

    parts = rows.select("x", "y").mapInArrow(work, "s array<double>")
    return parts.select(Summarizer.sum(array_to_vector("s")).alias("s")).first()["s"].toArray()


def macro_f1(counts: np.ndarray) -> float:
    """Mean F1 of the classes that occur as label or prediction."""
    both = counts.sum(0) + counts.sum(1)
    return float((2 * np.diag(counts)[both > 0] / both[both > 0]).mean())


def fit_baseline(df: DataFrame, vec: str = "vec", label: str = "int_label", id_col: str = "vec_id",
                 n_classes: int | None = None, hidden=(256, 64), size: int = 1024, max_epochs: int = 40,
                 patience: int = 7, delta: float = 0.0, held_out: float = 0.2, monitor: str = "macro_f1",
                 rate: float = 1e-3, seed: int = 0):
    """Classifier ``[d, *hidden, classes]`` by Adam on the cross-entropy
    of mini-batches of ``size`` rows (``mini_batches``, by id).

    A share ``held_out`` of the rows, by the md5 of the id, is not learned
    from.  After each epoch ``monitor`` is measured on it (``macro_f1`` or
    ``loss``; on the training rows if none is held out).  An epoch whose
    value is worse than the best one plus ``delta`` counts, others become the
    best one and reset the count; after ``patience`` counted epochs, or
    ``max_epochs``, the weights of the best epoch are returned.  Rows with a
    null vector or label are not learned from; an error says that there is
    no other.  Returns (Network, df with ``scores`` and ``pred_label``, null
    for null vectors; ties go to the first class)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"held out {seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") / 2 ** 32
    data = df.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("bigint").alias("y"),
        F.coalesce(share < held_out, F.lit(False)).alias("held"))
    path = scratch_path(spark, "mini-batches")
    mini_batches(data.filter("not held"), size, seed).select("x", "y", "batch_id").write.partitionBy("batch_id").parquet(path)
    train = spark.read.schema("x array<double>, y bigint, batch_id bigint").parquet(path)
    held = data.filter("held").checkpoint()
    of = train.agg(F.max("batch_id"), F.max("y"), F.max(F.size("x"))).first()
    if of[0] is None:
        raise ValueError("no training rows")
    top = held.agg(F.max("y")).first()[0]
    k = n_classes or max(of[1], -1 if top is None else top) + 1
    measured = train if top is None else held

    widths = [of[2], *hidden, k]
    net = Network(_start(widths, seed))
    layers, best, waited = net.layers, None, 0
    flat = np.concatenate([a.ravel() for pair in layers for a in pair])
    state, step = [flat, np.zeros_like(flat), np.zeros_like(flat)], 0
    order, per_job = np.random.default_rng(seed), max(JOB_ROWS // size, 1)

    for epoch in range(max_epochs):
        batches = order.permutation(of[0] + 1).tolist()
        for at in range(0, len(batches), per_job):
            state = _learn(train, batches[at:at + per_job], widths, state, step, rate)
            step += len(batches[at:at + per_job])
        layers = _shaped(state[0], widths)
        s = _sums(measured, layers, False)
        value = macro_f1(s[2:].reshape(k, k)) if monitor == "macro_f1" else -s[1] / s[0]
        net.history.append(value if monitor == "macro_f1" else -value)
        if best is not None and value < best + delta:
            waited += 1
            if waited >= patience:
                break
        else:
            best, waited, kept, net.best_epoch = value, 0, layers, epoch
    net.layers = kept
    return net, apply(df, net, vec)


def apply(df: DataFrame, net: Network, vec: str = "vec") -> DataFrame:
    """``df`` with ``scores`` (one for each class) and ``pred_label``."""
    layers, at = net.layers, df.columns.index(vec)
    d, k = layers[0][0].shape[0], layers[-1][0].shape[1]

    def work(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            z = batch.column(at).drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            for i, (w, b) in enumerate(layers):
                z = z @ w + b
                if i + 1 < len(layers):
                    z = np.maximum(z, 0)
            cuts = np.concatenate([[0], np.cumsum(~null) * k]).astype(np.int32)
            label = np.zeros(len(null), np.int64)
            label[~null] = z.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.ascontiguousarray(z).ravel()), mask=pa.array(null)),
                 pa.array(label, mask=null)], [*batch.schema.names, "scores", "pred_label"])

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType
    schema = StructType([*df.schema.fields]).add("scores", ArrayType(DoubleType())).add("pred_label", LongType())
    return df.mapInArrow(work, schema)


def forward_error(scored: DataFrame, net: Network, vec: str = "vec", id_col: str = "vec_id", ndigits: int = 6) -> DataFrame:
    """(id, error, label_error) for distinct ids: the largest difference between ``scores``
    and a forward pass by SQL functions over the weights as a table, rounded,
    and 1 if the first largest score is not ``pred_label``, else 0."""
    spark = scored.sparkSession
    now = scored.filter(F.col(vec).isNotNull()).select(id_col, F.col(vec).cast("array<double>").alias("z"))
    for i, (w, b) in enumerate(net.layers):
        units = spark.createDataFrame([(0, [(j, [float(v) for v in w[:, j]], float(b[j])) for j in range(len(b))])],
                                      "one int, units array<struct<j:int,w:array<double>,b:double>>")
        each = now.withColumn("one", F.lit(0)).join(F.broadcast(units), "one").select(id_col, "z", F.explode("units").alias("u"))
        value = F.col("u.b") + F.aggregate(F.zip_with("z", "u.w", lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)
        out = each.select(id_col, F.struct(F.col("u.j").alias("j"), (value if i + 1 == len(net.layers) else F.greatest(value, F.lit(0.0))).alias("v")).alias("s"))
        now = out.groupBy(id_col).agg(F.array_sort(F.collect_list("s"))["v"].alias("z"))  # as many as the layer has units
    both = scored.join(now, id_col)
    error = F.array_max(F.zip_with("z", "scores", lambda a, b: F.abs(a - b)))
    label = F.array_position(F.col("scores"), F.array_max("scores")) - 1
    return both.select(id_col, F.abs(F.round(error, ndigits)).alias("error"),
                       (label != F.col("pred_label")).cast("bigint").alias("label_error"))
