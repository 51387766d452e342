"""Model fits on given sentence vectors (H12, H14; H13 is in ``network.py``).

These replace the reference's fine-tuned encoder heads with fits on a
vector column: the gate is logistic regression by reweighted least squares,
and the projector a ridge least squares fit with its weights as a table.  The driver
sees (d+1) x (d+1) sums at most.  Scores are not comparable with the
reference's published ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.nearest import sparse_columns
from tessera.session import checkpoint_dir


def _design(df: DataFrame, vec: str):
    """The vector with a constant 1 behind it."""
    return F.concat(F.transform(F.col(vec), lambda x: x.cast("double")), F.array(F.lit(1.0)))


def _summed(parts: DataFrame, cols: list[str]) -> list:
    """Element-wise sums of array columns, added up in the JVM."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    out = parts.select(*[Summarizer.sum(array_to_vector(c)).alias(c) for c in cols]).first()
    return [out[c].toArray() for c in cols]


def _weighed(x, weights):
    """w . x as an expression over literals: the weights are the model's."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


#: Largest element of the mean gradient at which the gate's fit ends.
GRADIENT_TOLERANCE = 1e-9


def fit_gate(df: DataFrame, vec: str = "vec", attr: str = "attribute", ridge: float = 1e-6, max_rounds: int = 100):
    """Logistic regression of the no-relation flag on the vector, by
    iteratively reweighted least squares: each round is one aggregate of
    (d+1) x (d+1) numbers, summed by Spark, and a Newton step that is halved
    while it does not lower the loss.  It ends when no element of the mean
    gradient is above ``GRADIENT_TOLERANCE``; an error says that it did not.
    ``ridge`` (of the mean loss) keeps the weights of separable flags finite.
    Returns (weights, bias last; df with ``gate`` = P(no_relation))."""
    import numpy as np

    checkpoint_dir(df.sparkSession)
    train = df.filter(F.col(vec).isNotNull() & F.col(attr).isNotNull()).select(
        _design(df, vec).alias("x"), F.col(attr).cast("double").alias("y")).checkpoint()
    first = train.first()
    if first is None:
        raise ValueError("no training rows")
    d = len(first["x"])

    def sums(weights):
        """Number of rows, loss, gradient and curvature, added over batches."""
        def work(batches):
            import numpy as np
            import pyarrow as pa
            total = np.zeros(2 + d + d * d)
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, d)
                y = b.column(1).to_numpy()
                z = x @ weights
                p = 1 / (1 + np.exp(-z))
                total[0] += len(y)
                total[1] += (np.logaddexp(0, z) - y * z).sum()
                total[2:2 + d] += x.T @ (p - y)
                total[2 + d:] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])
        s = _summed(train.mapInArrow(work, "s array<double>"), ["s"])[0]
        n = s[0]
        loss = s[1] / n + ridge / 2 * weights @ weights
        return loss, s[2:2 + d] / n + ridge * weights, s[2 + d:].reshape(d, d) / n + ridge * np.eye(d)

    w = np.zeros(d)
    loss, gradient, curvature = sums(w)
    for _ in range(max_rounds):
        if np.abs(gradient).max() <= GRADIENT_TOLERANCE:
            break
        step, size = np.linalg.solve(curvature, gradient), 1.0
        while True:
            tried = sums(w - size * step)
            if tried[0] <= loss + 1e-15 or size < 1e-6:
                break
            size /= 2
        w, (loss, gradient, curvature) = w - size * step, tried
    else:
        raise ValueError(f"the gradient is {np.abs(gradient).max():.1e} after {max_rounds} rounds")
    return w, df.withColumn("gate", 1 / (1 + F.exp(-_weighed(_design(df, vec), w))))


def gate_gradient(df: DataFrame, weights, vec: str = "vec", attr: str = "attribute", ridge: float = 1e-6,
                  ndigits: int = 6) -> DataFrame:
    """(component, gradient) of the mean loss at ``weights``, rounded: 0
    everywhere at the minimum, of which there is one."""
    each = df.select(F.posexplode(_design(df, vec)).alias("component", "x"), (F.col("gate") - F.col(attr)).alias("e"))
    w = F.element_at(F.array(*[F.lit(float(v)) for v in weights]), F.col("component") + 1)
    g = each.groupBy("component").agg(F.avg(F.col("x") * F.col("e")).alias("g"))
    return g.select(F.col("component").cast("bigint").alias("component"), (F.abs(F.round(F.col("g") + ridge * w, ndigits))).alias("gradient"))


#: Numbers that a task holds while it multiplies a batch.
CELLS = 1 << 22


def fit_projector(df: DataFrame, vec: str = "vec", target: str = "target",
                  no_rel: str = "is_no_relation", ridge: float = 1e-3) -> DataFrame:
    """Linear map vector -> property vector (with bias) fitted by ridge
    least squares on the rows that are not no-relation (as the projection
    loss masks them).  ``target`` is array<double> or map<bigint,double>.
    Returns the weights as a table: component, w (array, bias last), one row
    for each component that some target has; the weights of all others are 0.

    X'X is (d+1) x (d+1) and the only thing that the driver sees.  X'Y has a
    row for each component: tasks multiply their batches and emit the
    components met, Spark adds them up by component, and tasks solve the
    equations of each with the broadcast factor of X'X."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    checkpoint_dir(df.sparkSession)
    train = df.filter(~F.col(no_rel) & F.col(vec).isNotNull() & F.col(target).isNotNull()).select(
        _design(df, vec).alias("x"), F.col(target).alias("y"))
    first = train.select("x").first()
    if first is None:
        raise ValueError("no training rows")
    d = len(first["x"])

    # defined here so they are shipped to the Python workers by value
    def square(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros((d, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["xx"])

    xx = _summed(train.select("x").mapInArrow(square, "xx array<double>"), ["xx"])[0].reshape(d, d)
    factor = np.linalg.cholesky(xx + ridge * np.eye(d))

    def products(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            offsets, component, value = sparse_columns(b.column(1))
            row = np.repeat(np.arange(len(x)), np.diff(offsets))
            order = np.argsort(component, kind="stable")
            step = max(1, CELLS // d)
            for at in range(0, len(order), step):  # sums of a component may be given in parts
                some = order[at:at + step]
                found, begins = np.unique(component[some], return_index=True)
                sums = np.add.reduceat(x[row[some]] * value[some][:, None], begins, axis=0)
                cuts = np.arange(len(found) + 1, dtype=np.int32) * d
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.ListArray.from_arrays(pa.array(cuts), pa.array(sums.ravel()))], ["component", "xy"])

    def solve(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            xy = b.column(1).flatten().to_numpy().reshape(-1, d)
            w = np.linalg.solve(factor.T, np.linalg.solve(factor, xy.T)).T
            cuts = np.arange(len(w) + 1, dtype=np.int32) * d
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.ascontiguousarray(w).ravel()))], ["component", "w"])

    xy = train.mapInArrow(products, "component bigint, xy array<double>").groupBy("component").agg(
        vector_to_array(Summarizer.sum(array_to_vector("xy"))).alias("xy"))
    return xy.mapInArrow(solve, "component bigint, w array<double>").checkpoint()


def project(df: DataFrame, weights: DataFrame, id_cols: list[str], vec: str = "vec", block: int = 4096) -> DataFrame:
    """ReLU(x W + b) of every row in long form: id columns, component,
    value, zeros left out.  The weights are a table, packed into blocks of
    components; each row meets each block once, which yields up to ``block``
    values, and the rows of a block are dealt over salts."""
    n_blocks = max(1, -(-weights.count() // block))
    blocks = (weights.withColumn("_block", F.pmod(F.xxhash64("component"), F.lit(n_blocks)))
              .groupBy("_block").agg(F.collect_list(F.struct("component", "w")).alias("_w")))
    salts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_blocks)
    blocks = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    each = df.select(*id_cols, _design(df, vec).alias("_x")).withColumn("_salt", F.pmod(F.xxhash64(*id_cols), F.lit(salts)).cast("int"))
    each = each.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    value = F.transform("_w", lambda c: F.struct(c["component"].alias("component"), F.aggregate(
        F.zip_with(F.col("_x"), c["w"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v).alias("value")))
    out = each.join(blocks, ["_block", "_salt"]).select(*id_cols, F.explode(F.filter(value, lambda v: v["value"] > 0)).alias("v"))
    return out.select(*id_cols, "v.component", "v.value")


def with_projection(df: DataFrame, long: DataFrame, id_cols: list[str], out: str = "projection") -> DataFrame:
    """``df`` with the projection as a sparse vector (map<bigint,double>),
    the form that H1-H3 take."""
    maps = long.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(F.struct("component", "value"))).alias(out))
    none = F.create_map().cast("map<bigint,double>")
    return df.join(maps, id_cols, "left").withColumn(out, F.coalesce(out, none))


def projector_residual(df: DataFrame, weights: DataFrame, vec: str = "vec", target: str = "target",
                       no_rel: str = "is_no_relation", ridge: float = 1e-3, ndigits: int = 6) -> DataFrame:
    """(component, residual): largest element, for each component, of
    X'(X w - y) + ridge w over the training rows, relative to X'y, rounded;
    0 everywhere for the weights of ``fit_projector``, of which there is one.
    Made from the rows and not from the sums of the fit."""
    train = df.filter(~F.col(no_rel) & F.col(vec).isNotNull() & F.col(target).isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    is_map = dict(df.dtypes)[target].startswith("map")
    y = train.select("_row", (F.explode if is_map else F.posexplode)(target).alias("component", "y")).select(
        "_row", F.col("component").cast("bigint").alias("component"), "y").filter(F.col("y") != 0)
    x = train.select("_row", F.posexplode(_design(df, vec)).alias("i", "x"))
    w = weights.select("component", F.posexplode("w").alias("i", "w"))
    guess = x.join(w, "i").groupBy("_row", "component").agg(F.sum(F.col("x") * F.col("w")).alias("guess"))
    error = guess.join(y, ["_row", "component"], "left").select("_row", "component", (F.col("guess") - F.coalesce("y", F.lit(0.0))).alias("e"),
                                                               F.coalesce("y", F.lit(0.0)).alias("y"))
    sums = x.join(error, "_row").groupBy("component", "i").agg(F.sum(F.col("x") * F.col("e")).alias("g"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    return sums.join(w, ["component", "i"]).groupBy("component").agg(
        F.round(F.max(F.abs(F.col("g") + ridge * F.col("w"))) / F.max(F.abs("xy")), ndigits).alias("residual"))
