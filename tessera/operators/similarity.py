"""Similarity in the property space.

Distances are Euclidean and cosine *distance* (1 - cosine); a zero row
has a null cosine distance.  Sparse dot products are joins on the
component (E11, E12, E14, E15); rows that share none are never compared.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sparse_join import HOT_ROWS, shared_dots
from tessera.operators.space import Space
from tessera.session import checkpoint_dir

INF = float("inf")


def _euclid(na, nb, ab):
    return F.sqrt(F.greatest(na + nb - F.lit(2.0) * ab, F.lit(0.0)))


def _cos_dist(na, nb, ab):
    return F.when((na > 0) & (nb > 0), F.lit(1.0) - ab / (F.sqrt(na) * F.sqrt(nb)))


def pair_similarity(space: Space, a: str, b: str, ndigits: int | None = 6) -> DataFrame:
    """One row (a, b, euclidean, cosine) via a full outer join of the
    two sparse vectors on the component."""
    ea = space.entries.filter(F.col("predicate") == a).select("component", F.col("value").alias("va"))
    eb = space.entries.filter(F.col("predicate") == b).select("component", F.col("value").alias("vb"))
    j = ea.join(eb, "component", "full_outer")
    s = j.agg(F.coalesce(F.sum(F.col("va") * F.col("vb")), F.lit(0.0)).alias("ab"),
              F.coalesce(F.sum(F.col("va") * F.col("va")), F.lit(0.0)).alias("na"),
              F.coalesce(F.sum(F.col("vb") * F.col("vb")), F.lit(0.0)).alias("nb"))
    eu, co = _euclid(F.col("na"), F.col("nb"), F.col("ab")), _cos_dist(F.col("na"), F.col("nb"), F.col("ab"))
    if ndigits is not None:
        eu, co = F.round(eu, ndigits), F.round(co, ndigits)
    return s.select(F.lit(a).alias("a"), F.lit(b).alias("b"), eu.alias("euclidean"), co.alias("cosine"))


def similarities(space: Space, prop: str, n: int | None = None, ndigits: int | None = 6) -> DataFrame:
    """Distances from ``prop`` to every row, itself included; with
    ``n`` only to those with row_order 0..n.  The target vector joins the
    candidates' entries on the component; its squared norm is one scalar."""
    target = space.entries.filter(F.col("predicate") == prop).select(
        "component", F.col("value").alias("tv"))
    na = float(target.agg(F.coalesce(F.sum(F.col("tv") * F.col("tv")), F.lit(0.0))).first()[0])
    cands = space.rows if n is None else space.rows.filter(F.col("row_order") <= n)
    ce = space.entries if n is None else space.entries.join(cands.select("predicate"), "predicate", "left_semi")
    stats = (ce.join(target, "component", "left")
             .groupBy("predicate")
             .agg(F.sum(F.col("value") * F.coalesce(F.col("tv"), F.lit(0.0))).alias("ab"),
                  F.sum(F.col("value") * F.col("value")).alias("nb")))
    out = cands.join(stats, "predicate", "left").fillna(0.0, ["ab", "nb"])
    eu = _euclid(F.lit(na), F.col("nb"), F.col("ab"))
    co = _cos_dist(F.lit(na), F.col("nb"), F.col("ab"))
    if ndigits is not None:
        eu, co = F.round(eu, ndigits), F.round(co, ndigits)
    return out.select("predicate", "row_order", eu.alias("euclidean"), co.alias("cosine"))


def top_similar(space: Space, prop: str, n: int | None = None, k: int = 10) -> DataFrame:
    """The ``k`` smallest by Euclidean and the ``k`` smallest by cosine
    distance (ties by predicate; a null cosine sorts last).  One pass makes
    both rankings; each task keeps its ``k`` best before they meet."""
    sims = similarities(space, prop, n)
    long = sims.select("predicate", F.explode(F.create_map(
        F.lit("euclidean"), F.col("euclidean"), F.lit("cosine"), F.col("cosine"))).alias("metric", "distance"))
    w = Window.partitionBy("metric").orderBy(F.col("distance").asc_nulls_last(), F.col("predicate"))
    return (long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("metric", "predicate", "distance", "rank"))


def _apart(space_norms: DataFrame, near: DataFrame, k: int, ndigits: int, levels: int, names: int) -> DataFrame:
    """The ``k`` nearest rows of every row by each metric among those that
    it shares no component with: predicate, qs, eu, co (sorted arrays of
    (key, neighbor, distance)) and ``sure``.

    Their distances are known: sqrt(qs + s), and cosine distance 1 (none if
    a row is zero).  So only the rows of least norm can be among them, and by
    cosine the first names; ``levels`` least norms are listed with ``names``
    names each.  ``sure`` says that no row outside the list can belong to
    the ``k``, ties after rounding included.  ``near``: predicate,
    ``neighbor`` of rows that share a component."""
    n_rows = space_norms.count()
    by_norm = Window.partitionBy("sq").orderBy("predicate")
    sizes = space_norms.groupBy("sq").agg(F.count(F.lit(1)).alias("size"))
    least = sizes.orderBy("sq").limit(levels + 1).collect()
    listed = [r["sq"] for r in least[:levels]]
    size = {r["sq"]: r["size"] for r in least}
    low = (space_norms.filter(F.col("sq") <= max(listed, default=0.0)).withColumn("_r", F.row_number().over(by_norm))
           .filter(F.col("_r") <= names).select("predicate", "sq").collect())
    by_name = Window.partitionBy(F.col("sq") > 0).orderBy("predicate")
    full = (space_norms.withColumn("_r", F.row_number().over(by_name)).filter(F.col("_r") <= names)
            .select("predicate", "sq").collect())
    n_zero = size.get(0.0, 0)

    def literal(rows):
        return F.from_json(F.lit(json.dumps([{"p": r["predicate"], "s": r["sq"]} for r in rows])), "array<struct<p:string,s:double>>")

    known = sorted({r["predicate"] for r in low} | {r["predicate"] for r in full})
    met = near.groupBy("predicate").agg(
        F.count(F.lit(1)).alias("n_met"), F.collect_set(F.when(F.col("neighbor").isin(known), F.col("neighbor"))).alias("met"))
    rows = space_norms.select("predicate", F.col("sq").alias("qs")).join(met, "predicate", "left")
    rows = rows.withColumn("met", F.coalesce("met", F.array().cast("array<string>"))).withColumn("n_met", F.coalesce("n_met", F.lit(0)))
    rows = rows.withColumn("low", F.filter(literal(low), lambda x: ~F.array_contains("met", x["p"])))
    rows = rows.withColumn("all", F.filter(literal(full), lambda x: ~F.array_contains("met", x["p"])))

    def ranked(col, dist):
        each = F.transform(col, lambda x: F.struct(F.coalesce(F.round(dist(x), ndigits), F.lit(INF)).alias("key"),
                                                   x["p"].alias("neighbor"), F.round(dist(x), ndigits).alias("distance")))
        return F.slice(F.array_sort(each), 1, k)

    def eu(s):
        return F.round(F.sqrt(F.col("qs") + s), ndigits)

    rows = rows.withColumn("eu", ranked("low", lambda x: F.sqrt(F.col("qs") + x["s"])))
    rows = rows.withColumn("co", ranked("all", lambda x: F.when((F.col("qs") > 0) & (x["s"] > 0), F.lit(1.0))))
    apart = F.lit(n_rows) - F.col("n_met")
    last = F.element_at(F.transform("eu", lambda x: x["key"]), -1)
    # every truncated norm within the k-th distance has k names left, and the next norm is beyond it
    cut = [r["sq"] for r in least[:levels] if r["size"] > names]
    enough = F.lit(True)
    for v in cut:
        enough = enough & ((eu(F.lit(v)) > last) | (F.size(F.filter("low", lambda x, v=v: x["s"] == F.lit(v))) >= k))
    if len(least) > levels:
        enough = enough & (eu(F.lit(least[levels]["sq"])) > last)
    sure_eu = (F.size("low") >= apart) | ((F.size("eu") >= k) & enough)
    some = F.size(F.filter("all", lambda x: x["s"] > 0))
    none = F.size(F.filter("all", lambda x: x["s"] == 0))
    # a zero row ranks all rows by name alone, the others those that are not zero first
    sure_co = (F.size("all") >= apart) | F.when(F.col("qs") > 0, (some >= k) | ((n_rows - n_zero <= names) & ((none >= k) | (n_zero <= names)))).otherwise(
        ((some >= k) | (n_rows - n_zero <= names)) & ((none >= k) | (n_zero <= names)))
    return rows.select("predicate", "qs", "eu", "co", (sure_eu & sure_co).alias("sure"))


def all_pairs_similarity(space: Space, k: int = 10, ndigits: int = 6, hot_rows: int = HOT_ROWS,
                         levels: int | None = None) -> DataFrame:
    """E13 for every row at once: (predicate, metric, rank, neighbor,
    distance), the ``k`` nearest rows by each metric, self included.

    Rows meet on the components that they share (``shared_dots``); rows that
    share none are never compared, as their distances follow from the norms
    (``_apart``).  What lies beyond the ``k``-th of those is dropped before
    the ranking.  ``levels`` least norms are listed at first, and more for
    the rows for which that was not enough."""
    checkpoint_dir(space.rows.sparkSession)
    entries = space.entries.filter(F.col("value") != 0).select("predicate", "component", "value").checkpoint()
    sq = entries.groupBy("predicate").agg(F.sum(F.col("value") * F.col("value")).alias("sq"))
    norms = space.rows.select("predicate").join(sq, "predicate", "left").fillna(0.0, ["sq"]).checkpoint()
    withs = entries.join(norms, "predicate")
    near = shared_dots(
        withs.select("predicate", "component", F.col("value").alias("va"), F.col("sq").alias("qs")),
        withs.select(F.col("predicate").alias("neighbor"), "component", F.col("value").alias("vb"), F.col("sq").alias("s")),
        ["predicate"], ["neighbor"], {"qs": F.max("qs"), "s": F.max("s")}, hot_rows).checkpoint()
    levels = levels or 4 * k
    apart = _apart(norms, near, k, ndigits, levels, levels).checkpoint()
    done = apart.filter("sure")
    while apart.filter(~F.col("sure")).take(1):
        levels *= 4
        left = apart.filter(~F.col("sure")).select("predicate")
        apart = _apart(norms, near, k, ndigits, levels, levels).join(left, "predicate", "left_semi").checkpoint()
        done = done.unionByName(apart.filter("sure"))

    ranks = F.explode(F.array(F.struct(F.lit("euclidean").alias("metric"), F.col("eu").alias("far")),
                              F.struct(F.lit("cosine").alias("metric"), F.col("co").alias("far")))).alias("m")
    far = done.select("predicate", ranks).select("predicate", "m.metric", "m.far")
    bound = F.when(F.size("far") >= k, F.element_at("far", F.when(F.size("far") > 0, -1))["key"]).otherwise(INF)
    dist = [F.round(_euclid(F.col("qs"), F.col("s"), F.col("ab")), ndigits), F.round(_cos_dist(F.col("qs"), F.col("s"), F.col("ab")), ndigits)]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), d.alias("distance")) for m, d in zip(("euclidean", "cosine"), dist)])).alias("d")
    close = near.select("predicate", "neighbor", each).select(
        "predicate", "d.metric", F.coalesce("d.distance", F.lit(INF)).alias("key"), "neighbor", "d.distance")
    close = close.join(far.select("predicate", "metric", bound.alias("bound")), ["predicate", "metric"]).filter(
        F.col("key") <= F.col("bound")).drop("bound")
    cand = close.unionByName(far.select("predicate", "metric", F.explode("far").alias("f")).select(
        "predicate", "metric", "f.key", "f.neighbor", "f.distance"))
    w = Window.partitionBy("predicate", "metric").orderBy("key", "neighbor")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("predicate", "metric", F.col("rank").cast("bigint").alias("rank"),
                    "neighbor", "distance"))


#: Length of the residual of a component, of the first eigenvalue.
PCA_TOLERANCE = 1e-9


def pca(space: Space, k: int = 2, max_columns: int = 40, max_steps: int = 2000) -> DataFrame:
    """Scores on the first ``k`` principal components of the
    mean-centred space (the sign of a component is free; tied components are
    any rotation of them).

    A growing Krylov subspace on the sparse entries: a few columns are
    multiplied by the space (join on the predicate, sums per component) and
    back (join on the component, sums per predicate) and centred.  The
    residuals of the best directions, made orthogonal to all columns twice,
    are the next ones; at ``max_columns`` the best directions are kept
    (locked) and the others dropped.  Only sums of products of columns reach
    the driver.  It ends when the residual of every component, measured on
    the rows, is at most ``PCA_TOLERANCE`` of the first eigenvalue, and
    raises an error if ``max_steps`` do not suffice."""
    import numpy as np

    checkpoint_dir(space.rows.sparkSession)
    rows = space.rows.select("predicate", F.col("row_order").cast("bigint").alias("row_order")).checkpoint()
    entries = space.entries.select("predicate", "component", "value").checkpoint()
    n = rows.count()
    scores = [f"pc{j + 1}" for j in range(k)]
    if not n:
        return rows.select("predicate", "row_order", *[F.lit(0.0).alias(c) for c in scores])
    width = min(k + 2, n)
    order = np.arange

    def products(table):
        """Sums of ``v`` and of v v' over all rows, batch by batch."""
        def work(batches):
            import numpy as np
            import pyarrow as pa
            total = 0
            for b in batches:
                if b.num_rows:
                    v = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                    v = np.concatenate([v, np.ones((len(v), 1))], 1)
                    total = total + v.T @ v
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["s"])

        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer
        out = table.select("v").mapInArrow(work, "s array<double>").select(Summarizer.sum(array_to_vector("s")).alias("s")).first()["s"].toArray()
        size = int(round(len(out) ** 0.5))
        out = out.reshape(size, size)
        return out[:-1, :-1], out[-1, :-1] / n

    def turned(table, by, shift):
        """``v`` times a small matrix, less ``shift``."""
        def work(batches):
            import numpy as np
            import pyarrow as pa
            for b in batches:
                if b.num_rows:
                    v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) @ by - shift
                    cuts = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(v.ravel()))], ["predicate", "v"])
        return table.mapInArrow(work, "predicate string, v array<double>")

    def orthonormal(table, sums, means, size, others):
        """The columns behind the first ``size`` orthonormal ones and
        ``others`` more: centred, orthogonal to the first ones and to each
        other; directions that vanish go.  (table, number left)"""
        for again in (True, False):
            along = sums[:size, size + others:]
            m = means[size + others:]
            gram = sums[size + others:, size + others:] - along.T @ along - n * np.outer(m, m)
            values, vectors = np.linalg.eigh((gram + gram.T) / 2)
            good = values > max(values.max(initial=0), 1e-300) * 1e-13
            turn = vectors[:, good] / np.sqrt(values[good])
            by = np.zeros((size + others + len(m), size + others + turn.shape[1]))
            by[order(size + others), order(size + others)] = 1
            by[:size, size + others:] = -along @ turn
            by[size + others:, size + others:] = turn
            table = turned(table, by, np.append(np.zeros(size + others), m @ turn))
            if not good.any():
                return table, 0
            if again:
                sums, means = products(table)
        return table, turn.shape[1]

    table = rows.select("predicate", F.array(*[F.xxhash64("predicate", F.lit(j)) / float(1 << 63) for j in range(width)]).alias("v"))
    table, fresh = orthonormal(table, *products(table), 0, 0)
    size = 0  # v holds the columns done, what the space makes of them, and the new columns
    for _ in range(max_steps):
        if not fresh:
            break
        new = [F.get("v", F.lit(2 * size + j)).alias(f"q{j}") for j in range(fresh)]
        table = table.checkpoint()
        across = entries.join(table.select("predicate", *new), "predicate").groupBy("component").agg(
            *[F.sum(F.col("value") * F.col(f"q{j}")).alias(f"q{j}") for j in range(fresh)])
        back = entries.join(across, "component").groupBy("predicate").agg(
            *[F.sum(F.col("value") * F.col(f"q{j}")).alias(f"a{j}") for j in range(fresh)])
        v = F.concat(F.slice("v", 1, size), F.slice("v", 2 * size + 1, fresh), F.slice("v", size + 1, size),
                     F.array(*[F.coalesce(f"a{j}", F.lit(0.0)) for j in range(fresh)]))
        table = table.join(back, "predicate", "left").select("predicate", v.alias("v")).checkpoint()
        size += fresh
        sums, means = products(table)
        theta = sums[:size, size:]  # columns are centred, so the means of the images drop out
        values, vectors = np.linalg.eigh((theta + theta.T) / 2)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        some = min(width, size)
        kept = size if size + some <= max_columns else min(size, width + k + 6)
        top = vectors[:, :kept] if kept < size else np.eye(size)
        by = np.zeros((2 * size, 2 * kept + some))
        by[:size, :kept], by[size:, kept:2 * kept] = top, top
        by[:size, 2 * kept:], by[size:, 2 * kept:] = -vectors[:, :some] * values[:some], vectors[:, :some]
        shift = np.concatenate([np.zeros(kept), means[size:] @ top, means[size:] @ vectors[:, :some]])
        table = turned(table, by, shift)
        if kept < size:
            vectors = np.eye(kept)
        size = kept
        sums, means = products(table)
        left = np.sqrt(np.clip(np.diag(sums)[2 * size:], 0, None)[:k])  # residuals, measured on the rows
        if size >= n or left.max(initial=0) <= PCA_TOLERANCE * max(values[0], 1e-300):
            break
        table, fresh = orthonormal(table, sums, means, size, size)
    else:
        raise ValueError(f"the first {k} components are not found in {max_steps} steps; allow more")
    by = np.zeros((2 * size + (len(sums) - 2 * size if size else 0), k))
    if size:  # otherwise all rows are equal
        by[:size, :min(k, size)] = (vectors[:size] * np.sqrt(values[:vectors.shape[1]]))[:, :k]
        if not fresh:
            by = by[:2 * size]
    else:
        by = np.zeros((0, k))
    out = turned(table, by, np.zeros(k))
    return rows.join(out, "predicate").select("predicate", "row_order", *[F.get("v", F.lit(j)).alias(c) for j, c in enumerate(scores)])


def pca_residual(space: Space, components: DataFrame, k: int = 2, ndigits: int = 6) -> DataFrame:
    """What is left of the equations that principal components solve, one
    row a component: ``mean`` of the scores, largest ``overlap`` with
    another component, and ``residual`` of the eigenvalue equation; each
    relative, rounded, and 0 for a component."""
    cols = [f"pc{j + 1}" for j in range(k)]
    across = space.entries.join(components, "predicate").groupBy("component").agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in cols])
    back = space.entries.join(across, "component").groupBy("predicate").agg(*[F.sum(F.col("value") * F.col(c)).alias(f"a{c}") for c in cols])
    both = components.join(back, "predicate", "left").fillna(0.0)
    sums = both.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in cols for b in cols], *[F.sum(F.col(c)).alias(f"s{c}") for c in cols],
                    *[F.avg(f"a{c}").alias(f"m{c}") for c in cols], F.count(F.lit(1)).alias("n"))
    # a component's squared length is its eigenvalue
    each = both.join(F.broadcast(sums)).agg(*[F.sqrt(F.sum(F.pow(F.col(f"a{c}") - F.col(f"m{c}") - F.col(f"{c}{c}") * F.col(c), 2))).alias(f"r{c}") for c in cols])
    first = F.col(f"{cols[0]}{cols[0]}")
    rows = F.array(*[F.struct(F.lit(j + 1).cast("bigint").alias("component"),
                              F.round(F.abs(F.col(f"s{c}")) / F.sqrt(first * F.col("n")), ndigits).alias("mean"),
                              F.round(F.greatest(*[F.abs(F.col(f"{c}{d}")) for d in cols if d != c], F.lit(0.0), F.lit(0.0)) / first, ndigits).alias("overlap"),
                              F.round(F.col(f"r{c}") / F.pow(first, 1.5), ndigits).alias("residual")) for j, c in enumerate(cols)])
    return sums.join(F.broadcast(each)).select(F.explode(rows).alias("x")).select("x.*")
