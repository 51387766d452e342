"""Nearest space row by cosine, exact, in a space that no task can hold.

Rows are dealt to pivots, a sample of the rows, each to the pivot at the
least angle, sorted by pivot and angle, and cut into blocks of a bounded size.
What a block holds of a pivot is a ring: its rows lie between two angles from
that pivot, so the angle from a query to any of them is no less than the
query's own distance from the ring.  A query goes to its most promising block
first, and then only to the blocks that can still hold a row as near as the
one found.  Queries and the rows of a block meet in one task, rows first; a
block that many queries ask is copied, so that no task answers more than some
thousands.  A task holds one block as a ``SpaceIndex``; what is shuffled is
the rows, and each query as often as a block cannot be ruled out for it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.nearest import ANGLE_SLACK, CELLS, NORM_EPS, RANK_DIGITS, TINY, SpaceIndex, sparse_columns
from tessera.session import checkpoint_dir, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PIVOTS, MAX_PIVOT_ENTRIES = 256, 1 << 20
BLOCK_SIZE = 1 << 19  # rows and entries of a block
BLOCK_QUERIES = 1 << 15  # queries that one copy of a block answers
COPIES_AT_ONCE = 10_000  # queries that a task hands on at a time

ROWS = "predicate string, o bigint, pivot int, angle double, stretch double, norm double, component array<bigint>, value array<double>"
ASKED = "block bigint, qid bigint, known double, component array<bigint>, value array<double>"
ANSWERS = "qid bigint, negated double, o bigint, predicate string, sim double"


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lists(offsets: np.ndarray, component: np.ndarray, value: np.ndarray) -> tuple[pa.Array, pa.Array]:
    cuts = pa.array(offsets.astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.array(component, pa.int64())), pa.ListArray.from_arrays(cuts, pa.array(value, pa.float64()))


def _flat(component: pa.Array, value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = component.offsets.to_numpy().astype(np.int64)
    return at - at[0], component.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)


def _merged(e: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, components and values of sorted entries, those of one
    component added up; and the norm over the single entries."""
    at = e.offsets.to_numpy().astype(np.int64)
    cut, n = slice(at[0], at[-1]), len(at) - 1
    component = e.values.field(0).to_numpy(zero_copy_only=False)[cut]
    value = e.values.field(1).to_numpy(zero_copy_only=False)[cut]
    row = np.repeat(np.arange(n), np.diff(at))
    norm = np.sqrt(np.bincount(row, value * value, n))
    if len(row):
        begins = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (component[1:] != component[:-1])))
        row, component, value = row[begins], component[begins], np.add.reduceat(value, begins)
    return np.searchsorted(row, np.arange(n + 1)), component, value, norm


def _lengths(offsets: np.ndarray, value: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    return np.sqrt(np.bincount(np.repeat(np.arange(n), np.diff(offsets)), value * value, n))


def _index(offsets, component, value, norm=None) -> SpaceIndex:
    n = len(offsets) - 1
    return SpaceIndex(np.arange(n), np.arange(n), np.repeat(np.arange(n), np.diff(offsets)), component, value, norm)


def _vectors(rows: DataFrame, entries: DataFrame, last: bool) -> DataFrame:
    """predicate, o (rows are ranked by o, then predicate), e (sorted
    entries).  Rows of one name have one vector, so only the first of them
    can be the nearest; the same holds for the rows without an entry."""
    o = -F.col("row_order") if last else F.col("row_order")
    named = rows.groupBy("predicate").agg(F.min(F.struct(o.cast("bigint").alias("o"))).alias("f")).select("predicate", "f.o")
    own = entries.filter(F.col("component").isNotNull() & (F.col("value") != 0)).groupBy("predicate").agg(
        F.sort_array(F.collect_list(F.struct("component", "value"))).alias("e"))
    every = named.join(own, "predicate", "left")
    zero = every.filter(F.col("e").isNull()).agg(F.min(F.struct("o", "predicate")).alias("f")).filter(F.col("f").isNotNull())
    return every.filter(F.col("e").isNotNull()).unionByName(zero.select("f.predicate", "f.o"), allowMissingColumns=True)


def _pivots(vectors: DataFrame) -> tuple[SpaceIndex, np.ndarray]:
    """Index of the pivots, of bounded size together, and how much longer
    than its norm each is (1 but for rows with repeated components)."""
    drawn = vectors.filter(F.col("e").isNotNull()).orderBy(F.xxhash64("predicate", "o"), "predicate")
    sizes = [r[0] for r in drawn.limit(MAX_PIVOTS).select(F.size("e")).collect()]
    n = max(1, int((np.cumsum(sizes) <= MAX_PIVOT_ENTRIES).sum()))
    e = [r["e"] for r in drawn.limit(n).select("e").collect()]
    kind = pa.list_(pa.struct([("component", pa.int64()), ("value", pa.float64())]))
    offsets, component, value, norm = _merged(pa.array([[tuple(x) for x in v] for v in e], kind))
    length = _lengths(offsets, value)
    good = np.isfinite(norm) & (length > TINY)
    kept = np.repeat(good, np.diff(offsets))
    offsets = np.append(0, np.cumsum(np.diff(offsets)[good]))
    return _index(offsets, component[kept], value[kept]), (length / np.maximum(norm, NORM_EPS))[good]


def _blocks(vectors: DataFrame, pivots: SpaceIndex, size: int) -> DataFrame:
    """``ROWS`` and ``block``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, component, value, norm = _merged(b.column(2))
            length = _lengths(offsets, value)
            cosines = pivots.scores(offsets, component, value)
            placed = (length > TINY) & np.isfinite(norm) & (len(pivots.names) > 0)
            pivot, angle = np.full(len(norm), -1), np.zeros(len(norm))  # rows without a pivot are never ruled out
            if len(pivots.names):
                pivot[placed] = cosines[placed].argmax(1)
                angle[placed] = np.arccos(np.clip(cosines[placed].max(1), -1, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pivot, pa.int32()), pa.array(angle), pa.array(length / np.maximum(norm, NORM_EPS)),
                 pa.array(norm), *_lists(offsets, component, value)],
                ["predicate", "o", "pivot", "angle", "stretch", "norm", "component", "value"]).filter(pa.array(np.isfinite(norm)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            at = before + np.cumsum(1 + np.diff(b.column(6).offsets.to_numpy()))
            before = int(at[-1]) if len(at) else before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + at // size, pa.int64())], [*b.schema.names, "block"])

    dealt = _kept(vectors.mapInArrow(assign, ROWS), "dealt-rows")
    total = dealt.agg(F.sum(1 + F.size("component"))).first()[0] or 0
    order = ["pivot", "angle", "o", "predicate"]
    return _kept(dealt.repartitionByRange(total // size + 1, *order).sortWithinPartitions(*order).mapInArrow(cut, ROWS + ", block bigint"), "dealt-blocks")


class Rings:
    """What is known of the blocks: one ring for each block and pivot in it."""

    def __init__(self, rings: list, pivots: SpaceIndex, stretch: np.ndarray):
        rings = sorted(rings, key=lambda r: r["block"])
        self.pivots, self.stretch = pivots, stretch
        block, self.pivot = (np.array([r[c] for r in rings], np.int64) for c in ("block", "pivot"))
        self.low, self.high, self.least, self.most = (np.array([r[c] for r in rings], float) for c in ("low", "high", "least", "most"))
        self.blocks, self.begins = np.unique(block, return_index=True)

    def of(self, offsets, component, value) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Some queries at a time: place of the first; the most promising
        block; the cosine that no row of a block exceeds; one that is reached."""
        step, norms = max(1, CELLS // max(len(self.pivot), len(self.stretch), 1)), _lengths(offsets, value)
        for a in range(0, len(norms), step):
            z = min(len(norms), a + step)
            cut = slice(offsets[a], offsets[z])
            cosines = np.clip(self.pivots.scores(offsets[a:z + 1] - offsets[a], component[cut], value[cut]), -1, 1)
            sure = norms[a:z] > TINY
            reached = np.where(sure, (cosines * self.stretch).max(1, initial=-np.inf), -np.inf)
            there = self.pivot >= 0
            bound = np.full((z - a, len(self.pivot)), np.inf)
            hope = np.full(bound.shape, -2.0)
            if there.any():
                to_pivot = cosines[:, self.pivot[there]]
                angle = np.arccos(to_pivot)
                near = np.cos(np.clip(np.maximum(angle - self.high[there], self.low[there] - angle) - ANGLE_SLACK, 0, np.pi))
                bound[:, there] = np.where(near > 0, near * self.most[there], near * self.least[there]) + 1e-11 * np.maximum(1, self.most[there])
                hope[:, there] = near + 1e-3 * to_pivot
            bound[~sure] = np.inf
            yield a, np.maximum.reduceat(hope, self.begins, axis=1).argmax(1), np.maximum.reduceat(bound, self.begins, axis=1), reached


def _asked(queries: DataFrame, rings: Rings, first: bool) -> DataFrame:
    """``ASKED`` of (qid, vec), their most promising block; or of (qid, vec,
    negated), the others that may hold a row as near as the one found.
    Queries without a value ask none."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, component, value = sparse_columns(b.column(1))
            vectors, some = _lists(offsets, component, value), np.diff(offsets) > 0
            key = np.full(len(some), -np.inf) if first else -b.column(2).to_numpy(zero_copy_only=False).astype(float)
            key = np.where(np.isnan(key), -np.inf, key)
            for a, best, bound, reached in rings.of(offsets, component, value):
                z = a + len(best)
                least = np.maximum(reached, key[a:z])
                each = np.arange(len(best))
                if first:
                    wanted = np.zeros(bound.shape, bool)
                    wanted[each, best] = True
                else:
                    wanted = bound >= least[:, None]
                    wanted[each, best] = False
                wanted &= some[a:z, None]
                q, k = np.nonzero(wanted)
                for i in range(0, len(q), COPIES_AT_ONCE):
                    qs, ks = q[i:i + COPIES_AT_ONCE], k[i:i + COPIES_AT_ONCE]
                    at = pa.array(a + qs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rings.blocks[ks]), b.column(0).take(at), pa.array(least[qs]), *(v.take(at) for v in vectors)],
                        ["block", "qid", "known", "component", "value"])

    return queries.mapInArrow(ask, ASKED)


def _answers(blocks: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """``ANSWERS``: the best row of the block, if it is not ruled out."""
    spark = blocks.sparkSession
    counts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("copies")).collect()  # a row for each block
    copies = F.broadcast(spark.createDataFrame([tuple(r) for r in counts], "block bigint, copies int"))
    rows = blocks.join(copies, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"),
        "o", "predicate", F.col("norm").alias("x"), "component", "value")
    each = asked.join(copies, "block").select(
        "block", F.pmod(F.xxhash64("qid"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"),
        F.col("qid").alias("o"), F.lit(None).cast("string").alias("predicate"), F.col("known").alias("x"), "component", "value")
    parts = max(sum(r["copies"] for r in counts), int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = rows.unionByName(each).repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "kind", "o", "predicate")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, group, names, orders = [], None, None, None, None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            cuts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            for a, z in zip(cuts, np.append(cuts[1:], len(keys))):
                if a == z:
                    continue
                part, of = b.slice(a, z - a), tuple(keys[a, :2])
                if of != group:
                    held, index, group = [], None, of
                if not keys[a, 2]:
                    held.append(part)
                    continue
                if index is None:
                    block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, orders, names = [], block.column(3), block.column(4)
                    index = _index(*_flat(block.column(6), block.column(7)), block.column(5).to_numpy())
                row, sim = index.best(*_flat(part.column(6), part.column(7)), known=part.column(5).to_numpy())
                got = np.flatnonzero(row >= 0)
                at = pa.array(row[got])
                yield pa.RecordBatch.from_arrays(
                    [part.column(3).take(pa.array(got)), pa.array(0.0 - np.round(sim[got], RANK_DIGITS)), orders.take(at), names.take(at), pa.array(sim[got])],
                    ["qid", "negated", "o", "predicate", "sim"])

    return met.mapInArrow(answer, ANSWERS)


def add_nearest_dealt(queries: DataFrame, vec: str, rows: DataFrame, entries: DataFrame, last: bool = False,
                      size: int = BLOCK_SIZE, most: int = BLOCK_QUERIES) -> DataFrame:
    """``queries`` with ``nearest``, ``nearest_order`` and ``sim``: of equal
    cosines (after rounding) the row of lowest row order, or highest, and of
    those the first name.  Null components and values of an entry count as
    none, rows whose norm is no number are never the nearest."""
    spark = queries.sparkSession
    checkpoint_dir(spark)
    numbered = queries.withColumn("qid", F.monotonically_increasing_id()).checkpoint()
    vectors = _kept(_vectors(rows, entries, last), "dealt-vectors")
    pivots, stretch = _pivots(vectors)
    blocks = _blocks(vectors, pivots, size)
    found = blocks.groupBy("block", "pivot").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("stretch").alias("least"), F.max("stretch").alias("most")).collect()
    names = [F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("bigint").alias("nearest_order"), F.lit(None).cast("double").alias("sim")]
    if not found:
        return queries.select("*", *names)
    rings = Rings(found, pivots, stretch)  # no more than blocks and pivots together
    ask = numbered.select("qid", F.col(vec).alias("vec"))
    one = _kept(_answers(blocks, _kept(_asked(ask, rings, True), "dealt-asked"), most), "dealt-answers")
    again = ask.join(one.select("qid", "negated"), "qid", "left")
    two = _answers(blocks, _kept(_asked(again, rings, False), "dealt-asked"), most)
    best = one.unionByName(two).groupBy("qid").agg(F.min(F.struct("negated", "o", "predicate", "sim")).alias("b"))
    top = blocks.agg(F.min(F.struct("o", "predicate")).alias("f")).first()["f"]  # what a query without a value gets
    zero = F.struct(F.lit(0.0).alias("negated"), F.lit(top["o"]).cast("bigint").alias("o"),
                    F.lit(top["predicate"]).cast("string").alias("predicate"), F.lit(0.0).alias("sim"))
    b = F.coalesce("b", zero)
    order = -b["o"] if last else b["o"]
    return numbered.join(best, "qid", "left").select(
        *queries.columns, b["predicate"].alias("nearest"), order.alias("nearest_order"), b["sim"].alias("sim"))
