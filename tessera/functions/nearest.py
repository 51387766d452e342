"""Nearest space row by cosine, exact, with whole clusters of rows skipped.

The rows of a space of checked size are dealt to pivots, a sample of the
rows, each to the pivot at the least angle.  An angle to a row is no less
than the angle to its pivot minus the largest angle between that pivot and
its rows; a cluster whose rows cannot come up to the best row found so far is
not looked at.  Queries stay where they are: each task holds the index and
reads its queries batch by batch, so no query vector is shuffled or copied.
Vectors are sparse, so the width of a space does not matter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

NORM_EPS = 1e-8  # cosine clamps norms here
TINY = 1e-6  # rows and queries shorter than this are never skipped
ANGLE_SLACK = 1e-7  # angles near zero are only known to about the root of the precision
MAX_PIVOTS = 256
CELLS = 1 << 22  # numbers held at a time
RANK_DIGITS = 12


class SpaceIndex:
    """Rows in row order, cut into clusters round pivots.  ``norm``: other
    norms than the rows' own lengths."""

    def __init__(self, names, orders, row, component, value, norm=None):
        self.names, self.orders = np.asarray(names, object), np.asarray(orders, np.int64)
        n = len(self.names)
        row, value = np.asarray(row, np.int64), np.asarray(value, float)
        self.components, column = np.unique(np.asarray(component, np.int64), return_inverse=True)
        by_row = np.argsort(row, kind="stable")
        self.column, self.value = column[by_row], value[by_row]
        self.start = np.searchsorted(row[by_row], np.arange(n + 1))
        length = np.sqrt(np.bincount(row, value * value, n)) if n else np.zeros(0)
        self.norm = length if norm is None else np.asarray(norm, float)
        stretch = np.ones(n) if norm is None else length / np.maximum(self.norm, NORM_EPS)
        self.looked_at = 0  # rows compared with queries (what was not skipped)
        seen = np.flatnonzero((length > TINY) & (self.norm > TINY))
        pivots = seen[np.unique(np.linspace(0, len(seen) - 1, min(MAX_PIVOTS, int(np.ceil(np.sqrt(len(seen))))), dtype=int))] if len(seen) else seen
        self.pivots = self._block(pivots)
        nearest, angle = np.zeros(len(seen), int), np.zeros(len(seen))
        step = self._at_once(self.pivots)
        for a in range(0, len(seen), step):
            some = seen[a:a + step]
            cosines = self._dots(self._dense_rows(some), self.pivots) / np.outer(length[some], length[pivots])
            nearest[a:a + step] = cosines.argmax(1)
            angle[a:a + step] = np.arccos(np.clip(cosines.max(1), -1, 1))
        self.clusters = [self._block(seen[nearest == k]) for k in range(len(pivots))]
        self.radius = np.array([angle[nearest == k].max(initial=0) for k in range(len(pivots))])
        self.pivot_stretch = stretch[pivots]
        self.stretch = np.array([[stretch[c[0]].min(initial=1), stretch[c[0]].max(initial=1)] for c in self.clusters]).reshape(-1, 2).T
        rest = np.flatnonzero((length <= TINY) | (self.norm <= TINY))
        self.rest = self._block(rest)

    def _block(self, rows: np.ndarray):
        """Rows, their columns and values one after another, and where each
        row begins (rows without a value have none)."""
        sizes = self.start[rows + 1] - self.start[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.start[rows] - (np.cumsum(sizes) - sizes), sizes)
        return rows, self.column[at], self.value[at], (np.cumsum(sizes) - sizes)[sizes > 0], sizes > 0

    def _dense_rows(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(self.components)))
        for k, r in enumerate(rows):
            at = slice(self.start[r], self.start[r + 1])
            out[k, self.column[at]] = self.value[at]
        return out

    def _at_once(self, block) -> int:
        return int(max(1, min(4096, CELLS // max(len(self.components), len(block[1]), 1))))

    @staticmethod
    def _dots(queries: np.ndarray, block) -> np.ndarray:
        rows, column, value, begins, has = block
        out = np.zeros((len(queries), len(rows)))
        if len(column):
            out[:, has] = np.add.reduceat(queries[:, column] * value, begins, axis=1)
        return out

    def _cosines(self, queries: np.ndarray, norms: np.ndarray, block) -> np.ndarray:
        out = np.empty((len(queries), len(block[0])))
        step = self._at_once(block)
        for a in range(0, len(queries), step):
            out[a:a + step] = self._dots(queries[a:a + step], block)
        self.looked_at += out.size
        return out / np.outer(np.maximum(norms, NORM_EPS), np.maximum(self.norm[block[0]], NORM_EPS))

    def batches(self, offsets, column, value) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Queries in dense form over the space's components, as many as fit:
        place of the first, matrix, norms (over all their components)."""
        n = len(offsets) - 1
        step = int(max(1, min(4096, CELLS // max(len(self.components), 1))))
        for a in range(0, n, step):
            z = min(n, a + step)
            c, v = column[offsets[a]:offsets[z]], value[offsets[a]:offsets[z]]
            r = np.repeat(np.arange(z - a), np.diff(offsets[a:z + 1]))
            norms = np.sqrt(np.bincount(r, v * v, z - a))
            dense = np.zeros((z - a, len(self.components)))
            if len(self.components):
                at = np.minimum(np.searchsorted(self.components, c), len(self.components) - 1)
                there = self.components[at] == c
                dense[r[there], at[there]] = v[there]
            yield a, dense, norms

    def best(self, offsets, column, value, last: bool = False, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row and cosine of the nearest row of every query; of equal ones
        the first in row order, or the last.  ``known``: cosines that rows
        elsewhere reach; row -1 if no row here can come up to that."""
        n = len(offsets) - 1
        found, sims = np.full(n, -1, np.int64), np.full(n, -np.inf)
        for a, dense, norms in self.batches(offsets, column, value):
            m = len(dense)
            key, row, sim = np.full(m, -np.inf), np.full(m, -1, np.int64), np.zeros(m)

            def look(block, which):
                step = max(1, CELLS // max(len(block[0]), 1))
                for z in range(0, len(which) if len(block[0]) else 0, step):
                    look_at(block, which[z:z + step])

            def look_at(block, which):
                c = self._cosines(dense[which], norms[which], block)
                k = np.round(c, RANK_DIGITS)
                at = (k.shape[1] - 1 - k[:, ::-1].argmax(1)) if last else k.argmax(1)
                at_rows, each = block[0][at], np.arange(len(which))
                k, c = k[each, at], c[each, at]
                tie = (k == key[which]) & ((at_rows > row[which]) if last else (at_rows < row[which]))
                better = (k > key[which]) | tie
                w = which[better]
                key[w], row[w], sim[w] = k[better], at_rows[better], c[better]

            every = np.arange(m)
            if len(self.pivots[0]):
                to_pivot = self._cosines(dense, norms, self.pivots)
                bound = np.cos(np.clip(np.arccos(np.clip(to_pivot / self.pivot_stretch, -1, 1)) - self.radius - ANGLE_SLACK, 0, np.pi))
                least, most = self.stretch
                bound = np.where(bound > 0, bound * most, bound * least) + 1e-11 * np.maximum(1, most)
                bound[norms <= TINY] = most
                floor = to_pivot.max(1)
                if known is not None:
                    floor = np.maximum(floor, known[a:a + m])
                for k in np.argsort(-bound.mean(0)):
                    look(self.clusters[k], every[bound[:, k] >= np.maximum(floor, key)])
            look(self.rest, every)
            found[a:a + m], sims[a:a + m] = row, sim
        return found, sims

    def scores(self, offsets, column, value) -> np.ndarray:
        """Cosine of every query with every row, in row order."""
        whole = self._block(np.arange(len(self.names)))
        out = [self._cosines(dense, norms, whole) for _, dense, norms in self.batches(offsets, column, value)]
        return np.concatenate(out) if out else np.zeros((0, len(self.names)))


def space_index(long_rows: DataFrame) -> SpaceIndex:
    """Index of (predicate, row_order, component, value) rows, a null
    component for a row without a value.  The caller checks the size."""
    t = long_rows.toPandas().sort_values(["row_order", "predicate"], kind="stable")
    rows = t[["predicate", "row_order"]].drop_duplicates()
    number = {k: i for i, k in enumerate(zip(rows["predicate"], rows["row_order"]))}
    t["row"] = [number[k] for k in zip(t["predicate"], t["row_order"])]
    e = t[t["component"].notna() & (t["value"] != 0)]
    return SpaceIndex(rows["predicate"], rows["row_order"], e["row"], e["component"], e["value"])


def sparse_columns(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, components and values of a list (dense) or map (sparse)
    column; null vectors and null values count as empty and zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    is_map = pa.types.is_map(vectors.type)
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    items = vectors.items if is_map else vectors.values
    value = items.to_numpy(zero_copy_only=False).astype(float)[offsets[0]:offsets[-1]]
    if is_map:
        column = vectors.keys.to_numpy(zero_copy_only=False).astype(np.int64)[offsets[0]:offsets[-1]]
    else:
        column = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    offsets = offsets - offsets[0]
    full = (value != 0) & ~np.isnan(value)
    kept = np.append(0, np.cumsum(full))
    return kept[offsets], column[full], value[full]


def add_nearest(queries: DataFrame, vec: str, index: SpaceIndex, last: bool = False) -> DataFrame:
    """``queries`` with ``nearest``, ``nearest_order`` and ``sim``."""
    at = queries.columns.index(vec)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, sim = index.best(*sparse_columns(b.column(at)), last)
            none = row < 0
            name = pa.array([None if x < 0 else index.names[x] for x in row.tolist()], pa.string())
            order = pa.array(index.orders[row] if len(index.orders) else np.zeros(len(row), np.int64), pa.int64(), mask=none)
            yield pa.RecordBatch.from_arrays([*b.columns, name, order, pa.array(sim, pa.float64(), mask=none)],
                                             [*b.schema.names, "nearest", "nearest_order", "sim"])

    added = [T.StructField("nearest", T.StringType()), T.StructField("nearest_order", T.LongType()), T.StructField("sim", T.DoubleType())]
    return queries.mapInArrow(search, T.StructType(queries.schema.fields + added))


def add_scores(queries: DataFrame, vec: str, index: SpaceIndex) -> DataFrame:
    """``queries`` with ``scores``, one number for each row of the space."""
    at = queries.columns.index(vec)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, CELLS // max(len(index.names), 1))
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                s = index.scores(*sparse_columns(b.column(at)))
                cuts = np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(s.ravel()))],
                                                 [*b.schema.names, "scores"])

    return queries.mapInArrow(score, T.StructType(queries.schema.fields + [T.StructField("scores", T.ArrayType(T.DoubleType()))]))
