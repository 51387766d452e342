"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the leaves of a binary trie, one level for each bit.  The
self-join walks pairs of nodes downwards together: children on the same side
keep the number of differing bits, children on different sides add one, and
a pair whose number exceeds the budget is dropped with all that lies below.

To deal the walk out, the trie is built ``budget + 1`` times with the bits
rotated, so that each of as many blocks of bits leads once.  Two fingerprints
within the budget agree in at least one block, so in that trie they are below
the same node at the block's depth, and only pairs (node, itself) at that
depth need to be walked.  A node with very many fingerprints is cut further
down into pairs of its descendants, again by differing bits, and each such
pair is a unit of work of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import free_worker, id_text, join_facts, text_key
from tessera.llm.components import stars
from tessera.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
#: A trie node with more fingerprints than this is dealt out as pairs of descendants.
NODE_ROWS = 200_000
MAX_EXTRA_DEPTH = 12
FRONTIER = 500_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash: XXH64 of each word shingle of the text with
    A-Z lower-cased; a bit is set if it is in over half of the shingles.
    Fewer words than a shingle: their whole sequence; no word: 0."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space cuts
    if not parts:
        return 0
    line = b" ".join(parts)
    n = len(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(line, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:n - words] + 1])
    cuts = map(slice, starts.tolist(), ends[words - 1:].tolist())
    hashes = map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(HASH_SEED))
    total = n - words + 1
    counts = np.zeros(64, np.int64)
    left = total
    while left:  # bits are counted in blocks, so a long text needs no large matrix
        block = np.fromiter(hashes, np.uint64, min(left, 1 << 16))
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        left -= len(block)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key of the text, fp) for every row; fp is the fingerprint as
    a signed bigint.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_key", "fp"])

    rows = id_text(docs).select("doc_id", text_key()[1].alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


class Trie:
    """Sorted fingerprints seen as a binary trie; a node is a range of them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self._ones: dict[int, np.ndarray] = {}

    def split(self, level: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the second child of each node [low, high) begins."""
        if level not in self._ones:
            bit = (self.keys >> np.uint64(63 - level)) & np.uint64(1)
            self._ones[level] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        ones = self._ones[level]
        return high - (ones[high] - ones[low])

    def pairs(self, level: int, nodes: tuple, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves (i, j) within the budget below the node pairs ``nodes``
        (low and high of both nodes, differing bits so far)."""
        todo = [(level, nodes)]
        while todo:
            level, nodes = todo.pop()
            if len(nodes[0]) > FRONTIER:
                half = len(nodes[0]) // 2
                todo += [(level, tuple(x[half:] for x in nodes)), (level, tuple(x[:half] for x in nodes))]
                continue
            al, ah, bl, bh, diff = nodes
            own = al == bl
            single = (ah - al == 1) & (bh - bl == 1)
            leaf = single & ~own
            if leaf.any():  # no more branches: compare what is left of the two paths
                i, j = al[leaf], bl[leaf]
                near = np.bitwise_count(self.keys[i] ^ self.keys[j]) <= budget
                yield i[near], j[near]
            go = ~single
            if level > 63 or not go.any():
                continue
            al, ah, bl, bh, diff, own = (x[go] for x in (al, ah, bl, bh, diff, own))
            am, bm = self.split(level, al, ah), self.split(level, bl, bh)
            cross = ~own  # (right, left) of a node with itself is (left, right) again
            children = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1),
                        tuple(x[cross] for x in (am, ah, bl, bm, diff + 1))]
            merged = tuple(np.concatenate(c) for c in zip(*children))
            live = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= budget)
            live &= ~((merged[0] == merged[2]) & (merged[1] - merged[0] == 1))
            if live.any():
                todo.append((level + 1, tuple(x[live] for x in merged)))


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[k] and b[k]; the least member is the root."""
    while len(a):
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _forest(units: np.ndarray, depth: np.ndarray, keys: np.ndarray, fps: np.ndarray, budget: int):
    """Links below the units of work in sorted rows, as edges (fingerprint,
    least linked fingerprint of its set): the sets are those of all links."""
    trie = Trie(keys)
    bounds = np.flatnonzero(np.concatenate([[True], (units[1:] != units[:-1]).any(1)]))
    ends = np.append(bounds[1:], len(keys))
    parent = np.arange(len(keys))
    wide = ends - bounds > 1
    for d in np.unique(depth[bounds[wide]]):
        some = wide & (depth[bounds] == d)
        lo, hi = bounds[some], ends[some]
        left, right = units[lo, 2], units[lo, 3]
        # rows of the left node come first; a unit of one node is paired with itself
        own = left == right
        head = keys >> np.uint64(64 - d)
        first = np.array([lo[k] + np.count_nonzero(head[lo[k]:hi[k]] == head[lo[k]]) if not own[k] else hi[k]
                          for k in range(len(lo))], np.int64) if not own.all() else hi
        nodes = (lo, first, np.where(own, lo, first), hi, np.bitwise_count(left ^ right).astype(np.int64))
        full = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3])
        for i, j in trie.pairs(int(d), tuple(x[full] for x in nodes), budget):
            _unite(parent, i, j)
    child = np.flatnonzero(parent != np.arange(len(keys)))
    return fps[child], fps[parent[child]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``), whose
    connected components are those of all pairs within ``max_bits``."""
    widths = [64 // (max_bits + 1) + (k < 64 % (max_bits + 1)) for k in range(max_bits + 1)]
    tries, start = [], 0
    for k, width in enumerate(widths):
        fp = F.col("fp")
        turned = F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, 64 - start)) if start else fp
        tries.append(F.struct(F.lit(k).cast("bigint").alias("trie"), F.lit(width).alias("depth"),
                              F.shiftrightunsigned(turned, 64 - width).alias("node"), turned.alias("key"), fp.alias("fp")))
        start += width
    rows = distinct.select(F.explode(F.array(*tries)).alias("r")).select("r.*")
    alone = rows.withColumns({"a": F.lit(0).cast("bigint"), "b": F.lit(0).cast("bigint")})
    crowded = rows.groupBy("trie", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node_rows)
    if not crowded.isEmpty():
        extra = F.least(F.ceil(F.log2(F.col("n") / node_rows)) + 2, F.lit(MAX_EXTRA_DEPTH)).cast("int")
        masks = [m for m in range(1 << MAX_EXTRA_DEPTH) if m.bit_count() <= max_bits]
        below = F.expr("shiftrightunsigned(shiftleft(key, depth), 64 - extra)")
        dealt = (rows.join(crowded.withColumn("extra", extra), ["trie", "node"], "left")
                 .withColumn("own", F.when(F.col("extra").isNull(), F.lit(0).cast("bigint")).otherwise(below))
                 .withColumn("other", F.explode(F.when(F.col("extra").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
                     F.transform(F.filter(F.array(*[F.lit(m).cast("bigint") for m in masks]),
                                          lambda m: m < F.pow(F.lit(2), F.col("extra"))),
                                 lambda m: m.bitwiseXOR(F.col("own")))))))
        alone = dealt.select("trie", (F.col("depth") + F.coalesce("extra", F.lit(0))).alias("depth"), "node", "key", "fp",
                             F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    unit = ["trie", "node", "a", "b"]
    dealt_out = alone.repartition(*unit).sortWithinPartitions(*unit, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(batch_list, upto=None):
            t = pa.Table.from_batches(batch_list)
            units = np.stack([t.column(c).to_numpy() for c in unit], 1)
            n = len(units) if upto is None else upto
            depth, keys, fps = (t.column(c).to_numpy()[:n] for c in ("depth", "key", "fp"))
            u, v = _forest(units[:n], depth, keys.view(np.uint64), fps, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < 100_000:
                continue
            t = pa.Table.from_batches(held)  # all units but the last are complete
            ids = np.stack([t.column(c).to_numpy() for c in unit], 1)
            same = (ids == ids[-1]).all(1)
            cut = int(np.argmax(same))
            if cut:
                yield found(held, cut)
                held = t.slice(cut).combine_chunks().to_batches()
                size = sum(x.num_rows for x in held)
        if held:
            yield found(held)

    return dealt_out.select(*unit, "depth", "key", "fp").mapInArrow(run, "u bigint, v bigint")


def groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
           node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, text_key, fp, fingerprint, group (least fingerprint of the
    component), component_id for every row of ``docs``."""
    checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, words).checkpoint()  # the texts are read once
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    linked = stars(links(classes, max_bits, node_rows))
    members = linked.select(F.col("u").alias("fp"), F.col("v").alias("group")).union(
        linked.select(F.col("v").alias("fp"), F.col("v").alias("group")).distinct())
    least = members.join(classes, "fp").groupBy("group").agg(F.min("first_id").alias("least_id"))
    named = members.join(least, "group")
    labels = classes.join(named, "fp", "left").select(
        "fp", "copies", F.coalesce("group", "fp").alias("group"),
        F.when(F.col("group").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id")).checkpoint()
    return join_facts(rows, labels, "fp", "copies", rows.count()).select(
        "doc_id", "text_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "group", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row.

    Null and empty texts and texts of blanks have fingerprint 0 and are
    linked like any other.  component_id is the least doc_id that can be
    reached, itself included; null doc_ids count only if the component has
    no other.  Repeated rows get a row each; other columns are ignored."""
    return groups(docs, words, max_bits).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id
    (nulls last), then of the least text key; of equal rows any one."""
    rows = groups(docs, words, max_bits).select("group", "doc_id", "text_key").checkpoint()
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    best = rows.groupBy("group").agg(F.min(order).alias("best")).select(
        F.col("best.doc_id").alias("_key_id"), F.col("best.text_key").alias("_key_text"))
    id_, text = text_key()
    cols = docs.columns
    tagged = docs.select("*", id_.alias("__tessera_id"), text.alias("__tessera_text"))
    kept = tagged.join(best, F.col("__tessera_id").eqNullSafe(F.col("_key_id"))
                       & (F.col("__tessera_text") == F.col("_key_text")), "left_semi")
    if not rows.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__tessera_id", "__tessera_text"])
    return kept.select(*[F.col(f"`{c}`") for c in cols])
