"""Exact removal of repeated byte strings with a run-length index.

A byte goes if it lies in a string of ``length`` bytes that also starts
earlier in the corpus.  The corpus is not indexed as one text: every string
of that length has an anchor, the ``GRAM`` bytes in it with the least hash
(the last of equals), which depends on the string alone.  Neighbouring
strings with one anchor are a segment, and two equal strings lie in segments
with equal anchor hashes.  So only segments whose anchor occurs twice can
hold a repeat, and each anchor's segments can be judged apart.

Segments with equal bytes are one class, and all but its earliest are
repeats.  Classes that share an anchor but differ (the ends of a copied
passage, near copies) go into a run-length index: the Burrows-Wheeler
transform of their texts is kept as runs, with the suffix array sampled at
the first place of every run.  Between two samples, in text order, the
preceding suffix (phi) moves on by one and its match gets one shorter, so
the samples give, as one stream over the text, the matching statistics of
every position against all others.  Following phi as long as the match has
the full length leads all occurrences of a string to the same end, and all
but the earliest of them are marked.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.index import dense_index
from tessera.llm.base import id_text
from tessera.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 100
GRAM = 32
PIECE = 1 << 19  # bytes whose anchors are found together; places fit 20 bits
INDEX_BYTES = 1 << 20
#: Bits of a segment's number of starts and kind beside its place in one number.
SPAN_BITS = 16
#: An anchor with more classes than this is judged string by string, the
#: starts of a string dealt over this many salts.
CROWDED = 20_000
SALTS = 256

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = (1 << 20) - 1


class Hashes:
    """64-bit hashes of any stretch of a piece from running sums."""

    def __init__(self, size: int):
        with np.errstate(over="ignore"):
            self.ahead = np.cumprod(np.concatenate([[U(1)], np.full(size, _BASE, U)]), dtype=U)
            self.back = np.cumprod(np.concatenate([[U(1)], np.full(size, pow(_BASE, -1, 1 << 64), U)]), dtype=U)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(self.ahead[:len(data)] * (data + U(1)), out=out[1:])
        return out

    def of(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (sums[end] - sums[first]) * self.back[first]
            x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    n, done = len(x) - width + 1, 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done:width - done + n]) if done < width else x[:n]


def segments(hashes: Hashes, data: np.ndarray, owner_end: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of a piece: first start, number of starts, anchor hash and
    class hash.  ``owner_end``: (first byte, end) of each text in it."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U))
    sums = hashes.sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.of(sums, at, at + gram)
    packed = (grams & ~U(_PLACE)) | (U(_PLACE) - at.astype(U))  # of equal hashes the last one
    anchor = _PLACE - (_sliding_min(packed, length - gram + 1) & U(_PLACE)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int32)  # starts whose string stays in its text
    first, last = owner_end[:, 0], owner_end[:, 1] - length + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    inside = np.cumsum(inside[:-1]) > 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U))
    stop = np.flatnonzero(np.append(inside[:-1] & (~inside[1:] | (anchor[1:] != anchor[:-1])), inside[-1]))
    n = stop - begin + 1
    return begin, n, grams[anchor[begin]], hashes.of(sums, begin, begin + n + length - 1) ^ n.astype(U)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, place in it, bytes) in lists of at most ``PIECE``
    bytes; longer texts are cut so that no start is lost."""
    some, size = [], 0
    for k, t in enumerate(texts):
        step = PIECE - length
        for at in range(0, max(len(t) - length + 1, 0), step):
            part = t[at:at + step + length - 1]
            if size + len(part) > PIECE:
                yield some
                some, size = [], 0
            some.append((k, at, part))
            size += len(part)
    if some:
        yield some


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of small integers by doubling the sorted length, from
    as many symbols as fit one number."""
    n = len(text)
    bits = (int(text.max()) + 1).bit_length()
    step = max(62 // bits, 1)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        if k < n:
            key[:n - k] += text[k:] + 1
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=fresh[1:])
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        key = rank * (n + 1)
        if step < n:
            key[:n - step] += rank[step:] + 1
        step *= 2


class RunIndex:
    """Run-compressed transform of a text with sampled run starts."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        last = text[order - 1]  # the transform; of suffix 0 it is the final sentinel
        starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.heads, self.run_starts, self.size = last[starts], starts, len(text)
        # samples: at the first suffix of each run, the suffix before it and their common length
        here = order[starts]
        before = np.where(starts > 0, order[starts - 1], -1)
        by_place = np.argsort(here, kind="stable")
        self.sample, self.phi = here[by_place], before[by_place]
        self.common = self._common(text, self.sample, self.phi)

    @staticmethod
    def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        k = 0
        while len(live):
            x, y = a[live] + k, b[live] + k
            ok = (x < len(text)) & (y < len(text))
            live, x, y = live[ok], x[ok], y[ok]
            live = live[text[x] == text[y]]
            k += 1
            out[live] = k
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place, in text order: where the preceding suffix starts
        and how long the two agree; from the last sample before the place."""
        place = np.arange(self.size)
        k = np.searchsorted(self.sample, place, "right") - 1
        moved = place - self.sample[k]
        length = np.maximum(self.common[k] - moved, 0)
        return np.where(self.phi[k] >= 0, self.phi[k] + moved, place), length


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For texts in corpus order: the starts whose string of ``length``
    bytes also starts earlier, in an earlier text or the same one."""
    sizes = np.array([len(p) for p in parts], np.int64)
    m = len(parts)
    text = np.empty(int(sizes.sum()) + m, np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    text[:] = 0
    joined = np.frombuffer(b"".join(parts), np.uint8)
    is_end = np.zeros(len(text), bool)
    is_end[bounds[1:] - 1] = True
    text[~is_end] = joined.astype(np.int64) + m
    text[is_end] = np.arange(m)  # every text ends in a sentinel of its own
    phi, common = RunIndex(text).matching_statistics()
    place = np.arange(len(text))
    leads = np.where(common >= length, phi, place)
    while True:  # to the end of the chain
        further = leads[leads]
        if (further == leads).all():
            break
        leads = further
    first = np.full(len(text), len(text))
    np.minimum.at(first, leads, place)
    again = np.flatnonzero(first[leads] < place)
    cuts = np.searchsorted(again, bounds)
    return [again[cuts[k]:cuts[k + 1]] - bounds[k] for k in range(m)]


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (rid, doc_id, text), and one of each rid: rid orders the
    documents by doc_id, then by a key of the text, nulls last; rows with
    equal doc_id and text share it."""
    rows = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        rows = rows.select(F.col("doc_id").alias("rid"), "doc_id", "text")
        return rows, rows
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    order = (keyed.select(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).distinct())
    ids = dense_index(order, ["no_id", "k_id", "k_text"], out="rid")
    rows = keyed.join(ids, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_text"))).select(
        "rid", "doc_id", "text")
    return rows, rows.dropDuplicates(["rid"])


def _find_segments(rows: DataFrame, length: int) -> DataFrame:
    """All segments (kind 0); equal ones of one batch are already reduced to
    the earliest, the others come as repeats (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(PIECE + length)
        for b in batches:
            rids = b.column(0).to_numpy()
            texts = [t.as_py().encode() for t in b.column(1)]
            found = []
            for some in _pieces(texts, length):
                sizes = np.array([len(p[2]) for p in some], np.int64)
                ends = np.cumsum(sizes)
                data = np.frombuffer(b"".join(p[2] for p in some), np.uint8)
                begin, n, anchor, cls = segments(hashes, data, np.stack([ends - sizes, ends], 1), length)
                own = np.searchsorted(ends, begin, "right")
                text_of = np.array([p[0] for p in some], np.int64)[own]
                place = np.array([p[1] for p in some], np.int64)[own] + begin - (ends - sizes)[own]
                found.append((anchor.view(np.int64), cls.view(np.int64), rids[text_of], place, n))
            if not found:
                continue
            cols = [np.concatenate(c) for c in zip(*found)]
            order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            copy = np.zeros(len(order), bool)
            copy[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            span = cols[3] << SPAN_BITS | cols[4] << 1 | copy  # one number, as these rows are what is shuffled most
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols[:3], span)], ["anchor", "cls", "rid", "span"])

    return rows.select("rid", "text").mapInArrow(run, "anchor bigint, cls bigint, rid bigint, span bigint")


def _judge_classes(found: DataFrame) -> DataFrame:
    """Repeats (kind 1) and classes whose anchor has others (kind 2); the
    rest is dropped.  Reads sorted rows once and keeps one row at a time."""
    key = F.when(F.col("span").bitwiseAND(F.lit(1)) == 0, F.col("anchor")).otherwise(F.xxhash64("rid", "span"))
    dealt = found.repartition(key).sortWithinPartitions("anchor", "cls", "rid", "span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, before = None, None  # the first class of the last anchor; the last row's anchor and class

        def out(rows, kind):
            return pa.RecordBatch.from_arrays([pa.array(rows[k]) for k in (0, 2, 3, 4)] + [
                pa.array(np.full(len(rows[0]), kind, np.int64))], ["anchor", "rid", "place", "n", "kind"])

        for b in batches:
            anchor, cls, rid, span = (c.to_numpy() for c in b.columns)
            cols = [anchor, cls, rid, span >> SPAN_BITS, (span & ((1 << SPAN_BITS) - 1)) >> 1]
            done = (span & 1) == 1
            if done.any():
                yield out([c[done] for c in cols], 1)
            cols = [c[~done] for c in cols]
            size = len(cols[0])
            if not size:
                continue
            anchor, cls = cols[0], cols[1]
            new_anchor = np.ones(size, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_cls = new_anchor.copy()
            new_cls[1:] |= cls[1:] != cls[:-1]
            if before is not None:
                new_anchor[0] = anchor[0] != before[0]
                new_cls[0] = new_anchor[0] or cls[0] != before[1]
            before = (anchor[-1], cls[-1])
            yield out([c[~new_cls] for c in cols], 1)
            at = np.flatnonzero(new_cls)
            if not len(at):
                continue
            if waiting is not None and not new_anchor[at[0]]:
                yield out(waiting, 2)
            head = new_anchor[at]
            shared = ~head
            shared[:-1] |= ~head[1:]
            some = at[shared]
            yield out([c[some] for c in cols], 2)
            waiting = [c[at[-1:]] for c in cols] if head[-1] else None

    return dealt.mapInArrow(run, "anchor bigint, rid bigint, place bigint, n bigint, kind bigint")


def _texts_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, rid, place, part): the bytes of the wanted segments."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "place", "n")).alias("w"))  # one text's own segments
    joined = rows.join(lists, "rid").select("rid", "text", F.col("w.anchor").alias("a"), F.col("w.place").alias("p"), F.col("w.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols = [[], [], [], []]
                for rid, text, a, p, n in zip(*[part.column(k).to_pylist() for k in range(5)]):
                    data = text.encode()
                    cols[0] += a
                    cols[1] += [rid] * len(a)
                    cols[2] += p
                    cols[3] += [data[x:x + k + length - 1] for x, k in zip(p, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                 ["anchor", "rid", "place", "part"])

    return joined.mapInArrow(run, "anchor bigint, rid bigint, place bigint, part binary")


def _judge_strings(parts: DataFrame, length: int) -> DataFrame:
    """(rid, first, end): repeats among the single strings of segments of
    crowded anchors.  Equal strings are dealt by their bytes and a salt; all
    but the earliest of a salt are repeats, and the earliest of every salt,
    at most ``SALTS`` for a string, are judged again without it.  The others
    keep their salt there, so that no task gets all starts of a string."""
    single = (parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.length("part") - length)))
              .select(F.xxhash64("anchor", F.expr(f"substring(part, k + 1, {length})")).alias("string"), "rid",
                      (F.col("place") + F.col("k")).alias("first"))
              .withColumn("salt", F.pmod(F.xxhash64("rid", "first"), F.lit(SALTS))))
    rank = F.row_number().over(Window.partitionBy("string", "salt").orderBy("rid", "first"))
    once = single.withColumn("again", rank > 1).withColumn("salt", F.when(F.col("again"), F.col("salt")).otherwise(F.lit(-1)))
    return (once.withColumn("again", F.col("again") | (rank > 1)).filter("again")
            .select("rid", "first", (F.col("first") + length).alias("end")))


def _index(parts: DataFrame, length: int) -> DataFrame:
    """(rid, first, end) of repeated stretches among segments that share an
    anchor; blocks of whole anchors are indexed together."""
    dealt = parts.repartition("anchor").sortWithinPartitions("anchor", "rid", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def judged(t: pa.Table) -> pa.RecordBatch:
            rid, place = t.column("rid").to_numpy(), t.column("place").to_numpy()
            order = np.lexsort((place, rid))
            texts = t.column("part").to_pylist()
            rid, place = rid[order], place[order]
            again = repeated_starts([texts[k] for k in order], length)
            out = [[], [], []]
            for r, p, starts in zip(rid.tolist(), place.tolist(), again):
                if len(starts):
                    gap = np.flatnonzero(np.diff(starts) > 1)
                    first = starts[np.concatenate([[0], gap + 1])] + p
                    last = starts[np.concatenate([gap, [len(starts) - 1]])] + p
                    out[0] += [r] * len(first)
                    out[1] += first.tolist()
                    out[2] += (last + length).tolist()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rid", "first", "end"])

        for b in batches:
            at = 0
            while at < b.num_rows:  # cut so that a block is little over its size
                sizes = np.cumsum(np.diff(np.frombuffer(b.column(3).buffers()[1], np.int32, b.num_rows + 1 + b.column(3).offset)[b.column(3).offset + at:]))
                take = min(int(np.searchsorted(sizes, INDEX_BYTES - size)) + 1, b.num_rows - at)
                held.append(b.slice(at, take))
                size += int(sizes[take - 1])
                at += take
                if size >= INDEX_BYTES:
                    t = pa.Table.from_batches(held)
                    anchors = t.column("anchor").to_numpy()
                    cut = int(np.argmax(anchors == anchors[-1]))
                    if cut:
                        yield judged(t.slice(0, cut))
                        held = t.slice(cut).to_batches()
                        size = sum(x.nbytes for x in held)
        if held:
            yield judged(pa.Table.from_batches(held))

    return dealt.select("anchor", "rid", "place", "part").mapInArrow(run, "rid bigint, first bigint, end bigint")


def repeated_stretches(rows: DataFrame, length: int = LENGTH, crowded_at: int = CROWDED) -> DataFrame:
    """(rid, first, end): byte stretches to remove, which may overlap."""
    judged = _judge_classes(_find_segments(rows, length)).checkpoint()
    copies = judged.filter("kind = 1").select("rid", F.col("place").alias("first"),
                                              (F.col("place") + F.col("n") + (length - 1)).alias("end"))
    shared = judged.filter("kind = 2")
    crowded = shared.groupBy("anchor").count().filter(F.col("count") > crowded_at).select("anchor")
    if not crowded.isEmpty():  # at most one anchor for every crowded_at segments, so it can be broadcast
        strings = _texts_of(rows, shared.join(F.broadcast(crowded), "anchor", "left_semi"), length)
        copies = copies.union(_judge_strings(strings, length))
        shared = shared.join(F.broadcast(crowded), "anchor", "left_anti")
    return copies.union(_index(_texts_of(rows, shared, length), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True, crowded_at: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``with_text``, kept (binary): one row per input row.

    A byte is removed if a string of ``length`` bytes over it also starts
    earlier: in a document with a smaller doc_id (null: last; equal ids: by
    a hash of the text), or earlier in the same one; matches may overlap,
    never cross documents, and are judged on the input.  Rows with equal
    doc_id and text are one document and get equal results.  Null and
    shorter texts keep all they have; other columns are ignored."""
    if not GRAM <= length < 1 << (SPAN_BITS - 1):
        raise ValueError(f"length must be from {GRAM} to {(1 << (SPAN_BITS - 1)) - 1}")
    checkpoint_dir(docs.sparkSession)
    rows, single = _rows(docs)
    spans = repeated_stretches(single, length, crowded_at).groupBy("rid").agg(
        F.collect_list(F.struct("first", "end")).alias("spans"))  # one text's own stretches
    joined = rows.join(spans, "rid", "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.end").alias("end"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, first, end in zip(*[b.column(k).to_pylist() for k in range(4)]):
                data = text.encode()
                kept, removed, spans, at = [], 0, 0, 0
                if first:
                    gone = sorted(zip(first, end))
                    cur_a, cur_b = gone[0]
                    merged = []
                    for x, y in gone[1:]:
                        if x <= cur_b:
                            cur_b = max(cur_b, y)
                        else:
                            merged.append((cur_a, cur_b))
                            cur_a, cur_b = x, y
                    merged.append((cur_a, cur_b))
                    for x, y in merged:
                        kept.append(data[at:x])
                        removed += y - x
                        at = y
                    spans = len(merged)
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((doc_id, len(data), removed, spans, hashlib.sha256(left).hexdigest(), left)[:len(names)])
            cols = list(zip(*out)) if out else [[]] * len(names)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.mapInArrow(run, schema + (", kept binary" if with_text else ""))
