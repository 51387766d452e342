"""Benchmark decontamination by edit distance.

The CGK embedding walks through a sequence in ``steps`` steps: step j
outputs the symbol the walk is at, and a random bit drawn for (j, symbol)
says whether it moves on.  Two sequences with few edits are walked with the
same bits, so after an edit the walks soon meet again and most outputs
agree: edit distance has become Hamming distance.  Sampling a few steps
makes a hash, and repeating that with other samples and other walks makes
sequences with few edits meet at least once.

Symbols are bytes.  Every byte of a text begins a window, and every byte of
an item begins one too, as far as its walk ends inside the item, so one
stretch that is left whole between two edits is enough to meet, wherever in
the item it is.  All windows of a text are embedded together, last step
first: the hash of the walk that stands at byte i before step j is that of
step j + 1 at byte i or i + 1, xor-ed with the symbol if j is sampled.
Where a window meets an item, the ``SLICE`` bytes of the item around it are
first compared with the text in one machine word; then the item is placed
over its full length and the exact edit distance to the best stretch of
text decides.

Exact copies do not rest on the walks: the first bytes of every item are
looked up at every byte of the text, so they are found whatever the length
and the script of the item.  An item that is a lone word of ASCII letters or
digits is compared with whole words of the text, so neither it nor an edited
copy counts as part of a longer word.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tessera.llm.base import free_worker, id_text, keep_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_EDITS = 0.2  # of the item's length: similarity 0.8 or more
BLOCK_ITEMS = 4096
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20
SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, distance bigint, similarity double"
#: An item uses the first of these that it has the bytes for:
#: (least bytes, steps of the walk, sampled steps, walks of 2 hashes each).
EMBEDDINGS = ((48, 24, 20, 1), (16, 10, 8, 2), (5, 4, 3, 2))
#: Bytes of an item that are compared first, and the share of them that may
#: differ there (edits can lie closer together than in the whole item).
SLICE = 64
SLICE_EDITS = 0.375
#: Exact copies are found by the first bytes of an item: the largest power of
#: two it has, up to this.
EXACT_BYTES = 64

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_RUN = re.compile("[0-9a-z]+")
_SPACED = _WORD & (np.arange(256) < 128)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, U)
        out[0] = 1
        return np.cumprod(out, dtype=U)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ U(salt)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(31))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(29))


_SYMBOLS = _mix(np.arange(1, 257, dtype=U), 0x5EED)


class Words:
    """Words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased)
    of a byte string: first byte, end and 64-bit hash of each."""

    def __init__(self, size: int):
        self.ahead = _powers(_BASE, size + 1)
        self.back = _powers(pow(_BASE, -1, 1 << 64), size + 1)

    def stretches(self, text: bytes, size: int) -> np.ndarray:
        """64-bit hash of the ``size`` bytes at every place that has them."""
        data = np.frombuffer(text, np.uint8)
        if len(data) >= len(self.ahead):
            self.__init__(len(data))
        out = np.empty(max(len(data) - size + 1, 0), U)
        block = 1 << 14
        for at in range(0, len(out), block):
            part = data[at:at + block + size - 1]
            with np.errstate(over="ignore"):
                sums = np.zeros(len(part) + 1, U)
                np.cumsum(self.ahead[:len(part)] * (part + U(1)), out=sums[1:])
                n = len(part) - size + 1
                out[at:at + n] = (sums[size:] - sums[:n]) * self.back[:n]
        return out

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(text, np.uint8)
        if len(data) >= len(self.ahead):
            self.__init__(len(data))
        edge = np.flatnonzero(np.diff(_WORD[data].view(np.int8), prepend=0, append=0))
        first, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, U)
            np.cumsum(self.ahead[:len(data)] * (data + U(1)), out=sums[1:])
            hashes = (sums[end] - sums[first]) * self.back[first]
        return first, end, _mix(hashes)


@dataclass
class Embedding:
    """Random bits of one embedding: the walks and the sampled steps."""

    steps: int
    samples: np.ndarray  # (hashes, steps) bool
    factors: np.ndarray  # (hashes, steps) odd multipliers of the symbols
    salts: list[int]  # one for each walk

    @classmethod
    def drawn(cls, steps: int, sampled: int, walks: int, seed: int = 11) -> Embedding:
        rng = np.random.default_rng(seed)
        hashes = walks * 2
        samples = np.zeros((hashes, steps), bool)
        for row in samples:
            row[rng.permutation(steps)[:sampled]] = True
        return cls(steps, samples, rng.integers(0, 1 << 63, (hashes, steps), dtype=U) * U(2) + U(1),
                   [int(x) for x in rng.integers(1, 1 << 62, walks)])

    def moves(self, walk: int) -> np.ndarray:
        """(steps, 256): 1 where the walk moves on after that byte."""
        bits = _mix(_SYMBOLS, self.salts[walk])
        return (bits >> np.arange(self.steps, dtype=U)[:, None]) & U(1)

    def keys(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """32-bit keys of the window at every byte, one array for each hash;
        a walk past the last byte reads zeros."""
        block = 1 << 14
        for w in range(len(self.salts)):
            masks = U(0) - self.moves(w)
            high, low = 2 * w, 2 * w + 1  # two 32-bit hashes in one 64-bit number
            with np.errstate(over="ignore"):
                parts = [(_SYMBOLS * self.factors[high, j] & U(0xFFFFFFFF00000000 * int(self.samples[high, j])))
                         ^ ((_SYMBOLS * self.factors[low, j] >> U(32)) * U(int(self.samples[low, j]))) for j in range(self.steps)]
            out = np.empty((2, len(data)), np.uint32)
            for at in range(0, len(data), block):
                part = data[at:at + block + self.steps]
                x = np.zeros(len(part) + self.steps, np.intp)
                x[:len(part)] = part
                n = min(block, len(data) - at)
                g, now = np.zeros(len(x) + 1, U), np.zeros(len(x) + 1, U)
                some = np.empty(len(x), U)
                for j in range(self.steps - 1, -1, -1):
                    np.bitwise_xor(g[1:], g[:-1], out=now[:-1])
                    np.take(masks[j], x, out=some, mode="clip")
                    now[:-1] &= some
                    now[:-1] ^= g[:-1]
                    np.take(parts[j], x, out=some, mode="clip")
                    now[:-1] ^= some
                    g, now = now, g
                out[0, at:at + n] = g[:n] >> U(32)
                out[1, at:at + n] = g[:n] & U(0xFFFFFFFF)
            yield from out

    def reach(self, data: np.ndarray) -> np.ndarray:
        """(hashes, windows): how many bytes the walk reads up to its last
        sampled step."""
        n, out = len(data), np.zeros((len(self.samples), len(data)), np.int64)
        padded = np.append(data, np.zeros(self.steps + 1, np.uint8))
        for w in range(len(self.salts)):
            moves = self.moves(w).astype(np.int64)
            at = np.arange(n)
            for j in range(self.steps):
                for h in (2 * w, 2 * w + 1):
                    if self.samples[h, j]:
                        out[h] = at - np.arange(n) + 1
                at = at + moves[j][padded[at]]
        return out


def best_stretch(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of ``text`` with the least edit
    distance to ``item``, at most ``most``; the first to end, then the
    shortest.  Bit-parallel columns of the edit matrix."""
    found = _least_end(item, text)
    if found[0] > most:
        return None
    distance, end = found
    head = text[:end][::-1]
    _, size = _least_end(item[::-1], head[:len(item) + distance], anchored=True)
    return distance, end - size, end


def best_word(item: str, text: str, most: int, open_start: bool, open_end: bool) -> tuple[int, int, int] | None:
    """``best_stretch`` for an item with one word: of the stretches that are
    a whole word of ``text`` with as many characters before and after it as
    the item has around its own.  An open side of ``text`` goes on with a
    word character, so a word that touches it is not whole."""
    own, best = _RUN.search(item), None
    for run in _RUN.finditer(text):
        start, end = run.start() - own.start(), run.end() + len(item) - own.end()
        if start < 0 or end > len(text) or abs(end - start - len(item)) > most or \
                (open_start and run.start() == 0) or (open_end and run.end() == len(text)):
            continue
        row = list(range(len(item) + 1))
        for k, c in enumerate(text[start:end], 1):
            last, row[0] = row[0], k
            for m, d in enumerate(item, 1):
                last, row[m] = row[m], min(row[m] + 1, row[m - 1] + 1, last + (c != d))
        hit = (row[-1], start, end)
        if hit[0] <= most and (best is None or hit < best):
            best = hit
    return best


def _least_end(item: str, text: str, anchored: bool = False) -> tuple[int, int]:
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    place: dict[str, int] = {}
    for k, c in enumerate(item):
        place[c] = place.get(c, 0) | (1 << k)
    up, down, score, best = full, 0, m, (m, 0)
    first = 1 if anchored else 0
    for k, c in enumerate(text, 1):
        eq = place.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | first) & full
        minus = (minus << 1) & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if score < best[0]:
            best = (score, k)
    return best


class Items:
    """One block of benchmark items with the keys of all their windows."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.texts = [r[1].encode().lower().decode() for r in rows]
        self.n_words = np.zeros(len(rows), np.int64)
        self.n_bytes = np.zeros(len(rows), np.int64)
        split, parsed = Words(1 << 12), []
        for k, t in enumerate(self.texts):
            parsed.append(split(t.encode()))
            self.n_words[k] = len(parsed[-1][0])
            self.n_bytes[k] = len(t.encode())
        self.exact = []
        for size in (1 << k for k in range(EXACT_BYTES.bit_length())):
            own = [k for k in np.flatnonzero(self.n_words).tolist()
                   if size <= self.n_bytes[k] and (self.n_bytes[k] < 2 * size or size == EXACT_BYTES)]
            if own:
                keys = np.array([split.stretches(self.texts[k].encode()[:size], size)[0] for k in own], U)
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << 20, bool)
                seen[keys >> U(44)] = True
                self.exact.append((size, keys[order], np.array(own)[order], seen))
        # the items' bytes as one; a window is the place where it begins
        self.begins = np.cumsum(self.n_bytes) - self.n_bytes
        data = np.frombuffer("".join(self.texts).encode(), np.uint8)
        owner = np.repeat(np.arange(len(rows)), self.n_bytes)
        self.lone = np.array([w == 1 and t.isascii() for w, t in zip(self.n_words, self.texts)], bool)
        self.tables = []
        for c, (least, steps, sampled, walks) in enumerate(EMBEDDINGS):
            above = EMBEDDINGS[c - 1][0] if c else 1 << 60
            own = (least <= self.n_bytes) & (self.n_bytes < above) & (self.n_words > 0)
            if not own.any():
                continue
            emb = Embedding.drawn(steps, sampled, walks)
            inside = np.arange(len(data)) + emb.reach(data) <= (self.begins + self.n_bytes)[owner]
            lanes = []
            for h, keys in enumerate(emb.keys(data)):
                some = np.flatnonzero(inside[h] & own[owner]).astype(np.int32)
                some = some[np.argsort(keys[some], kind="stable")]
                seen = np.zeros(1 << 20, bool)
                seen[keys[some] >> 12] = True
                lanes.append((keys[some], some, seen))
            self.tables.append((emb, lanes))
        # slices of every item at steps of half a slice, the last one at its end; of each the places of
        # every byte as bits, bytes with equal low bits as one
        half = SLICE // 2
        count = np.maximum(-(-(self.n_bytes - SLICE) // half), 0) + 1
        self.first_slice = np.cumsum(count) - count
        item = np.repeat(np.arange(len(rows)), count)
        place = (np.arange(len(item)) - self.first_slice[item]) * half
        self.slice_offset = np.maximum(np.minimum(place, self.n_bytes[item] - SLICE), 0)
        self.slice_size = np.minimum(self.n_bytes[item], SLICE)
        self.places = np.zeros((len(item), 32), U)
        for k in range(SLICE):
            some = np.flatnonzero(k < self.slice_size)
            at = self.begins[item[some]] + self.slice_offset[some] + k
            self.places[some, data[at] & 31] |= U(1 << k)

    def near(self, data: np.ndarray, slices: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether a stretch of the text about ``start`` is like the slice
        that would start there: columns of the edit matrix, one machine word
        for each slice."""
        out = np.zeros(len(slices), bool)
        slack = int(SLICE * MAX_EDITS)
        for at in range(0, len(slices), 4096):
            some, begin = slices[at:at + 4096], start[at:at + 4096] - slack
            size = self.slice_size[some]
            top = (size - 1).astype(U)
            rows = some * 32
            score, best = size.copy(), size.copy()
            up, down = np.full(len(some), ~U(0)), np.zeros(len(some), U)
            for k in range(int(size.max()) + 2 * slack):
                eq = self.places.ravel()[rows + (data[np.clip(begin + k, 0, len(data) - 1)] & 31)]
                with np.errstate(over="ignore"):
                    diagonal = (((eq & up) + up) ^ up) | eq | down
                plus = down | ~(diagonal | up)
                minus = up & diagonal
                score += ((plus >> top) & U(1)).astype(np.int64)
                score -= ((minus >> top) & U(1)).astype(np.int64)
                plus <<= U(1)
                minus <<= U(1)
                up = minus | ~(diagonal | plus)
                down = plus & diagonal
                np.minimum(best, score, out=best)
            out[at:at + 4096] = best <= np.ceil(SLICE_EDITS * size)
        return out

    def candidates(self, joined: bytes, split: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, byte at which it would start, byte at which they meet) for
        all meeting windows."""
        found = [(np.zeros(0, np.int64),) * 3]

        def meet(key, some, sorted_keys):
            lo = np.searchsorted(sorted_keys, key, "left")
            n = np.searchsorted(sorted_keys, key, "right") - lo
            some, lo, n = some[n > 0], lo[n > 0], n[n > 0]
            return np.repeat(some, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())

        spaced = np.concatenate([[False], _SPACED[np.frombuffer(joined, np.uint8)], [False]])  # byte i is at i + 1
        for size, sorted_keys, item, seen in self.exact:
            key = split.stretches(joined, size)
            some = np.flatnonzero(seen[key >> U(44)])
            at, hit = meet(key[some], some, sorted_keys)
            item = item[hit]
            # a single spaced word counts where it stands as a word
            end = at + self.n_bytes[item]
            inner = (spaced[at] & spaced[at + 1]) | (spaced[np.minimum(end, len(joined))] & spaced[np.minimum(end + 1, len(joined) + 1)])
            ok = (self.n_words[item] > 1) | ~inner
            found.append((item[ok], at[ok], at[ok]))
        data = np.frombuffer(joined, np.uint8)
        met = []
        for emb, lanes in self.tables:
            for key, (sorted_keys, place, seen) in zip(emb.keys(data), lanes):
                some = np.flatnonzero(seen[key >> 12])
                at, hit = meet(key[some], some, sorted_keys)
                met.append(np.stack([place[hit], at]))
        if met:
            place, at = np.concatenate(met, 1)
            item = np.searchsorted(self.begins, place, "right") - 1
            offset = place - self.begins[item]
            last = np.append(self.first_slice[1:], len(self.slice_size)) - 1
            slices = np.minimum(self.first_slice[item] + np.maximum(offset - SLICE // 4, 0) // (SLICE // 2), last[item])
            # windows that place one slice at about one byte are judged once
            _, one = np.unique(slices * (len(data) + SLICE) + (at - offset + self.slice_offset[slices] + SLICE) // 8, return_index=True)
            item, offset, at, slices = item[one], offset[one], at[one], slices[one]
            ok = self.near(data, slices, at - offset + self.slice_offset[slices])
            found.append((item[ok], (at - offset)[ok], at[ok]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def search(self, texts: list[str | None], split: Words, first_only: bool = False) -> list[tuple]:
        """(text number, item number, start, end, distance): the best place
        of every item in every text, for items within the allowed edits."""
        sizes = [0] * len(texts)
        data = []
        for k, t in enumerate(texts):
            data.append((t or "").encode().lower())
            sizes[k] = len(data[-1]) + 1
        joined = b"\n".join(data)
        if not joined:
            return []
        item, start, at = self.candidates(joined, split)
        if not len(item):
            return []
        bounds = np.cumsum([0, *sizes])
        owner = np.searchsorted(bounds, at, "right") - 1  # the text in which they meet
        seen = np.unique(np.stack([owner, item, start], 1), axis=0)
        out, best = [], {}
        k = 0
        while k < len(seen):  # starts of one item that lie close together are one place
            o, i, s = seen[k]
            last = k
            while last + 1 < len(seen) and seen[last + 1][0] == o and seen[last + 1][1] == i and \
                    seen[last + 1][2] - seen[last][2] <= max(8, self.n_bytes[i] // 2):
                last += 1
            hit = None if first_only and (o,) in best else self._verify(
                data[o], int(bounds[o]), int(i), int(s), int(seen[last][2]))
            if hit:
                old = best.get((o, i))
                if old is None or hit < old:
                    best[(o, i)] = hit
                best[(o,)] = True
            k = last + 1
        for key, value in best.items():
            if len(key) == 2:
                out.append((int(key[0]), int(key[1]), *value[1:], value[0]))
        return out

    def _verify(self, data: bytes, begin: int, item: int, low: int, high: int):
        text = self.texts[item]
        most = int(MAX_EDITS * len(text))
        a = max(low - begin - 4 * most - 4, 0)
        b = min(high - begin + int(self.n_bytes[item]) + 4 * most + 4, len(data))
        if a >= b:
            return None
        while a > 0 and data[a] & 0xC0 == 0x80:
            a -= 1
        around = data[a:b].decode(errors="ignore")
        if self.lone[item]:
            found = best_word(text, around, most, a > 0 and bool(_SPACED[data[a - 1]]), b < len(data) and bool(_SPACED[data[b]]))
        else:
            found = best_stretch(text, around, most)
        if not found:
            return None
        before = len(data[:a].decode())
        return found[0], before + found[1], before + found[2]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list]]:
    some, size, at = [], 0, 0
    for k, t in enumerate(texts):
        some.append(t)
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield at, some
            some, size, at = [], 0, k + 1
    if some:
        yield at, some


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The query set in blocks of bounded size, in order of item_id."""
    rows = (benchmark.selectExpr("cast(item_id as bigint) as item_id", "cast(text as string) as text")
            .filter("text is not null").distinct().orderBy("item_id", "text"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Items(block)
            block, size = [], 0
    if block:
        yield Items(block)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, distance, similarity: one row for every
    document and item with a stretch of the text (code points, end
    exclusive, A-Z lower-cased) within ``MAX_EDITS`` of the item's length;
    the one with the least distance, then the first.  For an item that is
    one ASCII word the stretch is a whole word.

    Null and empty texts and items, and items without a word, match
    nothing; so does an empty benchmark.  Repeated documents give a row
    each, repeated items one; null ids are kept.  Each block of items is one
    pass over the documents, without a shuffle."""
    out = None
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            free_worker()
            split = Words(CHUNK_BYTES + (1 << 16))
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = []
                for at, some in _chunks(b.column(1).to_pylist()):
                    by_item = {}
                    for t, i, start, end, distance in items.search(some, split):
                        row = (ids[at + t], items.ids[i], start, end, distance, 1 - distance / len(items.texts[i]))
                        old = by_item.get((t, items.ids[i]))
                        if old is None or (row[4], row[2]) < (old[4], old[2]):
                            by_item[(t, items.ids[i])] = row
                    rows += by_item.values()
                cols = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 ["doc_id", "item_id", "start", "end", "distance", "similarity"])

        found = id_text(docs).mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no item was found."""
    for items in item_blocks(benchmark):

        def make_mask(items=items):
            split = Words(CHUNK_BYTES + (1 << 16))

            def mask(texts: list) -> list[bool]:
                keep = [True] * len(texts)
                for at, some in _chunks(texts):
                    for hit in items.search(some, split, first_only=True):
                        keep[at + hit[0]] = False
                return keep

            return mask

        docs = keep_rows(docs, make_mask)
    return docs
