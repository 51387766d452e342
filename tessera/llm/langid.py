"""Language identification with a bidirectional gated recurrent network over
bytes.

The network reads the UTF-8 bytes of a text in both directions, labels every
position, and the mean of the positions' probabilities is the probability of
the document.  Both passes run over windows of ``WINDOW`` bytes that cover
the whole text and start from a zero state, so a text of any length is many
short sequences of one batch.  The weights are learned in numpy by
backpropagation through time from a bounded sample of labelled rows, and
travel to the tasks as a few kilobytes.
"""

from __future__ import annotations

import string
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import free_worker, id_text, keep_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNDETERMINED = "und"
WINDOW = 128
HIDDEN = 8
BATCH_WINDOWS = 2048
#: Bounds of the training sample: rows in all, divided over all languages,
#: most and least rows of each, and characters of each row (a stretch at a
#: place given by its hash).
SAMPLE_ROWS = 19_200
ROWS_PER_LANGUAGE = 300
LEAST_ROWS = 20
CHARS_PER_ROW = 2000
TRAIN_STEPS = 400
TRAIN_BATCH = 128
TRAIN_LENGTH = 64
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


@dataclass
class Direction:
    """Weights of one reading direction: byte inputs and recurrent matrices
    of the update gate, the reset gate and the candidate."""

    inputs: list[np.ndarray]  # three (256, H)
    recur: list[np.ndarray]  # three (H, H)

    def arrays(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recur]

    @classmethod
    def random(cls, rng: np.random.Generator, hidden: int) -> Direction:
        return cls([rng.normal(0, 0.3, (256, hidden)).astype(np.float32) for _ in range(3)],
                   [rng.normal(0, hidden ** -0.5, (hidden, hidden)).astype(np.float32) for _ in range(3)])


@dataclass
class Model:
    langs: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # (2H, languages and perhaps the background)
    bias: np.ndarray
    background: bool = False  # whether a class of no language follows the languages

    def arrays(self) -> list[np.ndarray]:
        return [*self.ahead.arrays(), *self.back.arrays(), self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(d: Direction, x: np.ndarray):
    """States of every step for bytes ``x`` (T, B), and what the way back needs."""
    h = np.zeros((x.shape[1], d.recur[0].shape[0]), np.float32)
    kept = []
    for row in x:
        z = _sigmoid(d.inputs[0][row] + h @ d.recur[0])
        r = _sigmoid(d.inputs[1][row] + h @ d.recur[1])
        m = h @ d.recur[2]
        n = np.tanh(d.inputs[2][row] + r * m)
        kept.append((h, z, r, m, n))
        h = n + z * (h - n)
    return np.stack([*[k[0] for k in kept[1:]], h]), kept


def _backward(d: Direction, x: np.ndarray, kept: list, from_out: np.ndarray) -> list[np.ndarray]:
    """Gradients by backpropagation through time; ``from_out``: the loss's
    gradient at every state."""
    grads = [np.zeros_like(a) for a in d.arrays()]
    later = np.zeros_like(from_out[0])
    at_inputs = [np.empty_like(from_out) for _ in range(3)]
    for t in range(len(x) - 1, -1, -1):
        h, z, r, m, n = kept[t]
        dh = from_out[t] + later
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * m * r * (1 - r)
        dm = dn * r
        later = dh * z + dz @ d.recur[0].T + dr @ d.recur[1].T + dm @ d.recur[2].T
        for k, (g, into) in enumerate(((dz, dz), (dr, dr), (dn, dm))):
            at_inputs[k][t] = g
            grads[3 + k] += h.T @ into
    for k in range(3):
        np.add.at(grads[k], x.ravel(), at_inputs[k].reshape(-1, from_out.shape[2]))
    return grads


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: Characters of the random strings that the background class learns from.
BACKGROUND = [string.digits, "0123456789abcdef", string.ascii_lowercase, string.ascii_letters + string.digits + "+/",
              string.ascii_letters + string.digits + string.punctuation]


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, steps: int = TRAIN_STEPS,
          batch: int = TRAIN_BATCH, length: int = TRAIN_LENGTH, rate: float = 0.02, seed: int = 7,
          background: bool = False) -> Model | None:
    """Learns from the given rows; None if there are none.  Languages are
    drawn evenly, then a text, then a stretch of ``length`` bytes.  With
    ``background`` one more class is drawn like a language: strings of
    random characters of one of the ``BACKGROUND`` alphabets."""
    rows = [(t.encode(), lang) for t, lang in zip(texts, langs) if t and any(map(str.isalpha, t))]
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    classes = len(names) + background
    model = Model(names, Direction.random(rng, hidden), Direction.random(rng, hidden),
                  rng.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32), np.zeros(classes, np.float32), background)
    alphabets = [np.frombuffer(a.encode(), np.uint8) for a in BACKGROUND]
    by_lang = [[np.frombuffer((t * (length // len(t) + 1)), np.uint8) for t, lang in rows if lang == k] for k in names]
    arrays = model.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, steps + 1):
        y = rng.integers(0, classes, batch)
        x = np.empty((length, batch), np.intp)
        for b, k in enumerate(y):
            if k == len(names):
                x[:, b] = rng.choice(alphabets[rng.integers(len(alphabets))], length)
                continue
            text = by_lang[k][rng.integers(len(by_lang[k]))]
            at = rng.integers(len(text) - length + 1)
            x[:, b] = text[at:at + length]
        ha, ka = _forward(model.ahead, x)
        hb, kb = _forward(model.back, x[::-1])
        states = np.concatenate([ha, hb[::-1]], axis=2)
        p = _softmax(states @ model.out + model.bias)
        p[:, np.arange(batch), y] -= 1
        p /= length * batch
        to_states = p @ model.out.T
        grads = [*_backward(model.ahead, x, ka, to_states[:, :, :hidden]),
                 *_backward(model.back, x[::-1], kb, to_states[::-1, :, hidden:]),
                 np.tensordot(states, p, ([0, 1], [0, 1])), p.sum((0, 1))]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, m, v in zip(arrays, grads, first, second):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return model


def _run(d: Direction, x: np.ndarray, live: list[int], out: np.ndarray, order: range) -> np.ndarray:
    """Logit share (T, B, languages) of one direction; at step t only the
    first ``live[t]`` windows have a byte.  Buffers are reused: this is the
    loop that reads the corpus."""
    batch, hidden = x.shape[1], d.recur[0].shape[0]
    logits = np.zeros((x.shape[0], batch, out.shape[1]), np.float32)
    h = np.zeros((batch, hidden), np.float32)
    z, r, n, m = (np.empty((batch, hidden), np.float32) for _ in range(4))
    iz, ir, inn = d.inputs
    uz, ur, un = d.recur
    iz, ir, uz, ur = iz * 0.5, ir * 0.5, uz * 0.5, ur * 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
    for t in order:
        k = live[t]
        if not k:
            continue
        row = x[t, :k]
        hk, zk, rk, nk, mk = h[:k], z[:k], r[:k], n[:k], m[:k]
        np.take(iz, row, axis=0, out=zk, mode="clip")
        zk += np.matmul(hk, uz, out=mk)
        np.tanh(zk, out=zk)
        zk *= 0.5
        zk += 0.5
        np.take(ir, row, axis=0, out=rk, mode="clip")
        rk += np.matmul(hk, ur, out=mk)
        np.tanh(rk, out=rk)
        rk *= 0.5
        rk += 0.5
        np.take(inn, row, axis=0, out=nk, mode="clip")
        np.matmul(hk, un, out=mk)
        mk *= rk
        nk += mk
        np.tanh(nk, out=nk)
        hk -= nk
        hk *= zk
        hk += nk
        np.matmul(hk, out, out=logits[t, :k])
    return logits


def pooled(model: Model, data: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Mean of all positions' probabilities, a row for each byte string and
    a column for each language (the background last)."""
    sizes = np.array([len(d) for d in data], np.int64)
    text = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum(sizes) - sizes
    per_doc = -(-sizes // window)
    owner = np.repeat(np.arange(len(data)), per_doc)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    starts = begin[owner] + place * window
    lengths = np.minimum(sizes[owner] - place * window, window)
    by_length = np.argsort(-lengths, kind="stable")
    total = np.zeros((len(data), len(model.bias)))
    hidden = model.out.shape[0] // 2
    batch = max(min(BATCH_WINDOWS, BATCH_WINDOWS * 64 // len(model.bias)), 1)  # what a batch holds grows with the languages
    for at in range(0, len(by_length), batch):
        some = by_length[at:at + batch]
        steps = np.arange(lengths[some[0]])
        x = text[np.minimum(starts[some][None, :] + steps[:, None], len(text) - 1)].astype(np.intp)
        inside = steps[:, None] < lengths[some][None, :]
        live = inside.sum(1).tolist()
        logits = _run(model.ahead, x, live, model.out[:hidden], range(len(steps)))
        logits += _run(model.back, x, live, model.out[hidden:], range(len(steps) - 1, -1, -1))
        logits += model.bias
        p = _softmax(logits)
        p *= inside[:, :, None]
        np.add.at(total, owner[some], p.sum(0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _probabilities(model: Model, texts: list[str | None], read: Callable[[str | None], bool]) -> Iterator[tuple[int, np.ndarray]]:
    """Place and pooled probabilities of the texts to ``read``, some
    megabytes at a time."""
    some, held = [], 0
    for k, t in enumerate(texts):
        if not read(t):
            continue
        some.append(k)
        held += len(t)
        if held > 4_000_000:
            yield from zip(some, pooled(model, [texts[i].encode() for i in some]))
            some, held = [], 0
    if some:
        yield from zip(some, pooled(model, [texts[i].encode() for i in some]))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its probability for each text; ``und`` and 0 for a text
    that is null or has no letter, and for all texts without a model."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is not None:
        for k, p in _probabilities(model, texts, has_letter):
            best = int(p[:len(model.langs)].argmax())
            langs[k], scores[k] = model.langs[best], float(min(p[best], 1.0))
    return langs, scores


def is_held_out() -> F.Column:
    """crc32 of the doc_id as text, divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, background: bool = False) -> Model | None:
    """Model of every language among the labelled rows that are not held
    out, from about ``SAMPLE_ROWS`` rows divided over the languages (at most
    ``ROWS_PER_LANGUAGE`` and at least ``LEAST_ROWS`` of each), those with
    the lowest hashes of their language, of each a stretch of
    ``CHARS_PER_ROW``.  ``background``: as in ``train``."""
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
            .filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out()))
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return None
    per_lang = max(min(SAMPLE_ROWS // n_langs, ROWS_PER_LANGUAGE), LEAST_ROWS)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - CHARS_PER_ROW, F.lit(0)) + 1) + 1
    sample = (rows.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
              .select("doc_id", "lang", "h", F.substring(F.col("text"), place, F.lit(CHARS_PER_ROW)).alias("text"))
              .withColumn("rank", rank).filter(F.col("rank") <= per_lang)
              .orderBy("lang", "rank").select("lang", "text").collect())
    return train([r["text"] for r in sample], [r["lang"] for r in sample], background=background)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    Only the text is read for a prediction.  Null texts and texts without a
    letter (empty ones too) are ``und`` with score 0; so is everything when
    nothing could be learned.  Null doc_ids count as not held out; repeated
    rows are predicted alike; other columns are ignored.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for b in batches:
            langs, scores = predict(model, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = id_text(docs).select("doc_id", is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


#: Share of a text that may look like random characters to the network.  Of
#: the test documents none has over 0.2, of encoded random bytes all have
#: over 0.95, so the bound keeps source code and tables of figures in doubt.
MOST_BACKGROUND = 0.9


def is_identified(model: Model | None, texts: list[str | None]) -> list[bool]:
    """Whether the language of each text can be told.

    A null text or one without a letter has none.  A text of a window or
    more is judged by the network: it has none if the background class has
    more than ``MOST_BACKGROUND`` of the probability pooled over all its
    positions.  The languages are not held against each other, so a text in
    several of them stays.  Shorter texts, and all without a model or with
    one that knows no background, are given the benefit of the doubt."""
    out = [has_letter(t) for t in texts]
    if model is not None and model.background:
        for k, p in _probabilities(model, texts, lambda t: has_letter(t) and len(t.encode()) >= WINDOW):
            out[k] = bool(p[-1] <= MOST_BACKGROUND)
    return out


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose language can be told (``is_identified``),
    all columns.  Null texts and texts without a letter go; repeated rows
    share their fate; an empty table stays empty."""
    return keep_rows(docs, lambda: lambda texts: is_identified(model, texts))
