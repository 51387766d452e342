"""Token counts of fields and sections by offset-mapped attribution.

A document is rendered once, its fields one after the other, and encoded
once.  Byte-level tokens are stretches of the rendering's bytes, so running
sums of their lengths are their spans, and sections are spans too: joining
the two by interval gives each section its tokens.  A token that crosses a
boundary belongs to one section by an explicit rule, so the counts of a
document add up to its tokens.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import per_process

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEPARATOR = "\n\n"  # between fields; part of the field before it
RULES = ("first", "last", "most")
SCHEMA = "doc_id bigint, field string, section bigint, start bigint, end bigint, n_tokens bigint, n_shared bigint"


def sections_of(text: bytes) -> np.ndarray:
    """Starts of the sections of a field: 0 and after every newline that is
    followed by anything.  A section holds its newline."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], at[at < len(text)]]).astype(np.int64)


def attribute(token_sizes: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that touch a neighbour too) of each section, for
    sections [starts[k], starts[k + 1]) that cover the tokens' spans.

    ``first``: the section of a token's first byte; ``last``: of its last
    byte; ``most``: the one with most of its bytes, the earlier of equals.
    Sections of no bytes get nothing."""
    ends = np.cumsum(token_sizes)
    begin = ends - token_sizes
    own_first = np.searchsorted(starts, begin, "right") - 1
    own_last = np.searchsorted(starts, ends - 1, "right") - 1
    owner = own_last.copy() if rule == "last" else own_first.copy()
    crossing = np.flatnonzero(own_first != own_last)
    if rule == "most":
        for t in crossing:
            cuts = np.clip(starts[own_first[t]:own_last[t] + 2], begin[t], ends[t])
            if len(cuts) < own_last[t] - own_first[t] + 2:
                cuts = np.append(cuts, ends[t])
            owner[t] = own_first[t] + int(np.argmax(np.diff(cuts)))
    counts = np.bincount(owner, minlength=len(starts))
    shared = np.zeros(len(starts), np.int64)
    for t in crossing:
        shared[own_first[t]:own_last[t] + 1] += 1
    return counts, shared


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, fields: list[str], rule: str = "most") -> DataFrame:
    """doc_id, field, section, start, end, n_tokens, n_shared: one row for
    every section (line) of every field of every row of ``docs``.

    start and end are code points in the field, end exclusive; n_shared
    counts the tokens that touch the section and another one.  The separator
    after a field belongs to its last section.  Null and empty fields have
    one section of no characters and, if another field follows that is not,
    none of the tokens; null fields are not rendered.  Repeated rows are
    counted as often as they occur, null ids kept; columns other than
    doc_id and the fields are ignored.  No shuffle."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       *[F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(fields)])

    def make():
        import tiktoken
        sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        return tiktoken.Encoding("given ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = per_process(("counts", hash(frozenset(ranks.items())), pattern), make)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [[] for _ in range(7)]
                for doc_id, *texts in zip(*[c.to_pylist() for c in part.columns]):
                    _one(out, doc_id, texts, encoding, sizes)
                types = [pa.int64(), pa.string()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                                 ["doc_id", "field", "section", "start", "end", "n_tokens", "n_shared"])

    def _one(out, doc_id, texts, encoding, sizes):
        present = [k for k, t in enumerate(texts) if t]
        starts, labels, offset, rendered = [], [], 0, []
        for k, text in enumerate(texts):
            data = (text or "").encode()
            cut = sections_of(data)
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            ends = np.append(cut[1:], len(data))
            if k in present:
                starts.append(cut + offset)
                body = text + (SEPARATOR if k != present[-1] else "")
                rendered.append(body)
                offset += len(body.encode())
            labels.append((fields[k], chars[cut], chars[ends], k in present))
        if present:
            ids = encoding.encode_to_numpy("".join(rendered), disallowed_special=())
            counts, shared = attribute(sizes[ids], np.concatenate(starts), rule)
        done = 0
        for field, first, end, there in labels:
            n = len(first)
            out[0] += [doc_id] * n
            out[1] += [field] * n
            out[2] += range(n)
            out[3] += first.tolist()
            out[4] += end.tolist()
            out[5] += counts[done:done + n].tolist() if there else [0] * n
            out[6] += shared[done:done + n].tolist() if there else [0] * n
            done += n if there else 0

    return rows.mapInArrow(run, SCHEMA)
