"""Filter interaction audit: what each filter removes in every order.

A document's failures are a mask, one bit a filter.  For a mask everything
that happens in every order and at every step is known beforehand: each mask
is mapped to one big integer that holds all of it side by side, in fields of
64 bits.  Adding the integers of the documents of a part adds all fields at
once; no field can run over into the next, as none exceeds the number of
documents, a bigint.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import free_worker, join_facts
from tessera.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
MAX_PARTS = 256  # sums that a task holds before it passes them on
SALTS = 32
REPORT_SCHEMA = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
                 "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(128, 192))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails: few words, repeated
    words, capitals, symbols."""
    words = text.split()  # of bytes: at space and 0x09 to 0x0D
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUATION))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every document.

    Filters A to D read the text alone; E fails a text that a smaller
    doc_id has too (null: empty text; a null doc_id is not compared).  The
    part is the source, null as the empty string."""
    checkpoint_dir(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([text_mask(t) for t in texts], pa.int32()),
                 pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())],
                ["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.mapInArrow(judge, "doc_id bigint, part string, mask int, digest binary").checkpoint()
    total = rows.count()
    copies = (rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
              .filter(F.col("copies") > 1).checkpoint())
    copied = join_facts(rows, copies, "digest", "copies", total, "left")
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return copied.select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents counted, after their labels
    (any row of ``labels`` with quality = 1 or toxic = 1)."""
    marks = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
             .withColumn("salt", F.lit(0)))
    # repeated ids are counted before the join; null ids, which match nothing, are spread over salts
    cells = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("salt", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.hash("part", "mask"), F.lit(199))).otherwise(0))
    return cells.join(marks, ["doc_id", "salt"], "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def packed_outcomes(n_filters: int) -> list[int]:
    """The big integer of every code: mask, then a bit each for good and
    toxic.  Its fields: for each order, each step, each of ``FIELDS``."""
    orders = list(itertools.permutations(range(n_filters)))
    out = []
    for code in range(1 << (n_filters + 2)):
        mask, good, toxic = code & ((1 << n_filters) - 1), code >> n_filters & 1, code >> (n_filters + 1)
        fields = np.zeros((len(orders), n_filters, len(FIELDS)), "<i8")
        for o, order in enumerate(orders):
            before = False
            for s, f in enumerate(order):
                fails = bool(mask >> f & 1)
                here = fails and not before
                fields[o, s] = (not fails and not before, here, fails and before, mask == 1 << f, here and good, here and toxic)
                before = before or fails
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return out


def unpack(total: int, n_filters: int) -> np.ndarray:
    """Fields of a sum: an array order x step x field."""
    n_orders = len(list(itertools.permutations(range(n_filters))))
    size = n_orders * n_filters * len(FIELDS)
    return np.frombuffer(total.to_bytes(size * FIELD_BYTES, "little"), "<i8").reshape(n_orders, n_filters, len(FIELDS))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of ``filters`` and step: the counts of
    ``FIELDS`` and the Shapley sum of the step's filter (what it removes,
    over all orders).  ``cells``: part, mask, good, toxic, n.

    A task adds the integers of its documents part by part; the sums of a
    part meet in salted groups first, then in one, and are added as they
    stream by.  No cells, no rows."""
    n_filters = len(filters)
    names = ["".join(p) for p in itertools.permutations(filters)]

    def packed(part: str, total: int) -> pa.RecordBatch:
        size = len(names) * n_filters * len(FIELDS) * FIELD_BYTES
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()),
             pa.array([zlib.compress(total.to_bytes(size, "little"), 1)], pa.binary())], ["part", "salt", "packed"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        outcomes, sums = packed_outcomes(n_filters), {}
        for b in batches:
            for part, code, n in zip(*(c.to_pylist() for c in b.columns)):
                sums[part] = sums.get(part, 0) + n * outcomes[code]
                if len(sums) > MAX_PARTS:
                    yield from itertools.starmap(packed, sums.items())
                    sums.clear()
        yield from itertools.starmap(packed, sums.items())

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        last, total = None, 0
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if part != last and last is not None:
                    yield last, total
                    total = 0
                last = part
                total += int.from_bytes(zlib.decompress(data), "little")
        if last is not None:
            yield last, total

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        return itertools.starmap(packed, in_order(batches))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        at_step = np.array([[filters.index(c) for c in name] for name in names])
        for part, total in in_order(batches):
            fields = unpack(total, n_filters)
            removed = fields[:, :, FIELDS.index("removed")]
            shapley = np.array([removed[at_step == f].sum() for f in range(n_filters)], np.int64)
            n = len(names) * n_filters
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n), pa.array([x for x in names for _ in range(n_filters)]),
                 pa.array(list(range(1, n_filters + 1)) * len(names), pa.int32()),
                 *[pa.array(fields[:, :, k].ravel()) for k in range(len(FIELDS))], pa.array(shapley[at_step].ravel())],
                [x.split()[0] for x in REPORT_SCHEMA.split(", ")])

    code = (F.col("mask") + F.col("good").cast("int") * (1 << n_filters) + F.col("toxic").cast("int") * (2 << n_filters)).cast("int")
    sums = "part string, salt int, packed binary"
    parts = cells.select("part", code.alias("code"), F.col("n").cast("bigint").alias("n")).mapInArrow(add_up, sums)
    parts = parts.repartition("part", "salt").sortWithinPartitions("part").mapInArrow(merge, sums)
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(report, REPORT_SCHEMA)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters over ``docs``.

    Null and empty texts are one text; repeated rows count as often as they
    occur; other columns are ignored; an empty table gives no rows."""
    return audit(with_labels(failure_masks(docs), labels))
