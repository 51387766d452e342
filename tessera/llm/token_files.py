"""Token ids in Parquet files: written in corpus order, read back in part.

One row per document, ids as a list column.  Ids are dictionary-encoded
(repeated values in few bits) and fall back to delta encoding when the
dictionary grows too large; document ids and counts are delta-encoded.  Row
groups and pages are kept small, and pages carry column indexes, so a reader
that asks for some documents or only for counts fetches only those pages.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.base import free_worker, id_text, per_process
from tessera.session import bound_batches, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 2
MAX_WORDS = 250_000
MAX_WORD_BYTES = 256
#: Texts that are encoded together, so that their words are looked up once.
TEXTS_AT_ONCE = 2000
#: Texts that are split, and put together from their words, at a time.
TEXTS_SPLIT = 500
#: Marks that end many words and, after a letter, are a piece of their own.
MARKS = frozenset(".,;:!?")
#: Stands before the first word of a text, which has no space.
FIRST = "\0"
#: How a byte-level vocabulary writes the byte of a space.
SPACE = "\u0120"
FILE_SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>"
#: Writer settings: format version with delta encodings, 16 MB row groups,
#: pages of at most 64 KB or 1000 rows, no dictionary for what never repeats.
WRITER = {
    "compression": "snappy",  # packed ids hardly shrink further
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


class WordEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library.

    Such a tokenizer splits a text before it merges bytes, and a single
    space between two characters that are no white space always begins a
    new piece.  So each word, with its space, is given to the library once,
    together with other words, and its ids, which begin at the token that
    holds the space, are kept; texts with other spacing are given to it
    whole.  A mark after letters is a piece of its own, so such a word is
    put together from its parts.  A word of ASCII letters is one piece and
    is written in the vocabulary as it is, after ``SPACE``; such words are
    given to the library in that form and split at white space alone.  Arrow
    splits the texts, finds the different words of a call and looks them up,
    so only new ones are read by the library; the table keeps the first
    ``max_words`` words of at most ``MAX_WORD_BYTES`` (frequent ones come
    early) and forgets the others after each call.  The library's own threads
    stay off: Spark's tasks are what runs at once."""

    def __init__(self, tokenizer_json: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.by_word = Tokenizer(self.tokenizer.model)  # one model, two ways to split
        self.by_word.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[n for token, n in vocabulary.items() if token[0] == SPACE]] = True
        self.max_words = max_words
        self.words = pa.array([""], pa.string())  # a word's place is its number; the first is no word
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.full(1 << 16, -1, np.int64)  # -1: not a word
        self.ids = np.zeros(1 << 18, np.int32)
        self.used = 0
        self.marks = {m: self._encode([m])[0][0] for m in MARKS}  # a byte is one id

    def _encode(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Numbers of different words (0 for one over ``MAX_WORD_BYTES``) and
        the words that the table did not have, in the order of their numbers.
        The table and the words that it lacks are hashed once each."""
        stem = pc.utf8_slice_codeunits(words, 0, -1)
        is_marked = pc.and_(pc.is_in(pc.utf8_slice_codeunits(words, -1), value_set=pa.array(sorted(MARKS))), pc.utf8_is_alpha(stem))
        is_marked = is_marked.to_numpy(zero_copy_only=False)
        stem = stem.filter(pa.array(is_marked))
        at = pc.fill_null(pc.index_in(pa.concat_arrays([words, stem]), value_set=self.words), -1).to_numpy().astype(np.int64)
        number, base = at[:len(words)], at[len(words):]
        number[pc.greater(pc.binary_length(words), MAX_WORD_BYTES).to_numpy(zero_copy_only=False)] = 0
        is_new = number < 0
        new, marked = words.filter(pa.array(is_new)), is_marked & is_new
        wanted = is_new[is_marked]
        base, stem = base[wanted], stem.filter(pa.array(wanted))
        missing = base < 0
        more = pa.concat_arrays([new, stem.filter(pa.array(missing))]).dictionary_encode()  # the new words come first
        base[missing] = len(self.words) + more.indices.to_numpy()[len(new):]
        number[is_new] = len(self.words) + np.arange(len(new))
        self._learn(more.dictionary, marked[is_new], base)
        return number, more.dictionary

    def _learn(self, fresh: pa.Array, is_marked: np.ndarray, base: np.ndarray) -> None:
        """Makes the ids of words that the table does not have, numbered on
        from it.  Among the first of them, ``is_marked`` are those that end
        with a mark after letters, and ``base`` the numbers of the letters."""
        begin = len(self.words)
        marked = fresh.slice(0, len(is_marked)).filter(pa.array(is_marked))
        while begin + len(fresh) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.first, self.size))
        self.size[begin:begin + len(fresh)] = -1
        letters = pc.utf8_is_alpha(fresh)
        plain = letters.to_numpy(zero_copy_only=False).copy()
        is_ascii = pc.and_(letters, pc.string_is_ascii(fresh)).to_numpy(zero_copy_only=False) & (self.tokenizer.normalizer is None)
        alone = []
        others = ~(plain | np.append(is_marked, np.zeros(len(fresh) - len(is_marked), bool)))
        sure = pc.match_substring_regex(fresh, r"(?s)\A[!-~](.*[!-~])?\z").to_numpy(zero_copy_only=False)
        plain |= others & sure
        others = np.flatnonzero(others & ~sure)
        for k, w in zip(others.tolist(), fresh.take(pa.array(others)).to_pylist()):
            if w[0] == FIRST:
                if w != FIRST and not w[1].isspace() and not w[-1].isspace():
                    alone.append(k)
            elif not w[0].isspace() and not w[-1].isspace():
                plain[k] = True
        self._learn_alone(begin, fresh, np.array(alone, np.int64))
        self._learn_together(begin, fresh, np.flatnonzero(is_ascii), self.by_word, SPACE)
        self._learn_together(begin, fresh, np.flatnonzero(plain & ~is_ascii), self.tokenizer, "")
        if len(marked):
            size = self.size[base] + 1
            ends = np.cumsum(size)
            flat = np.empty(ends[-1], np.int32)
            body = np.ones(ends[-1], bool)
            body[ends - 1] = False
            n = size - 1
            flat[body] = self.ids[np.arange(n.sum()) + np.repeat(self.first[base] - (np.cumsum(n) - n), n)]
            ends_with = pc.utf8_slice_codeunits(marked, -1).dictionary_encode()
            mark = np.array([self.marks[m] for m in ends_with.dictionary.to_pylist()], np.int32)
            flat[ends - 1] = mark[ends_with.indices.to_numpy()]
            self._store(begin + np.flatnonzero(is_marked), size, flat)

    def _learn_together(self, begin: int, words: pa.Array, some: np.ndarray, tokenizer, space: str) -> None:
        """Makes the ids of some words by giving 200 at a time to the library,
        with a space and ``space`` between them and before the first."""
        for at in range(0, len(some), 20_000):  # the library's results are large
            part = some[at:at + 20_000]
            cuts = np.append(np.arange(0, len(part), 200), len(part))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(part)))
            found = self._encode(pc.binary_join_element_wise("", pc.binary_join(lists, " " + space), " " + space).to_pylist(), tokenizer)
            stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(stops[-1]))
            begins = np.flatnonzero(self.spaced[ids])
            if np.array_equal(np.searchsorted(begins, stops), cuts[1:]):
                self._store(begin + part, np.diff(begins, append=len(ids)), ids)
                continue
            for a, z, of in zip(cuts[:-1], cuts[1:], np.split(ids, stops[:-1])):
                begins = np.flatnonzero(self.spaced[of])
                if len(begins) == z - a:
                    self._store(begin + part[a:z], np.diff(begins, append=len(of)), of)
                else:
                    self._learn_alone(begin, words, part[a:z])

    def _learn_alone(self, begin: int, words: pa.Array, some: np.ndarray) -> None:
        """Makes the ids of some words by giving each to the library by itself."""
        if not len(some):
            return
        ids = self._encode([w[1:] if w[0] == FIRST else " " + w for w in words.take(pa.array(some)).to_pylist()])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self._store(begin + some, size, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())))

    def _store(self, numbers: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.first[numbers], self.size[numbers] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def __call__(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out = [np.zeros(0, np.int32)] * len(texts)
        if not len(texts):
            return out
        kept, used = len(self.words), self.used
        # texts with an added token, or with the character that marks first words, go to the library whole
        whole = pc.match_substring(texts, FIRST)
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        pieces, n_words = [], []
        for at in range(0, len(texts), TEXTS_SPLIT):
            some = pc.if_else(whole.slice(at, TEXTS_SPLIT), "", texts.slice(at, TEXTS_SPLIT))
            words = pc.split_pattern(pc.binary_join_element_wise(FIRST, some, ""), " ")
            n_words.append(np.diff(words.offsets.to_numpy()))
            pieces.append(words.flatten())
        different = pa.chunked_array(pieces).dictionary_encode().unify_dictionaries()
        del words, pieces
        numbers, fresh = self._look_up(different.chunk(0).dictionary)
        for part, (count, words) in enumerate(zip(n_words, different.chunks)):
            at = numbers[words.indices.to_numpy()]
            size = self.size[at]
            ends = np.cumsum(count)
            odd = np.add.reduceat(size < 0, ends - count) > 0  # texts with something else between two spaces
            size = np.maximum(size, 0)
            stop = np.cumsum(size)
            flat = self.ids[np.arange(stop[-1]) + np.repeat(self.first[at] - (stop - size), size)]
            begin = part * TEXTS_SPLIT
            for k, ids in enumerate(np.split(flat, stop[ends[:-1] - 1])):
                if not odd[k]:
                    out[begin + k] = ids
            rest = np.flatnonzero(odd)
            for k, ids in zip(rest.tolist(), self._encode(texts.take(pa.array(begin + rest)).to_pylist())):
                out[begin + k] = np.array(ids, np.int32)
        if kept >= self.max_words:  # full: what this call added goes
            self.used = used
        else:
            self.words = pa.concat_arrays([self.words, fresh]).slice(0, self.max_words)
        return out


def write_tokens(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = END_ID,
                 writer: dict[str, str] | None = None) -> None:
    """Writes the ids of every text, ``end_id`` appended, to ``path`` in
    ascending doc_id order (nulls first, then by text): file after file in
    the order of their part numbers, row after row in each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("words", hash(tokenizer_json)), lambda: WordEncoder(tokenizer_json))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids = encoder(part.column(1))
                sizes = np.array([len(x) + 1 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                flat = np.empty(int(ends[-1]), np.int32)
                flat[ends - 1] = end_id
                body = np.ones(len(flat), bool)
                body[ends - 1] = False
                flat[body] = np.concatenate(ids)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"])

    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, FILE_SCHEMA).write.options(**(WRITER | (writer or {}))).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the place of each row: file, row."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).select(
        "doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers), from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for b in batches:
            lists = b.column(1)
            values = lists.values.to_numpy().astype("<u4", copy=False)
            cuts = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:z].tobytes()) for a, z in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64()), b.column(2), b.column(3)],
                ["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    rows = read_tokens(spark, path).select("doc_id", "ids", "file", "row").mapInArrow(
        digest, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, row bigint")
    # the counts alone give the offset of each file: one row per file, from a read of one column
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    files = read_tokens(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return counted.join(offsets, "file").select(
        "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_json: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """``write_tokens`` to ``path`` (a fresh folder beside the checkpoints
    if not given), then ``token_index`` of the files.

    Null and empty texts have the end id alone; repeated rows are written
    and returned as often as they occur; other columns are ignored; an empty
    table gives no rows."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or scratch_path(spark, "token-files")
    write_tokens(docs, tokenizer_json, path, end_id)
    return token_index(spark, path)
