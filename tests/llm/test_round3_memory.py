"""Round 3: what the word table of operator 5 costs a call, and how many
whole texts the operators of the pipeline are handed at once."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow.compute as pc
import pytest

from tessera.llm import base, bpe_fst, token_files
from tessera.session import TEXTS_PER_BATCH, bound_batches

ROWS_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tokenizer_json() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def odd_texts(n: int, seed: int) -> list[str | None]:
    rng = random.Random(seed)
    letters = "abcdeABZé中ñß0123.,;:!?'\"()-_#\n\t  \x1ćªĠǅ"
    out: list[str | None] = [None, "", " ", "  a", ".", "a.", " a.", "a ", "a\0b c.", "A<|endoftext|> b", "x" * 400 + " y. " + "y" * 300 + "."]
    while len(out) < n:
        words = ["".join(rng.choices(letters, k=rng.randint(0, 5))) if rng.random() < 0.3
                 else "".join(rng.choices("abcdeABZ", k=rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "!", "'s", ")"])
                 for _ in range(rng.randint(0, 12))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("max_words", [token_files.MAX_WORDS, 40, 1])
def test_ids_are_the_librarys(max_words):
    encoder = token_files.WordEncoder(tokenizer_json(), max_words)
    for seed in range(3):
        texts = odd_texts(1300, seed)  # more than are put together at a time
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in encoder(texts)] == want
        assert len(encoder.words) <= max(max_words, 1)


def test_the_word_table_is_hashed_once_a_call(monkeypatch):
    encoder = token_files.WordEncoder(tokenizer_json())
    encoder([" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(600))])
    table, hashed = len(encoder.words), []

    class Counted:
        def __getattr__(self, name):
            call = getattr(pc, name)
            if name not in ("index_in", "is_in"):
                return call

            def counted(*args, value_set, **options):
                hashed.append(len(value_set) >= table)
                return call(*args, value_set=value_set, **options)
            return counted

    monkeypatch.setattr(token_files, "pc", Counted())
    ids = encoder(["some new words, waa wab. end"])[0].tolist()
    assert ids == encoder.tokenizer.encode("some new words, waa wab. end", add_special_tokens=False).ids
    assert table > 500 and sum(hashed) == 1


def test_words_of_ascii_letters_are_split_at_white_space_alone(monkeypatch):
    encoder = token_files.WordEncoder(tokenizer_json())
    given = []
    encode = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts, *other: (given.append((texts, *other)), encode(texts, *other))[1])
    encoder(["first someword another someword. naïve"])
    assert [texts for texts, *other in given if other == [encoder.by_word]] == [[" Ġsomeword Ġanother"]]


def test_whole_texts_come_in_bounded_batches(spark):
    before = spark.conf.get(ROWS_BATCH)
    docs = spark.range(5 * TEXTS_PER_BATCH, numPartitions=1).selectExpr("id AS doc_id", "concat('some text ', id) AS text")
    try:
        spark.conf.set(ROWS_BATCH, "10000")

        def mask():
            def keep(texts: list) -> list[bool]:
                if len(texts) > 2000:
                    raise ValueError(f"{len(texts)} texts at once")
                return [True] * len(texts)
            return keep

        assert base.keep_rows(docs, mask).count() == 5 * TEXTS_PER_BATCH
        for build in (lambda: bpe_fst.encode_documents(docs.limit(1), {bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN),
                      lambda: token_files.token_files(docs.limit(1), tokenizer_json())):
            spark.conf.set(ROWS_BATCH, "10000")
            build()
            assert spark.conf.get(ROWS_BATCH) == str(TEXTS_PER_BATCH)
        spark.conf.set(ROWS_BATCH, "70")
        bound_batches(spark)
        assert spark.conf.get(ROWS_BATCH) == "70"
        spark.conf.set(ROWS_BATCH, "0")  # no bound at all
        bound_batches(spark)
        assert spark.conf.get(ROWS_BATCH) == str(TEXTS_PER_BATCH)
    finally:
        spark.conf.set(ROWS_BATCH, before)
