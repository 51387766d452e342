"""Faults that were found in earlier versions of the text operators."""

import base64
import collections
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, quality, secret_scan

SF = "/root/testdata/sf0.01"


# 4: windows of any size

@pytest.mark.parametrize("window", range(1, 10))
def test_repeated_words_for_every_window(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 9, 17, 40, 60)] + ["a b c d e a b c d e", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.measures(docs, window).select("doc_id", "n_repeat_words").collect()}
    for k, t in enumerate(texts):
        w = (t or "").split()
        seen = collections.Counter(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
        assert got[k] == len({j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}), (window, t)


def test_a_window_has_a_word(spark):
    with pytest.raises(ValueError):
        quality.measures(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), 0)


# 7: long runs, links

@pytest.mark.parametrize("run", ["a" * 1_000_000, "a1" * 500_000, "1" * 1_000_000, "ab-+." * 200_000])
def test_a_long_run_before_an_address_takes_linear_time(spark, run):
    df = spark.createDataFrame([(1, run + " http://x"), (2, run + "://x")], "doc_id bigint, text string").cache()
    df.count()
    secret_scan.find_secrets(df.limit(0)).count()
    at = time.time()
    assert secret_scan.find_secrets(df).count() == 2
    assert time.time() - at < 30  # quadratic time would be hours; most of this is the start of jobs


def test_where_a_scheme_begins(spark):
    texts = ["see http://a.b/c", "-http://a", "12.ftp://b", "http://a http://b", "x:http://c", "://d", "9://e", "a" * 40 + "://f", "<s3+x://k>'u://v'"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.m for r in df.select("doc_id", F.regexp_extract_all("text", F.lit(secret_scan.ENDPOINT), F.lit(0)).alias("m")).collect()}
    plain = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+""")
    assert got == {k: plain.findall(t) for k, t in enumerate(texts)}


def links_by_hand(spans, scope):
    out = set()
    for k, a, z in spans:
        if k < secret_scan.N_BASE:
            continue
        near = [(q, x, y) for q, x, y in spans if x < z + scope and y > a - scope]
        if any(q < secret_scan.N_BASE and x < z and y > a for q, x, y in near):
            continue
        best = collections.Counter()
        for q, *_ in near:
            role = secret_scan.ROLES[q]
            if role != secret_scan.ROLES[k]:
                best[role] = max(best[role], 2 if q < secret_scan.N_BASE else 1)
        if sum(best.values()) >= secret_scan.EVIDENCE:
            out.add((k, a, z))
    return out


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    docs = {rid: sorted({(rng.randrange(6), a, a + rng.randint(3, 60)) for a in rng.sample(range(1500), rng.choice([0, 2, 6, 20]))}) for rid in range(60)}
    rows = [(rid, k, a, z) for rid, spans in docs.items() for k, a, z in spans]
    df = spark.createDataFrame(rows, "rid bigint, kind int, start bigint, end bigint")
    for scope in (7, 200):
        got = {tuple(r) for r in secret_scan._linked(df, scope).collect()}
        assert got == {(rid, *s) for rid, spans in docs.items() for s in links_by_hand(spans, scope)}


# 6: the stage of the pipeline

def test_the_network_rejects_random_characters_and_keeps_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, background=True)
    rng = random.Random(1)
    forms = [base64.b64encode, base64.b85encode, base64.b32encode, lambda b: b.hex().encode()]
    noise = [(10_000_000 + k, forms[k % 4](rng.randbytes(rng.choice([130, 1500, 9000]))).decode()) for k in range(80)]
    rows = docs.select("doc_id", "text")
    several = [(20_000_000 + k, "\n".join(r.text for r in g)) for k, g in enumerate(zip(*[iter(rows.limit(200).filter("text is not null").collect())] * 5))]
    both = rows.union(spark.createDataFrame(noise + several, "doc_id bigint, text string"))
    kept = {r.doc_id for r in langid.keep_identified(both, model).select("doc_id").collect()}
    assert kept == {r.doc_id for r in both.collect() if langid.has_letter(r.text)} - {k for k, _ in noise}
    assert langid.is_identified(model, [noise[0][1][:100], None, "", "12 34", "ab"]) == [True, False, False, False, True]


def test_without_a_background_letters_decide(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert not model.background and model.bias.shape == (len(model.langs),)
    assert langid.is_identified(model, ["0f3a" * 100, "7" * 200]) == [True, False]


def test_the_stage_without_rows_and_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "some words", 3.0, "x")], "doc_id bigint, text string, score double, lang_pred string")
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").limit(60), background=True)
    assert langid.keep_identified(df, model).collect() == df.collect()
    assert langid.keep_identified(df.limit(0), model).count() == 0


def test_items_of_one_word_are_found_edited_as_whole_words():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (40, 40, 25, 18, 12, 9)] + ["ab", "xy!"]
    block, split = decontam.Items(list(enumerate(words))), decontam.Words(1 << 16)

    def hits(text):
        return {(i, start, end, d) for _, i, start, end, d in block.search([text], split)}

    for k, w in enumerate(words[:6]):
        edited = w[:len(w) // 2] + ("q" if w[len(w) // 2] != "q" else "z") + w[len(w) // 2 + 1:]
        for text in (f"so {edited} it is", edited):
            at = text.index(edited)
            assert (k, at, at + len(w), 1) in hits(text), w
        assert hits(f"so {w}, it is") == {(k, 3, 3 + len(w), 0)}
        assert not hits(f"so zzzzzzzzz{edited}zzzzzzzzz it is") and not hits(f"q{'9' * 40}{w}{'9' * 40}")
    assert hits("a cab, ab") == {(6, 7, 9, 0)}
    assert not hits("cab abc") and not hits("xy?") and hits("(xy!)") == {(7, 1, 4, 0)}
