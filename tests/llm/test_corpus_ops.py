"""Operators that compare documents with each other, pairs and the pipeline."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import preferences, rindex, simhash
from tessera.llm.components import stars

SF = "/root/testdata/sf0.001"
LONG = "".join(random.Random(9).choice("abcdefgh ") for _ in range(400))
ODD = [
    (1, LONG, "x"), (1, LONG, "x"), (1, "other text of id one", "y"), (2, None, None), (3, "", "z"), (4, " \n", "z"),
    (None, LONG + " and more", "z"), (None, LONG, "q"), (5, "x" + LONG[50:300] + LONG[50:300], "q"), (6, "Two words", "q"), (7, "two WORDS", "q"),
    (8, "ab" * 40_000, "q"), (9, "é" * 120, "q"),
]
COLUMNS = "doc_id bigint, text string, fingerprint string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# 3: SimHash

def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = max(len(words) - 2, 1)
    hashes = [xxhash.xxh64(b" ".join(words[i:i + 3]), seed=42).intdigest() for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def classes(fps, ids, budget=2):
    """Least id of the component of each (fingerprint, id)."""
    distinct = sorted(set(fps))
    arr, root = np.array(distinct, np.uint64), list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr) <= budget):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least, at = {}, {f: k for k, f in enumerate(distinct)}
    for f, i in zip(fps, ids):
        k = find(at[f])
        old = least.get(k)
        least[k] = i if old is None else old if i is None else min(old, i)
    return [least[find(at[f])] for f in fps]


def test_simhash_groups_match_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id > 50").union(odd.select("doc_id", "text"))
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    least = classes([f for _, f in rows], [i for i, _ in rows])
    expect = sorted((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(rows, least))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == expect
    crowded = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.groups(docs, node_rows=1).collect())
    assert crowded == expect  # nodes dealt out as pairs of descendants


@pytest.mark.parametrize("node_rows", [200_000, 4])
@pytest.mark.parametrize("budget", [1, 2, 3])
def test_trie_join_loses_no_link(spark, node_rows, budget):
    rng = random.Random(budget)
    fps = []
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randint(0, 63 if rng.random() < 0.5 else 12)
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    root = {r.u: r.v for r in stars(simhash.links(df, budget, node_rows)).collect()}
    own = [root.get(signed(f), signed(f)) for f in fps]
    expect = classes(fps, list(range(len(fps))), budget)
    assert len(set(zip(own, expect))) == len(set(own)) == len(set(expect))


def test_trie_frontier_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 3)
    rng = random.Random(1)
    keys = np.array(sorted({rng.getrandbits(8) << 56 for _ in range(80)}), np.uint64)
    one, n = (np.array([v], np.int64) for v in (0, len(keys)))
    pairs = {(int(a), int(b)) for i, j in simhash.Trie(keys).pairs(0, (one, n, one, n, one), 2) for a, b in zip(i, j)}
    assert pairs == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= 2}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "u bigint, v bigint")
    assert {(r.u, r.v) for r in stars(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(501, 500)}


def test_simhash_keeps_one_row_of_each_group(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    fps = [plain_fingerprint(r[1]) for r in ODD]
    groups = classes(fps, list(range(len(ODD))))
    rows = kept.collect()
    assert len(rows) == len(set(groups))
    assert collections.Counter((r.doc_id, r.text) for r in rows)[(1, LONG)] == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# 10: repeated strings

def test_index_marks_later_starts():
    rng = random.Random(1)
    for length in (3, 5):
        for _ in range(150):
            parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))).encode() for _ in range(rng.randint(1, 6))]
            seen = set()
            for p, got in zip(parts, rindex.repeated_starts(parts, length)):
                expect = []
                for i in range(len(p) - length + 1):
                    if p[i:i + length] in seen:
                        expect.append(i)
                    seen.add(p[i:i + length])
                assert got.tolist() == expect


def test_index_is_run_compressed():
    text = np.frombuffer(b"abcabcabd" * 40, np.uint8).astype(np.int64)
    index = rindex.RunIndex(np.append(text + 1, 0))
    assert len(index.heads) < 20 and len(index.sample) == len(index.heads)
    phi, common = index.matching_statistics()
    data = np.append(text + 1, 0)
    order = rindex.suffix_array(data)
    for before, here in zip(order[:-1], order[1:]):
        assert phi[here] == before
        k = 0
        while max(before, here) + k < len(data) and data[before + k] == data[here + k]:
            k += 1
        assert common[here] == k


def plain_removal(rows, length=100):
    """(bytes, removed, spans, digest) of texts in corpus order."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                mark[i] += 1
                mark[i + length] -= 1
            seen.add(s)
        gone = np.cumsum(mark[:-1]) > 0
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                    hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowded_at", [20_000, 1])
def test_removal_matches_brute_force(spark, crowded_at):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    expect = {d: e for (d, _), e in zip(rows, plain_removal([t for _, t in rows]))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in rindex.remove_repeats(docs, crowded_at=crowded_at).collect()}
    assert sum(e[1] for e in expect.values()) > 0 and got == expect


def test_removal_of_odd_rows(spark, odd, none, monkeypatch):
    key = {r.text: r.k for r in odd.selectExpr("text", "xxhash64(coalesce(text, '')) as k").collect()}
    order = sorted(set((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is None, r[0] or 0, key[r[1]]))
    expect = dict(zip(order, plain_removal([t for _, t in order])))
    for piece in (1 << 19, 1000):  # long texts cut into pieces
        monkeypatch.setattr(rindex, "PIECE", piece)
        got = rindex.remove_repeats(odd).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == collections.Counter(
            (r[0], *expect[(r[0], r[1])]) for r in ODD)
        assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert rindex.remove_repeats(none).count() == 0


def test_a_common_passage_does_not_meet_in_one_index(spark, monkeypatch):
    rng = random.Random(9)

    def some(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))

    common = some(150)
    docs = spark.createDataFrame([(k, some(60) + common + some(60)) for k in range(300)], "doc_id bigint, text string").repartition(4)
    expect = {tuple(r) for r in rindex.remove_repeats(docs, with_text=False).collect()}
    most, index = [], rindex._index

    def watched(parts, length):
        most.append(parts.groupBy("anchor").count().agg({"count": "max"}).first()[0] or 0)
        return index(parts, length)

    monkeypatch.setattr(rindex, "_index", watched)
    monkeypatch.setattr(rindex, "SALTS", 7, raising=False)
    got = {tuple(r) for r in rindex.remove_repeats(docs, with_text=False, crowded_at=20).collect()}
    assert got == expect and sum(r[2] >= 150 for r in got) == 299
    assert most[0] <= 20


# 9: preference pairs

def plain_pair(rows):
    sides = {s: sorted({(t, r, x) for side, t, r, x in rows if side == s}) for s in ("chosen", "rejected")}
    everything = sorted(set(sides["chosen"]) | set(sides["rejected"]))
    n = 0
    while n < len(everything) and everything[n] in sides["chosen"] and everything[n] in sides["rejected"]:
        n += 1

    def show(turns):
        out, spans = "", []
        for _, role, text in turns:
            head = f"<|{role}|>\n"
            if role == "assistant":
                spans.append(f"{len(out) + len(head)}:{len(out) + len(head) + len(text) + len('<|end|>') + 1}")
            out += head + text + "<|end|>\n"
        return out, ",".join(spans)

    prompt = show(everything[:n])[0]
    c, cs = show([t for t in sides["chosen"] if t not in everything[:n]])
    r, rs = show([t for t in sides["rejected"] if t not in everything[:n]])
    return n, prompt, c, r, cs, rs


def test_preference_pairs(spark):
    rng = random.Random(8)
    rows = []
    for pair in range(60):
        turns = [(t, rng.choice(["user", "assistant"]), rng.choice(["a", "éb", ""])) for t in range(rng.randint(0, 6))]
        cut = rng.randint(0, len(turns))
        other = turns[:cut] + [(t, rng.choice(["user", "assistant"]), rng.choice(["a", "c"])) for t in range(cut, rng.randint(cut, 7))]
        rows += [(pair, "chosen", *t) for t in turns] + [(pair, "rejected", *t) for t in other]
        rows += [rows[-1]] if rows and rng.random() < 0.2 else []
    df = spark.createDataFrame([(*r, "x") for r in rows], "pair_id bigint, side string, turn bigint, role string, text string, prompt string")
    by = collections.defaultdict(list)
    for p, *rest in rows:
        by[p].append(rest)
    got = {r.pair_id: tuple(r)[1:] for r in preferences.format_pairs(df).collect()}
    assert got == {p: plain_pair(v) for p, v in by.items()}


def test_preference_nulls_and_empty(spark):
    schema = "pair_id bigint, side string, turn bigint, role string, text string"
    df = spark.createDataFrame([(None, "chosen", 0, None, None), (None, "rejected", 0, None, None), (None, "rejected", None, "user", "q"),
                                (1, "chosen", 0, "assistant", "x" * 50_000), (2, None, 0, "user", "x")], schema)
    got = {r.pair_id: r for r in preferences.format_pairs(df).collect()}
    assert set(got) == {None, 1}
    assert (got[None].n_prompt_turns, got[None].prompt) == (0, "")  # the null turn comes first
    assert got[None].chosen == "<|unknown|>\n<|end|>\n" and got[None].rejected.startswith("<|user|>\nq")
    assert got[1].rejected == "" and got[1].chosen_spans == "14:50022"
    assert preferences.format_pairs(df.limit(0)).count() == 0
    assert preferences.exchanged_answers(df.selectExpr("pair_id as conv_id", "turn", "role", "text").limit(0)).count() == 0


# the pipeline

def test_pipeline_stages_take_effect(spark):
    from tessera.llm import decontam, langid, secret_scan
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, "123 456"), (9003, docs.first().text)], "doc_id bigint, text string")
    now = docs.unionByName(odd, allowMissingColumns=True)
    all_ids = {r.doc_id for r in now.select("doc_id").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "byte_bpe":
            assert out.columns == now.columns
        out = out.checkpoint()
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "language_id":
            assert kept[name] == all_ids - {9001, 9002}
        elif name == "simhash_near_dedup":
            assert kept[name] == {r.component_id for r in simhash.near_duplicates(now).collect()} and 9003 not in kept[name]
        elif name == "benchmark_decontamination":
            hit = {r.doc_id for r in decontam.contaminated(now, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert kept[name] == {r.doc_id for r in now.select("doc_id").collect()} - hit
        elif name == "secret_scan":
            hit = {r.doc_id for r in secret_scan.find_secrets(now).filter("spans <> ''").collect()}
            assert kept[name] == {r.doc_id for r in now.select("doc_id").collect()} - hit
        else:
            assert out.count() == now.count() and out.filter("n_tokens <> size(token_ids)").count() == 0
        now = out
    assert langid.UNDETERMINED == "und"
