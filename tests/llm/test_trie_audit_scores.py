"""Conversation prefix trie, filter audit and suffix-tree scores."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, prefix_trie, suffix_tree

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, n int, part string"  # one name that the audit makes


# 11: prefix trie

def trie_by_hand(rows):
    """Nodes of the rebuilt conversations, from dictionaries of tuples."""
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in built.items():
        ends[tuple(seq)].append(c)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    done = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(done[c][0] for c in children[p]) or 1
        saved = sum(done[c][1] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        done[p] = (leaves, saved)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), *done[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def trie(spark, rows, max_turns=prefix_trie.CONTAINER_TURNS):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("x"))
    nodes = prefix_trie.prefix_nodes(prefix_trie.rebuilt_turns(df), max_turns)
    assert nodes.columns == prefix_trie.NODE_COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in nodes.collect())


ODD_TURNS = [(7, None, None, "é"), (7, 1, "user", None), (7, 1, "user", None), (7, 1, "a", "x"), (8, 5, "user", "x"), (None, 1, "user", "x"),
             (-3, 1, "user", "y"), (10, 1, "user", ""), (11, 1, "user", "long " * 30_000), (12, 1, "user", "long " * 30_000)]


def test_trie_of_odd_rows_and_of_none(spark):
    assert trie(spark, ODD_TURNS) == trie_by_hand(ODD_TURNS)
    assert trie(spark, []) == []


@pytest.mark.parametrize("max_turns", [4, 40, 50_000])
def test_trie_against_dictionaries(spark, max_turns):
    rng = random.Random(max_turns)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice("abc") * rng.randint(0, 2))
            for c in range(120) for t in range(rng.choice([1, 3, 9, 14]))]
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(6)]  # copies
    assert trie(spark, rows, max_turns) == trie_by_hand(rows)


def test_trie_of_conversations_longer_than_a_block_and_a_partition(spark):
    rows = [(c, t, "user", f"{t}" if t < 2500 else f"{t} of {c}") for c in (5, 10) for t in range(2600)]
    rows += [(c, t, "user", f"{t}") for c in (15, 16, 17) for t in range(3)]
    assert trie(spark, rows, 500) == trie_by_hand(rows)


def test_trie_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert trie(spark, rows, 60) == trie_by_hand(rows)


# 12: filter audit

def audit_by_hand(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, source, *_ in docs:
        t = text or ""
        w = t.encode().split()
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
             any(c in "#$%&*|" for c in t), i is not None and i > first[t]]
        fails.append((source or "", f, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {p for p, *_ in fails}:
        shapley = collections.Counter()
        for order in itertools.permutations(range(5)):
            left = [x for x in fails if x[0] == part]
            for step, k in enumerate(order, 1):
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                shapley[k] += len(gone)
                mine = [x for x in fails if x[0] == part and x[1][k]]
                out[part, "".join("ABCDE"[j] for j in order), step] = [
                    len(left), len(gone), len(mine) - len(gone), sum(sum(x[1]) == 1 for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone), k]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def odd_docs():
    long = " ".join(f"w{k}" for k in range(300))
    return [(1, "a b a b a b", "s", 1, "x"), (1, "a b a b a b", "s", 1, "x"), (2, "a b a b a b", None, 1, "x"), (3, None, "s", 1, "x"),
            (4, "", "t", 1, "x"), (None, "", "t", 1, None), (None, None, "t", 1, None), (5, long, "s", 1, "x"), (6, long, "s", 1, "x"),
            (7, long + " #", "s", None, "x"), (8, "ÄÖ ABC \x1c\x0b é", "t", 1, "x"), (9, "word " * 60_000, "t", 1, "x")]


def test_audit_of_odd_rows(spark):
    labels = [(1, 1, 0), (1, 0, 1), (5, 1, 0), (6, 1, 1), (7, None, 1), (None, 1, 1), (77, 1, 1)]
    found = audited(filter_audit.audit_documents(spark.createDataFrame(odd_docs(), DOCS),
                                                 spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert found == audit_by_hand(odd_docs(), labels) and len(found) == 3 * 600


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_documents(spark.createDataFrame([], DOCS), labels).count() == 0


def test_audit_of_many_parts_and_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MAX_PARTS", 3)  # sums are passed on several times
    docs = [(i, "same text" if i % 3 else f"text {i}", f"p{i % 11}", 1, "x") for i in range(2000)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 2000, 3)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    found = audited(filter_audit.audit_documents(spark.createDataFrame(docs, DOCS),
                                                 spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert found == audit_by_hand(docs, labels)


def test_packed_fields_do_not_run_over():
    outcomes = filter_audit.packed_outcomes(3)
    n = (1 << 62) // len(outcomes)
    fields = filter_audit.unpack(sum(n * x for x in outcomes), 3)
    each = sum(filter_audit.unpack(x, 3).astype(object) for x in outcomes)
    assert (fields == n * each).all()


# 13: suffix tree

def test_base_score_by_hand(spark):
    docs = [(i, t, "s", 1, "x") for i, t in enumerate(["A b a", None, "", "b c \x0b D é", "zz zz a", "a " * 50_000, "Ä ä a\x1cb"] * 6)]
    docs += [(3, docs[3][1], "s", 1, "x"), (None, "no id", None, None, None)]
    got = suffix_tree.score_documents(spark.createDataFrame(docs, DOCS)).collect()
    words = [(i, (t or "").encode().lower().split() + [b"\n"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t, *_ in docs]
    c = collections.Counter(w for _, ws, out in words if not out for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, out, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6))
                  for i, ws, out in words)
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_scores_without_rows_and_without_training(spark):
    assert suffix_tree.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = suffix_tree.score_documents(spark.createDataFrame([(out, "ab", "s", 1, "x")], DOCS)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (2, 0, 0, 0.0)
    assert r["score"] == pytest.approx(-3 * math.log10(256), abs=1e-4)


def tree_by_hand(texts, depth):
    """Kept contexts and a function for the probability of a symbol."""
    streams = [b"\n" * depth + b" ".join(t.lower().split()) + b"\n" for t in texts]
    n = collections.defaultdict(collections.Counter)
    for s in streams:
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                n[s[i - d:i]][s[i]] += 1
    total = sum(n[b""].values())

    def passes(c):
        own, up = n[c], n[c[1:]]
        size, upper = sum(own.values()), sum(up.values())
        far = sum(k / size * math.log(k / size / (up[x] / upper)) for x, k in own.items())
        return size * far > max(len(own) - 1, 1) * math.log(size)

    often = {c for c, own in n.items() if sum(own.values()) >= total * suffix_tree.CONTEXT_SHARE}
    kept = {c[k:] for c in often if c and passes(c) for k in range(len(c) + 1)} | {b""}

    def p(c, x):
        own = n[c]
        size, m = sum(own.values()), len(own)
        lower = p(c[1:], x) if c else 1 / 256
        return (own[x] + m * lower) / (size + m)

    def score(text):
        s = b"\n" * depth + b" ".join(text.lower().split()) + b"\n"
        return sum(math.log10(p(next(s[i - d:i] for d in range(depth, -1, -1) if s[i - d:i] in kept), s[i])) for i in range(depth, len(s)))

    return kept, score


@pytest.mark.parametrize("depth", [1, 3])
def test_tree_against_dictionaries(spark, depth):
    texts = [r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(20).collect() if r["text"]]
    tree = suffix_tree.fit_tree(spark.createDataFrame([(t,) for t in texts], "text binary"), depth)
    kept, score = tree_by_hand(texts, depth)
    assert len(tree.child) == len(kept) + 1 and len(kept) > 20
    asked = [b"the and of", b"", "Ünknown § words".encode(), texts[0][:500]]
    assert tree.score([t.lower().split() for t in asked]) == pytest.approx([score(t) for t in asked], rel=1e-5)


def test_tree_is_a_distribution(spark):
    texts = [b"abab abba", b"ab", b"", b"abc abc"] * 30
    tree = suffix_tree.fit_tree(spark.createDataFrame([(t,) for t in texts], "text binary"), 2)
    p = 10 ** tree.log_p[:-1].astype(float)
    assert (p[:, :-1].sum(1) + p[:, -1] * (256 - tree.width + 1)) == pytest.approx(1, abs=1e-5)


def test_longer_contexts_beat_the_empty_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    deep, flat = (suffix_tree.score_documents(docs, d).filter("held_out").agg(F.sum("score")).first()[0] for d in (5, 1))
    assert deep > flat


def test_counts_follow_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("text").cast("binary").alias("text"))
    once, twice = (suffix_tree.count_words(d).agg(F.sum("n")).first()[0] for d in (docs, docs.union(docs)))
    assert twice == 2 * once
