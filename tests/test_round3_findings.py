"""Findings of round 3: each test fails on the version before."""

import os

import numpy as np

from pyspark.sql import functions as F

from conftest import pat_df
from tessera.operators import explore as C
from tessera.operators import labels as G
from tessera.operators import network as NW
from tessera.operators import planned as PL
from tessera.operators import sentences as SF
from tessera.operators.scoring import space_from_long
from tessera.session import checkpoint_dir
from tessera.sources import io as IO
from tessera.sources import views as V
from tessera.sources.records import read_marked_records


def test_namespace_share_without_a_rare_pattern(spark):
    df = pat_df(spark, [("a", "p", "b", 20), ("a", "q", "b", 3)])
    assert tuple(C.namespace_share(C.touched_predicates(df), "p").first()) == (0, 0, None)


def _tables_written(spark, name):
    """Paths of the scratch tables of one name, the latest last."""
    base = checkpoint_dir(spark).removeprefix("file:") + "/tables"
    found = [os.path.join(base, f) for f in os.listdir(base) if f.startswith(name + "-")] if os.path.isdir(base) else []
    return sorted(found, key=os.path.getmtime)


def test_only_rare_tokens_leave_their_sentence(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT_TOKENS", 2, raising=False)
    sent = spark.createDataFrame([(k, f"the ring C{k} the") for k in range(40)] + [(None, "the ring"), (90, None)], "id long, sentence string")
    vocab = G.build_vocabulary(sent)
    ids = {r.token: r.token_id for r in vocab.collect()}
    enc = G.encode_sequences(sent, vocab.filter("token != 'c3'")).collect()
    got = {r.id: [x for x, m in zip(r.input_ids, r.attention_mask) if m] for r in enc}
    assert len(enc) == 42 and {len(r.input_ids) for r in enc} == {6}
    assert got[7] == [2, ids["the"], ids["ring"], ids["c7"], ids["the"], 3]
    assert got[3][3] == 1 and got[None] == got[90] == [2, 3]
    rows = spark.read.parquet(_tables_written(spark, "sequences")[-1])
    assert rows.selectExpr("explode(_left.token) t").agg(F.min("t"), F.count("t")).first() == ("c0", 40)


def test_repeated_ids_and_tokens_are_encoded_as_before(spark):
    sent = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "b")], "id long, sentence string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "token string, token_id long")
    got = sorted((r.id, r.input_ids) for r in G.encode_sequences(sent, vocab).collect())
    assert got == [(1, [2, 4, 6, 5, 3])] * 2 + [(2, [2, 5, 3, 0, 0])]
    twice = vocab.unionByName(spark.createDataFrame([("b", 9)], "token string, token_id long"))
    got = [r.input_ids for r in G.encode_sequences(sent.filter("id = 2"), twice).collect()]
    assert got == [[2, 5, 9, 3]]


def test_training_rows_of_repeated_and_null_ids(spark):
    sent = spark.createDataFrame([(1, "a", "ra"), (1, "b", "rb"), (2, "a b", "ra"), (None, "a", "ra")], "id long, sentence string, rel string")
    mapping = spark.createDataFrame([("ra", "pa"), ("rb", "pb")], "rel string, prop string")
    space = space_from_long(spark.createDataFrame([("pa", 0, 0, 1.0), ("pb", 1, 1, 1.0)], "predicate string, row_order long, component long, value double"))
    got = sorted((r.id, r.rel, r.input_ids, r.target) for r in G.training_rows(sent, mapping, space, G.build_vocabulary(sent)).collect())
    both = [2, 4, 5, 3]
    assert got == [(1, "ra", both, [1.0, 0.0])] * 2 + [(1, "rb", both, [0.0, 1.0])] * 2 + [(2, "ra", both, [1.0, 0.0])]


def test_imputing_and_resolving_read_their_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    data = [(f"s{k}", "r", "A,B" if k == 0 else "B" if k < 4 else "", None if k == 5 else "C") for k in range(6)] + [("n", None, "", "B,A")]
    df = spark.createDataFrame(data, "sentence string, rel string, e1_type_CNLP string, e2_type_CNLP string")
    for fn, of_0, of_5, of_n in ((PL.impute_types, ("A,B", "C"), ("B", "C"), ("", "B,A")), (PL.resolve_types, ("B", "C"), ("", None), ("", "A"))):
        before = reads.value
        got = {r.sentence: (r.e1_type_CNLP, r.e2_type_CNLP) for r in fn(df.mapInArrow(count, df.schema)).collect()}
        assert (got["s0"], got["s5"], got["n"]) == (of_0, of_5, of_n)
        assert reads.value - before == len(data)


def test_line_items_of_a_sentence_move_twice(spark, tmp_dir):
    """Once to their order, which has met its customer, and once to their part."""
    tables = {"lineitem": "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_discount double",
              "orders": "o_orderkey long, o_custkey long", "customer": "c_custkey long, c_name string",
              "part": "p_partkey long, p_name string, p_type string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_dir}/{name}.parquet")
    plan = V.marked_sentences(spark, tmp_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert [k for line in joins for k in ("p_partkey", "o_orderkey", "c_custkey") if k in line] == ["p_partkey", "o_orderkey", "c_custkey"]
    assert "l_orderkey" in joins[1] and "o_custkey" in joins[2]


def test_spans_of_the_last_marker(spark):
    df = spark.createDataFrame([("<e1> a </e1> x <e1> b </e1> y <e2> c d </e2>",), ("no marker",), ("",), (None,)], "sentence string")
    out = SF.entity_spans(df)
    assert out.dtypes[1:] == [(c, "int") for c in ("e1_start", "e1_end", "e2_start", "e2_end")]
    assert [tuple(r)[1:] for r in out.collect()] == [(4, 4, 6, 7)] + [(0, 0, 0, 0)] * 3
    # no pass of one interpreted step for each token
    assert "aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_an_epoch_is_few_jobs_with_the_same_steps(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i, [float(v) for v in x], int(x[0] > 0)) for i, x in enumerate(X)], "vec_id int, vec array<double>, int_label int")
    sc = spark.sparkContext

    def jobs_of(name, **more):
        sc.setJobGroup(name, name)
        net, _ = NW.fit_baseline(df, hidden=(4,), size=2, max_epochs=2, held_out=0.0, rate=0.05, **more)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return net, len(sc.statusTracker().getJobIdsForGroup(name))

    net, jobs = jobs_of("steps in few jobs")
    assert jobs < 45  # there are 45 mini-batches in each of two epochs
    old = NW.JOB_ROWS
    try:
        NW.JOB_ROWS = 1  # a job for each step
        again, _ = jobs_of("a job for each step")
    finally:
        NW.JOB_ROWS = old
    assert np.allclose(net.history, again.history)
    assert all(np.allclose(a, b) for p, q in zip(net.layers, again.layers) for a, b in zip(p, q))


def test_records_by_number_and_compressed(spark, tmp_dir):
    df = spark.createDataFrame([(k, f"s{k % 7}", f"r{k}") for k in range(50)], "k int, sentence string, relation string")
    IO.write_marked_records(df, tmp_dir + "/r", ["k"], "gzip")
    assert all(f.endswith(".txt.gz") for f in os.listdir(tmp_dir + "/r") if f.startswith("part"))
    got = read_marked_records(spark, tmp_dir + "/r", by_number=True)
    assert "file" not in got.columns
    assert [r.relation for r in got.orderBy("file_no", "rec_id").collect()] == [f"r{k}" for k in range(50)]
    old = read_marked_records(spark, tmp_dir + "/r").orderBy("file", "rec_id").select("sentence", "relation").collect()
    assert old == got.orderBy("file_no", "rec_id").select("sentence", "relation").collect()
