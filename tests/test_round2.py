"""Rows of a space are never lost, sizes decide plans and not results, and
files of other tools can be read."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import pat_df
from tessera.functions.index import lines_in_file_order
from tessera.operators import derive as D
from tessera.operators import labels as G
from tessera.operators import ontology as O
from tessera.operators import scoring as H
from tessera.operators import similarity as ES
from tessera.operators import space as SP
from tessera.sources import io as IO
from tessera.sources.patterns import read_patterns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def long_space(spark, rows):
    """rows: (predicate, row_order, vector)."""
    data = [(p, o, k, float(x)) for p, o, v in rows for k, x in enumerate(v)]
    return H.space_from_long(spark.createDataFrame(data, "predicate string, row_order bigint, component bigint, value double"))


@pytest.fixture(scope="module")
def wide_space(spark):
    rng = np.random.default_rng(0)
    rows = [(f"p{k}", k, rng.normal(size=5)) for k in range(600)]
    return rows, long_space(spark, rows)


@pytest.mark.parametrize("mapped", [(400, 501), (2, 501)])
@pytest.mark.parametrize("cells", [0, 10**9])
def test_gated_search_finds_mapped_rows_of_any_order(spark, wide_space, mapped, cells, monkeypatch):
    monkeypatch.setattr(H, "MAX_INDEX_ENTRIES", cells)
    rows, space = wide_space
    mapping = spark.createDataFrame([(f"r{m}", f"p{m}") for m in mapped], "rel string, prop string")
    asked = spark.createDataFrame([(m, [float(x) for x in rows[m][2]], 0.1) for m in mapped], "id bigint, vec array<double>, gate double")
    got = {r.id: r.y_pred for r in H.gated_predict(asked, space, mapping).collect()}
    assert got == {m: f"r{m}" for m in mapped}


@pytest.mark.parametrize("cells", [0, 10**9])
def test_nearest_and_scores_with_gaps_match_numpy(spark, cells):
    rng = np.random.default_rng(1)
    rows = [(f"p{k}", k * 977 + 5, rng.normal(size=4)) for k in range(300)]
    space = long_space(spark, rows)
    asked = rng.normal(size=(20, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "id bigint, vec array<double>")
    X = np.array([v for _, _, v in rows])
    sims = asked @ X.T / np.linalg.norm(X, axis=1) / np.linalg.norm(asked, axis=1)[:, None]
    near = H.nearest_property(df, space, max_entries=cells)
    assert {r.id: r.nearest for r in near.collect()} == {k: rows[int(np.argmax(s))][0] for k, s in enumerate(sims)}
    scores = H.class_scores(df, space, max_entries=cells).collect()
    assert all(np.allclose(r.scores, sims[r.id], atol=1e-9) for r in scores) and len(scores) == 20


def test_queries_of_an_empty_space_are_kept(spark):
    space = long_space(spark, [("a", 0, [1.0])])
    none = SP.Space(space.rows.limit(0), space.entries.limit(0), space.dims)
    asked = spark.createDataFrame([(1, [1.0])], "id bigint, vec array<double>")
    assert [(r.id, r.nearest) for r in H.nearest_property(asked, none).collect()] == [(1, None)]


@pytest.mark.parametrize("hot", [2000, 2])
def test_all_pairs_with_gaps_and_salted_components(spark, hot):
    rng = np.random.default_rng(2)
    rows = [(f"p{k}", o, rng.normal(size=23)) for k, o in enumerate([0, 3, 900, 901, 5000, 77777])]
    got = ES.all_pairs_similarity(long_space(spark, rows), k=6, hot_rows=hot).collect()
    X = np.array([v for _, _, v in rows])
    for r in got:
        a, b = int(r.predicate[1:]), int(r.neighbor[1:])
        d = np.linalg.norm(X[a] - X[b]) if r.metric == "euclidean" else 1 - X[a] @ X[b] / np.linalg.norm(X[a]) / np.linalg.norm(X[b])
        assert abs(r.distance - d) < 1e-5
    assert len(got) == 6 * 2 * 6


def test_similar_rows_are_searched_among_all(spark):
    rows = [(f"p{k}", k * 20_000, [1.0, k / 10]) for k in range(12)]
    got = ES.top_similar(long_space(spark, rows), "p0", k=3).collect()
    assert {(r.metric, r["rank"]): r.predicate for r in got if r.metric == "euclidean"} == {
        ("euclidean", 1): "p0", ("euclidean", 2): "p1", ("euclidean", 3): "p2"}


def test_vector_tables_beyond_the_broadcast_bound(spark):
    space = long_space(spark, [("pa", 0, [1, 0]), ("pb", 1, [0, 1])])
    mapping = spark.createDataFrame([("ra", "pa"), ("rb", "pb")], "rel string, prop string")
    rows = spark.createDataFrame([(1, "ra"), (2, "rb"), (3, "ra")], "id bigint, rel string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for cells, hinted in ((0, False), (100, True)):
            out = G.label_vectors(rows, mapping, space, max_broadcast_cells=cells)
            assert ("BroadcastHashJoin" in plan(out)) == hinted
            assert {r.id: r.target for r in out.collect()} == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 0.0]}
            owner = G.check_vector_owner(out, space, mapping).first()
            assert tuple(owner) == (3, 3, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_property_table_with_repeats_and_gaps(spark):
    pats = pat_df(spark, [("a", "p", "b", 1), ("a", "q", "b", 3), ("c", "q", "d", 1), ("c", "z", "d", 1)])
    listed = spark.createDataFrame([("p", 4), ("q", 7), ("p", 9)], "predicate string, row_order bigint")
    got, expect = SP.build_space(pats, listed), SP.build_space(pats, ["p", "q", "p"])
    key = lambda s: sorted(map(tuple, s.long().collect()), key=str)
    assert key(got) == key(expect)
    once = SP.restrict_to(SP.full_space(SP.probabilities(pats)), listed)
    assert sorted(map(tuple, once.rows.collect())) == [("p", 0), ("q", 1)]


def test_rules_read_the_profile_twice_at_most(spark, tmp_dir):
    d = tmp_dir + "/prof"
    os.makedirs(d)
    with open(d + "/object_akp.txt", "w") as f:
        f.write("Sub;http://x/headquarter;http://dbpedia.org/ontology/City;5\nSub;http://x/residence;http://schema.org/Country;6\n"
                "Kid;http://x/residence;http://schema.org/Country;7\nSub;other;http://schema.org/City;8\n")
    with open(d + "/datatype_akp.txt", "w") as f:
        f.write("Kid;http://x/alias;text;9\n")
    sub = spark.createDataFrame([("Sub", D.ORG), ("Kid", D.PERSON)], "child string, parent string")
    eq = spark.createDataFrame([("http://x/alias", "http://y/also")], "a string, b string")
    out = D.artificial_properties(read_patterns(spark, d), D.PROFILE_RULES, sub, eq.limit(0), eq)
    assert len(D.PROFILE_RULES) == 11
    assert plan(out).count("object_akp.txt") == 1 and plan(out).count("datatype_akp.txt") == 1  # and once for the predicates
    got = {(r.subject, r.predicate, r.object, r.frequency) for r in out.collect()}
    assert ("Sub", "org:city_of_headquarters", "http://dbpedia.org/ontology/City", 5) in got
    assert ("Kid", "per:countries_of_residence", "http://schema.org/Country", 7) in got
    assert ("Kid", "per:alternate_names", "text", 9) in got
    assert not any(s == "Sub" and p.startswith("per:") for s, p, _, _ in got)


def test_deep_subclass_chain(spark):
    edges = spark.createDataFrame([(f"t{k + 1}", f"t{k}") for k in range(12)] + [("t0", "t12")], "child string, parent string")
    got = O.subtypes(spark.createDataFrame([("t0",)], "value string"), edges).collect()
    assert {r.type for r in got} == {f"t{k}" for k in range(13)}


def test_lines_are_numbered_without_moving_them(spark, tmp_dir):
    with open(tmp_dir + "/lines.txt", "w") as f:
        f.write("".join(f"line {k}\n" for k in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = lines_in_file_order(spark, tmp_dir + "/lines.txt")
        got = {r.line_no: r.value for r in lines.collect()}
        assert got == {k: f"line {k}" for k in range(4000)}
        assert "BroadcastHashJoin" in plan(lines) and "SortMergeJoin" not in plan(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pattern_counts_and_missing_fields(spark, tmp_dir):
    os.makedirs(tmp_dir + "/p")
    for name, text in (("object_akp.txt", "a;p;b;12.0\nNA;p;;7\n"), ("datatype_akp.txt", "a;q;null;3\n")):
        with open(f"{tmp_dir}/p/{name}", "w") as f:
            f.write(text)
    got = sorted((r.subject, r.predicate, r.object, r.frequency) for r in read_patterns(spark, tmp_dir + "/p").collect())
    assert got == [("a", "p", "b", 12), ("a", "q", "nan", 3), ("nan", "p", "nan", 7)]
    for bad in ("a;p;b;many\n", "a;p;b\n", "a;p;b;1.5\n"):
        with open(tmp_dir + "/p/object_akp.txt", "w") as f:
            f.write(bad)
        with pytest.raises(Exception, match="not a whole frequency"):
            read_patterns(spark, tmp_dir + "/p").collect()


def test_sentences_dumped_with_an_index_column(spark, tmp_dir):
    with open(tmp_dir + "/s.csv", "w") as f:
        f.write(',sentence,rel,e1\n0,"He said ""yes, now"" <e1> x </e1>",r, x \n1,plain,s,y\n')
    got = IO.read_sentences_csv(spark, tmp_dir + "/s.csv")
    assert got.columns == ["sentence", "rel", "e1"]
    assert [tuple(r) for r in got.collect()] == [('He said "yes, now" <e1> x </e1>', "r", " x "), ("plain", "s", "y")]


def test_space_dumped_with_an_index_column(spark, tmp_dir):
    with open(tmp_dir + "/w.csv", "w") as f:
        f.write(',0,1,add1\n"p, q",0.5,0.0,1.0\nr,0.0,0.25,0.0\nnone,0.0,0.0,0.0\n')
    space = IO.read_space_wide_csv(spark, tmp_dir + "/w.csv")
    assert sorted(map(tuple, space.rows.select("predicate", "row_order").collect())) == [("none", 2), ("p, q", 0), ("r", 1)]
    assert {tuple(r) for r in space.entries.select("predicate", "component", "value").collect()} == {("p, q", 0, 0.5), ("p, q", 2, 1.0), ("r", 1, 0.25)}
    assert {r.component: r.label for r in space.dims.collect()} == {0: "0", 1: "1", 2: "add1"}


def test_scratch_falls_back_to_the_warehouse():
    from tessera.session import checkpoint_dir

    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def getConf(self):
            return {}

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()
        conf = {"spark.sql.warehouse.dir": "file:/shared/warehouse/"}

    assert checkpoint_dir(Session()) == "file:/shared/warehouse/tessera-scratch"


def test_tampered_rows_are_reported(spark):
    space = long_space(spark, [("pa", 0, [1, 0]), ("pb", 1, [0, 1])])
    mapping = spark.createDataFrame([("ra", "pa"), ("rb", "pb")], "rel string, prop string")
    rows = spark.createDataFrame([(1, "ra"), (2, "rb"), (3, "ra")], "id bigint, rel string")
    stored = G.label_vectors(rows, mapping, space).withColumn("target", F.when(F.col("id") == 3, F.array(F.lit(9.0), F.lit(0.0))).otherwise(F.col("target")))
    assert G.check_label_vectors(stored, rows, mapping, space).first().n_mismatch == 1
    assert tuple(G.check_vector_owner(stored, space, mapping).first()) == (3, 2, 1)
    sent = spark.createDataFrame([(1, "a b"), (2, "b c d"), (3, "")], "id bigint, sentence string")
    vocab = G.build_vocabulary(sent)
    enc = G.encode_sequences(sent, vocab)
    assert G.check_encoding(enc, sent, vocab).count() == 0
    bad = enc.withColumn("input_ids", F.when(F.col("id") == 2, F.transform("input_ids", lambda x: x + 1)).otherwise(F.col("input_ids")))
    assert [r.id for r in G.check_encoding(bad, sent, vocab).collect()] == [2]
