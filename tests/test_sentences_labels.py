import os

import pytest

from conftest import rows
from tessera.operators import labels as G
from tessera.operators import sentences as SF
from tessera.sources.records import dedupe_last_label, read_marked_records


def test_worked_record_and_unterminated_last_record(spark, tmp_dir):
    os.makedirs(tmp_dir + "/r", exist_ok=True)
    text = ('7\t" Norland plans to rent <e1> dairy union </e1> <e2> Brelk </e2> . "\n'
            "org:alternate_names(e2,e1)\nComment:\n\n"
            '8\t" no tab here"\nno_relation\nComment:\n')  # second record lacks its 4th line
    with open(tmp_dir + "/r/part.txt", "w") as f:
        f.write(text)
    recs = read_marked_records(spark, tmp_dir + "/r")
    got = recs.collect()
    assert len(got) == 1
    s = SF.strip_direction(SF.extract_entity(SF.extract_entity(recs, "e1"), "e2")).first()
    assert s["sentence"] == " Norland plans to rent <e1> dairy union </e1> <e2> Brelk </e2> . "
    assert (s["rel"], s["e1"], s["e2"]) == ("org:alternate_names", " dairy union ", " Brelk ")


def test_record_without_tab_starts_at_second_char(spark, tmp_dir):
    os.makedirs(tmp_dir + "/r2", exist_ok=True)
    with open(tmp_dir + "/r2/part.txt", "w") as f:
        f.write('abcdef"\nrel\nC\n\n')
    assert read_marked_records(spark, tmp_dir + "/r2").first()["sentence"] == "bcdef"


def test_dedupe_keeps_first_position_last_label(spark):
    df = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2), ("s1", "c", 3)], "sentence string, relation string, ord int")
    assert rows(dedupe_last_label(df)) == [("s1", 1, "c"), ("s2", 2, "b")]


def test_strip_direction_and_entities(spark):
    df = spark.createDataFrame([("a <e1> x </e1> b </e1> <e2> y </e2>", "per:title(e1,e2)"),
                                ("no markers", "no_relation")], "sentence string, relation string")
    out = SF.extract_entity(SF.strip_direction(df), "e1", on_missing="null").collect()
    got = {r["relation"]: (r["rel"], r["e1"]) for r in out}
    assert got["per:title(e1,e2)"] == ("per:title", " x </e1> b ")  # greedy, last closing tag
    assert got["no_relation"] == ("no_relation", None)
    with pytest.raises(Exception):
        SF.extract_entity(df, "e1").collect()


def spans(spark, sentence, order_safe=False):
    df = spark.createDataFrame([(sentence,)], "sentence string")
    r = SF.entity_spans(df, order_safe).first()
    return r["e1_start"], r["e1_end"], r["e2_start"], r["e2_end"]


def test_entity_spans_offsets(spark):
    assert spans(spark, "A <e1> B C </e1> D <e2> E </e2>") == (1, 2, 4, 4)
    assert spans(spark, "nothing  here") == (0, 0, 0, 0)
    # e2 before e1: the fixed offsets are wrong, order_safe counts the markers seen
    assert spans(spark, "<e2> X </e2> <e1> Y </e1>") == (3, 3, -2, -2)
    assert spans(spark, "<e2> X </e2> <e1> Y </e1>", True) == (1, 1, 0, 0)
    # a repeated marker: the last one wins
    assert spans(spark, "<e1> a <e1> b </e1>") == (2, 2, 0, 0)


def test_entity_types_first_and_last_token_only(spark):
    sent = spark.createDataFrame([("s", 0, 2, 3, 9)], "sentence string, e1_start int, e1_end int, e2_start int, e2_end int")
    tags = spark.createDataFrame([("s", 0, "PER"), ("s", 1, "ORG"), ("s", 2, "O"), ("s", 3, "LOC")],
                                 "sentence string, pos int, tag string")
    out = SF.types_as_csv(SF.entity_types(sent, tags)).first()
    assert (out["e1_type_CNLP"], out["e2_type_CNLP"]) == ("PER", "LOC")


def test_integer_labels_use_first_index_of_sorted_values(spark):
    m = spark.createDataFrame([("r1", "b"), ("r2", "a"), ("r3", "b"), ("r4", "c")], "rel string, prop string")
    from tessera.operators.scoring import integer_labels
    assert rows(integer_labels(m), "rel", "int_label") == [("r1", 1), ("r2", 0), ("r3", 1), ("r4", 3)]


def test_unmapped_relation(spark):
    s = spark.createDataFrame([("x", "known"), ("y", "unknown")], "sentence string, rel string")
    m = spark.createDataFrame([("known", "P")], "rel string, prop string")
    assert G.unmapped_count(s, m).first()["n_unmapped"] == 1
    assert rows(G.map_relations(s, m, "null"), "rel", "prop") == [("known", "P"), ("unknown", None)]
    with pytest.raises(Exception):
        G.map_relations(s, m).collect()


def test_encode_sequences_pads_to_longest_and_truncates(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "c c c c c c c c c")], "id int, sentence string")
    vocab = G.build_vocabulary(df)
    v = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert v == {"c": 4, "a": 5, "b": 6}
    enc = {r["id"]: r for r in G.encode_sequences(df, vocab, max_length=5).collect()}
    assert enc[1]["input_ids"] == [2, 5, 6, 5, 3]
    assert enc[2]["input_ids"] == [2, 6, 3, 0, 0] and enc[2]["attention_mask"] == [1, 1, 1, 0, 0]
    assert enc[3]["input_ids"] == [2, 4, 4, 4, 3]
    assert G.check_encoding(G.encode_sequences(df, vocab, max_length=5), df, vocab, max_length=5).count() == 0


def test_mini_batches_cover_all_rows(spark):
    df = spark.range(0, 300).withColumnRenamed("id", "id")
    b = G.mini_batches(df, 128, seed=3).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in b) == [44, 128, 128]
