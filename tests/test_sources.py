import pytest
import os

from conftest import rows
from tessera.sources import io as IO


def test_property_list_stops_at_first_blank_line(spark, tmp_dir):
    d = tmp_dir + "/plist"
    os.makedirs(d)
    with open(d + "/list.txt", "w") as f:
        f.write("http://x/a  \nhttp://x/b\n   \nhttp://x/c\n")
    assert rows(IO.read_property_list(spark, d), "row_order", "predicate") == [(0, "http://x/a"), (1, "http://x/b")]


def test_property_list_without_blank_keeps_all(spark, tmp_dir):
    d = tmp_dir + "/plist2"
    os.makedirs(d)
    with open(d + "/list.txt", "w") as f:
        f.write("p1\np2\np3")
    assert rows(IO.read_property_list(spark, d), "row_order", "predicate") == [(0, "p1"), (1, "p2"), (2, "p3")]


def test_mapping_json_round_trip(spark, tmp_dir):
    d = tmp_dir + "/map"
    os.makedirs(d)
    with open(d + "/m.json", "w") as f:
        f.write('{\n\t"org:top_members/employees": "org:top_members_employees",\n\t"no_relation": "no_relation"\n}\n')
    m = IO.read_mapping(spark, d)
    assert rows(m, "rel", "prop") == [("no_relation", "no_relation"),
                                       ("org:top_members/employees", "org:top_members_employees")]
    IO.write_mapping(m, tmp_dir + "/map2")
    assert rows(IO.read_mapping(spark, tmp_dir + "/map2")) == rows(m)


def test_sentence_csv_keeps_blanks_and_reads_empty_types_as_missing(spark, tmp_dir):
    df = spark.createDataFrame([("s <e1> a </e1>", " a ", "PER", ""), ("t", " b", "", "LOC")],
                               "sentence string, e1 string, e1_type_CNLP string, e2_type_CNLP string")
    IO.write_sentences_csv(df, tmp_dir + "/csv")
    back = IO.read_sentences_csv(spark, tmp_dir + "/csv")
    assert rows(back) == [("s <e1> a </e1>", " a ", "PER", None), ("t", " b", None, "LOC")]


def test_wide_space_csv_round_trip(spark, tmp_dir):
    from conftest import pat_df
    from tessera.operators import space as SP
    space = SP.build_space(pat_df(spark, [("a", "p", "x", 3), ("a", "p", "y", 1), ("b", "q", "x", 2)]),
                           ["p", "q", "none"], None)
    IO.write_space_wide_csv(space, tmp_dir + "/wide")
    back = IO.read_space_wide_csv(spark, tmp_dir + "/wide")
    assert rows(back.long()) == rows(space.long())


def test_line_numbers_across_file_splits(spark, tmp_dir):
    from tessera.functions.index import lines_in_file_order
    from tessera.sources.records import read_marked_records
    d = tmp_dir + "/big"
    os.makedirs(d)
    lines = [f"line {i:04d} " + "x" * (i % 13) for i in range(400)]
    with open(d + "/one.txt", "w") as f:
        f.write("\n".join(lines) + "\n")
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # many splits of one file
    try:
        df = lines_in_file_order(spark, d)
        assert spark.read.text(d).rdd.getNumPartitions() > 10  # the scan really is split
        got = sorted((r["line_no"], r["value"]) for r in df.collect())
        assert got == list(enumerate(lines))
        recs = []
        for i in range(25):
            recs += [f'{i}\t" sentence {i} "', f"rel{i % 3}", "Comment:", ""]
        os.makedirs(tmp_dir + "/recs")
        with open(tmp_dir + "/recs/r.txt", "w") as f:
            f.write("\n".join(recs) + "\n")
        r = read_marked_records(spark, tmp_dir + "/recs")
        assert sorted((x["rec_id"], x["sentence"], x["relation"]) for x in r.collect()) == [
            (i, f" sentence {i} ", f"rel{i % 3}") for i in range(25)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)


@pytest.mark.parametrize("master, folder, refused", [
    ("local[8]", "file:/home/u/spark-warehouse/x", False), ("local", "/tmp/x", False),
    ("yarn", "file:/home/u/spark-warehouse/x", True), ("spark://host:7077", "/data/x", True),
    ("k8s://https://host", "spark-warehouse/x", True), ("yarn", "hdfs://name/x", False),
    ("yarn", "s3a://bucket/x", False)])
def test_scratch_on_one_machines_disk_is_refused_on_a_cluster(master, folder, refused):
    from tessera.session import refuse_own_disk
    if refused:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            refuse_own_disk(master, folder)
    else:
        refuse_own_disk(master, folder)
