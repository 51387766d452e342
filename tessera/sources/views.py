"""Input tables derived from the TPC-H-style test data (the FIXTURES views).

Each function reads whole parquet tables and returns the shape the
operators expect; the same derivations exist as DuckDB SQL in
``tessera.plans.oracles`` so both engines start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.functions.vectors import as_double_array
from tessera.sources.patterns import with_pair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def patterns_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-PAT without the pair column: (subject, predicate, object, frequency, src)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    obj = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey)
           .join(n, c.c_nationkey == n.n_nationkey)
           .join(p, li.l_partkey == p.p_partkey)
           .groupBy(F.col("n_name").alias("subject"), F.col("p_name").alias("predicate"),
                    F.col("p_type").alias("object"))
           .agg(F.count(F.lit(1)).alias("frequency"))
           .withColumn("src", F.lit(0)))
    ev = table(spark, sf_dir, "events")
    dt = (ev.groupBy(F.concat(F.lit("user"), (F.col("user_id") % 25).cast("string")).alias("subject"),
                     F.col("event_type").alias("predicate"),
                     F.concat(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1)).alias("object"))
          .agg(F.count(F.lit(1)).alias("frequency"))
          .withColumn("src", F.lit(1)))
    return obj.unionByName(dt).select("subject", "predicate", "object", "frequency", "src")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-PAT: (subject, predicate, object, frequency, pair, src)."""
    return with_pair(patterns_unpaired(spark, sf_dir)).select(
        "subject", "predicate", "object", "frequency", "pair", "src")


def pair_set_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-SETS: predicates (priority/status) over (segment, nation) pairs."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .groupBy(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("predicate"),
                     F.concat("c_mktsegment", F.lit("#-#"), "n_name").alias("pair"))
            .agg(F.count(F.lit(1)).alias("frequency")))


def subclass_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-ONTO: (child, parent): nation -> region, customer -> nation."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer")
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("child"),
                                                         F.col("r_name").alias("parent"))
    b = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("child"),
                                                         F.col("n_name").alias("parent"))
    return a.unionByName(b)


def equivalent_class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EQ (classes): (a, b) = (nation name, supplier name)."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("a"), F.col("s_name").alias("b")).distinct())


def equivalent_property_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EQ (properties): (a, b) = (part name, brand)."""
    return (table(spark, sf_dir, "part")
            .select(F.col("p_name").alias("a"), F.col("p_brand").alias("b")).distinct())


def resource_label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-LAB: (resource, label, lang) from documents."""
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 97).cast("string").alias("resource"),
        F.col("source").alias("label"), F.col("lang"))


SENTENCE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                "l_quantity", "relation"]


def marked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-SENT: one marked sentence per line item plus its full order key."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_discount")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    # orders meet their customers first, so that the line items move once for both
    named = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")
    j = li.join(named, li.l_orderkey == named.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    direction = F.when(F.col("l_linenumber") % 2 == 0, F.lit("(e1,e2)")).otherwise(F.lit("(e2,e1)"))
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        F.concat(F.lit(" <e1> "), "c_name", F.lit(" </e1> bought the <e2> "), "p_name",
                 F.lit(" </e2> . ")).alias("sentence"),
        F.when(F.col("l_discount") == 0, F.lit("no_relation"))
         .otherwise(F.concat(F.lit("rel:"), F.lower("p_type"), direction)).alias("relation"))


def sentence_order(df: DataFrame) -> DataFrame:
    """Adds ``ord``, the struct order key used for first/last occurrence."""
    return df.withColumn("ord", F.struct(*SENTENCE_KEY))


# Fixed values of the F-TAGS rule (token -> tag); any other token is "O".
TAG_WORDS = {
    "COLOR": ["red", "blue"],
    "SIZE": ["small", "large"],
    "AGE": ["old", "new"],
    "TEMP": ["hot", "cold"],
    "PRODUCT": ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"],
}


def tag_expr(tok):
    e = F.when(tok.startswith("Customer#"), F.lit("PERSON"))
    for tag, words in TAG_WORDS.items():
        e = e.when(tok.isin(words), F.lit(tag))
    return e.otherwise(F.lit("O"))


def token_tags(sentences: DataFrame, key: str = "sentence") -> DataFrame:
    """F-TAGS: (key, pos, token, tag) for the marker-free tokens."""
    clean = F.col("sentence")
    for m in ("<e1>", "</e1>", "<e2>", "</e2>"):
        clean = F.replace(clean, F.lit(m), F.lit(""))
    return (sentences.select(key, F.posexplode(tokens(clean)).alias("pos", "token"))
            .withColumn("tag", tag_expr(F.col("token"))))


def token_tag_arrays(sentences: DataFrame, key: str = "sentence") -> DataFrame:
    """F-TAGS as one array per sentence: (key, tags), tag i for token i."""
    clean = F.col("sentence")
    for m in ("<e1>", "</e1>", "<e2>", "</e2>"):
        clean = F.replace(clean, F.lit(m), F.lit(""))
    return sentences.select(key, F.transform(tokens(clean), tag_expr).alias("tags"))


def relation_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-MAP: rel:<type> -> prop:<type> plus no_relation."""
    types = table(spark, sf_dir, "part").select(F.lower("p_type").alias("t")).distinct()
    m = types.select(F.concat(F.lit("rel:"), "t").alias("rel"),
                     F.concat(F.lit("prop:"), "t").alias("prop"))
    return m.unionByName(m.sparkSession.range(1).select(F.lit("no_relation").alias("rel"),
                                                        F.lit("no_relation").alias("prop")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EMB rows: (vec_id, vec array<double>, label, rel, prop, batch_id,
    gate).  ``rel`` is ``no_relation`` for label 0, else ``rel<label>``;
    ``prop`` is ``P<label>``; ``gate`` follows F-GATE."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", as_double_array("embedding").alias("vec"), "label",
        F.when(F.col("label") == 0, F.lit("no_relation"))
         .otherwise(F.concat(F.lit("rel"), F.col("label").cast("string"))).alias("rel"),
        F.concat(F.lit("P"), F.col("label").cast("string")).alias("prop"),
        F.floor(F.col("vec_id") / 128).cast("bigint").alias("batch_id"),
        (1.0 / (1.0 + F.exp(-10.0 * F.col("embedding")[0].cast("double")))).alias("gate"))


def vector_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EMB space, long form: (predicate, row_order, component, value) =
    mean vector of every label."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select("label", F.posexplode("embedding").alias("component", "v"))
    return (x.groupBy("label", "component").agg(F.avg(F.col("v").cast("double")).alias("value"))
            .select(F.concat(F.lit("P"), F.col("label").cast("string")).alias("predicate"),
                    F.col("label").cast("bigint").alias("row_order"),
                    F.col("component").cast("bigint").alias("component"), "value"))


def vector_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EMB relation mapping (rel, prop), one row per label."""
    return vectors(spark, sf_dir).select("rel", "prop").distinct()
