"""Registered queries: one per operator of the inventory, each reading the
whole test tables through the FIXTURES views.  Parameters follow
FIXTURES.md (noise keyword ``widget``, n=16 for B5, n=125 for C13-C15,
...).  Every computed column carries the same alias as its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cleaning as B
from tessera.operators import explore as C
from tessera.operators import sentences as SF
from tessera.sources import views as V
from tessera.sources.patterns import with_pair
from tessera.sources.records import dedupe_last_label

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PAT_COLS = ["subject", "predicate", "object", "frequency", "pair", "src"]
NOISE_KW = "widget"


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def pat(spark, sf):
    return V.patterns(spark, sf)


# ------------------------------------------------------------------ B
@query("b1_with_pair")
def _b1(spark, sf):
    return with_pair(V.patterns_unpaired(spark, sf)).select(*PAT_COLS)


@query("b2_drop_keyword_predicates")
def _b2(spark, sf):
    return B.drop_keyword_predicates(pat(spark, sf), NOISE_KW).select(*PAT_COLS)


@query("b3_drop_rare_pairs")
def _b3(spark, sf):
    return B.drop_rare_pairs(pat(spark, sf), 1).select(*PAT_COLS)


@query("b4_drop_infrequent")
def _b4(spark, sf):
    return B.drop_infrequent(pat(spark, sf), 10).select(*PAT_COLS)


@query("b5_drop_small_predicates")
def _b5(spark, sf):
    return B.drop_small_predicates(pat(spark, sf), 16).select(*PAT_COLS)


@query("b6_clean")
def _b6(spark, sf):
    return B.clean(pat(spark, sf), kw=NOISE_KW).select(*PAT_COLS)


@query("b7_clean_from_summary")
def _b7(spark, sf):
    return B.clean_from_summary(pat(spark, sf), kw=NOISE_KW).select(*PAT_COLS)


# ------------------------------------------------------------------ C
@query("c1_predicate_distribution")
def _c1(spark, sf):
    return C.predicate_distribution(pat(spark, sf))


@query("c2_rare_patterns")
def _c2(spark, sf):
    return C.rare_patterns(pat(spark, sf)).select(*PAT_COLS)


@query("c3_single_pattern_predicates")
def _c3(spark, sf):
    return C.single_pattern_predicates(pat(spark, sf))


@query("c4_single_rare_predicates")
def _c4(spark, sf):
    return C.single_rare_predicates(pat(spark, sf))


@query("c5_unrepeated_pairs")
def _c5(spark, sf):
    return C.unrepeated_pairs(pat(spark, sf))


@query("c6_profile_summary")
def _c6(spark, sf):
    return C.profile_summary(pat(spark, sf))


@query("c7_removal_impact")
def _c7(spark, sf):
    return C.removal_impact(pat(spark, sf))


@query("c8_impact_histogram_sum")
def _c8a(spark, sf):
    return C.impact_histogram(C.removal_impact(pat(spark, sf)), "sum_delta_pct", 40)


@query("c8_impact_histogram_size")
def _c8b(spark, sf):
    return C.impact_histogram(C.removal_impact(pat(spark, sf)), "size_delta_pct", 10)


@query("c9_impact_extremes")
def _c9(spark, sf):
    return C.impact_extremes(C.removal_impact(pat(spark, sf)), 90, 10)


@query("c10_namespace_share")
def _c10(spark, sf):
    return C.namespace_share(C.touched_predicates(pat(spark, sf)), "ring")


@query("c11_lookup_predicate")
def _c11(spark, sf):
    return C.lookup_predicate(pat(spark, sf), "red bolt").select(*PAT_COLS)


@query("c12_list_predicates")
def _c12(spark, sf):
    return C.list_predicates(pat(spark, sf), "ring")


@query("c13_predicates_with_n_patterns")
def _c13(spark, sf):
    return C.predicates_with_n_patterns(V.pair_set_patterns(spark, sf), 125)


@query("c14_pair_sets")
def _c14(spark, sf):
    sets = V.pair_set_patterns(spark, sf)
    ps = C.pair_sets(sets, C.predicates_with_n_patterns(sets, 125))
    return ps.select("predicate", F.array_join("pairs", "|").alias("pair_list"),
                     F.size("pairs").cast("bigint").alias("n_pairs"))


@query("c15_equal_pair_sets")
def _c15(spark, sf):
    return C.equal_pair_sets(V.pair_set_patterns(spark, sf), 125)


def deduped_sentences(spark, sf):
    return dedupe_last_label(V.sentence_order(V.marked_sentences(spark, sf)))


@query("c16_relation_counts")
def _c16(spark, sf):
    return C.relation_counts(SF.strip_direction(deduped_sentences(spark, sf)))


# ------------------------------------------------------------------ E
from tessera.operators import similarity as ES  # noqa: E402
from tessera.operators import space as SP  # noqa: E402

PROPERTY_LIST = ["red bolt", "hot ring", "cold gear", "old rod", "no such name"]
CLONES = ["red bolt_@1", "red bolt_@2"]


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _long6(space):
    return space.long().select("predicate", "row_order", "component", _r6("value"))


def global_space(spark, sf):
    """E1 -> E2 -> E3 over every predicate of F-PAT (rows in predicate order)."""
    return SP.full_space(SP.probabilities(pat(spark, sf)))


def listed_space(spark, sf):
    g = global_space(spark, sf)
    return SP.restrict_to(g, PROPERTY_LIST)


@query("e1_probabilities")
def _e1(spark, sf):
    return SP.probabilities(pat(spark, sf)).select(*PAT_COLS, "tot", _r6("prob"))


@query("e2_dimensions")
def _e2(spark, sf):
    return SP.dimensions(pat(spark, sf))


@query("e3_vectorise")
def _e3(spark, sf):
    p = SP.probabilities(pat(spark, sf))
    return SP.vectorise(p, SP.dimensions(p)).select("predicate", "component", _r6("value"))


@query("e4_restrict_to")
def _e4(spark, sf):
    return _long6(listed_space(spark, sf))


@query("e5_drop_zero_dims")
def _e5(spark, sf):
    return _long6(SP.drop_zero_dims(listed_space(spark, sf)))


@query("e6_disambiguate")
def _e6(spark, sf):
    return _long6(SP.disambiguate(SP.drop_zero_dims(listed_space(spark, sf)), CLONES))


@query("e7_add_constant_row")
def _e7(spark, sf):
    s = SP.disambiguate(SP.drop_zero_dims(listed_space(spark, sf)), CLONES)
    return _long6(SP.add_constant_row(s, "no_relation", -1.0))


@query("e8_to_wide")
def _e8(spark, sf):
    """The wide table, read back as (predicate, component, value)."""
    wide = SP.to_wide(SP.build_space(pat(spark, sf), PROPERTY_LIST, CLONES), max_cols=5000)
    return SP.to_long(wide).select("predicate", "component", _r6("value"))


@query("e9_row_sums")
def _e9(spark, sf):
    return SP.row_sums(SP.build_space(pat(spark, sf), PROPERTY_LIST, CLONES)).select(
        "predicate", "row_order", _r6("row_sum"))


@query("e10_build_space")
def _e10(spark, sf):
    return _long6(SP.build_space(pat(spark, sf), PROPERTY_LIST, CLONES))


@query("e10_space_dims")
def _e10d(spark, sf):
    return SP.build_space(pat(spark, sf), PROPERTY_LIST, CLONES).dims


@query("e11_pair_similarity")
def _e11(spark, sf):
    return ES.pair_similarity(global_space(spark, sf), "red bolt", "hot ring")


@query("e12_similarities")
def _e12(spark, sf):
    return ES.similarities(global_space(spark, sf), "red bolt")


@query("e13_top_similar")
def _e13(spark, sf):
    return ES.top_similar(global_space(spark, sf), "red bolt", k=10)


@query("e14_all_pairs_similarity")
def _e14(spark, sf):
    return ES.all_pairs_similarity(global_space(spark, sf), 10)


@query("e15_pca")
def _e15(spark, sf):
    return ES.pca(global_space(spark, sf), 2)


@query("e15_pca_residual")
def _e15r(spark, sf):
    """What is left of the equations of the first two components."""
    space = global_space(spark, sf)
    return ES.pca_residual(space, ES.pca(space, 2), 2)


# ------------------------------------------------------------------ D
from tessera.operators import derive as D  # noqa: E402
from tessera.operators import ontology as O  # noqa: E402

FIXTURE_RULES = [
    D.Rule("x:ring_africa", ["ring"], ["AFRICA"], objects=["SMALL", "ECONOMY"]),
    D.Rule("x:bolt_europe", ["bolt"], ["EUROPE"]),
    D.Rule("x:gear_rod_asia", ["gear rod"], ["ASIA"], objects=["PROMO", "STANDARD"]),
]


def _roots(spark, names):
    return O.values_frame(spark, names)


@query("d1_filter_exact")
def _d1(spark, sf):
    return D.filter_exact(pat(spark, sf), "predicate", ["red bolt", "hot ring", "no such"]).select(*PAT_COLS)


@query("d2_filter_contains")
def _d2(spark, sf):
    return D.filter_contains(pat(spark, sf), "predicate", ["ring", "bolt"]).select(*PAT_COLS)


@query("d3_equivalent_properties")
def _d3(spark, sf):
    preds = D.filter_contains(pat(spark, sf), "predicate", ["ring"]).select(F.col("predicate").alias("value"))
    return O.equivalent_properties(preds, V.equivalent_property_edges(spark, sf))


@query("d4_approximate_match")
def _d4(spark, sf):
    return D.approximate_match(pat(spark, sf), ["ring", "bolt"], "predicate",
                               V.equivalent_property_edges(spark, sf))


@query("d5_subtypes")
def _d5(spark, sf):
    return O.subtypes(_roots(spark, ["AFRICA"]), V.subclass_edges(spark, sf))


@query("d6_equivalent_classes")
def _d6(spark, sf):
    types = O.subtypes(_roots(spark, ["AFRICA"]), V.subclass_edges(spark, sf)).select(
        F.col("type").alias("value"))
    return O.equivalent_classes(types, V.equivalent_class_edges(spark, sf))


@query("d7_subtypes_match")
def _d7(spark, sf):
    return O.subtypes_match(_roots(spark, ["AFRICA"]), V.subclass_edges(spark, sf),
                            V.equivalent_class_edges(spark, sf))


@query("d8_resource_labels")
def _d8(spark, sf):
    lab = V.resource_label_table(spark, sf)
    return O.resource_labels(lab.select("resource"), lab, "es")


@query("d9_artificial_property")
def _d9(spark, sf):
    p = pat(spark, sf)
    preds = D.approximate_match(p, ["ring", "bolt"], "predicate", V.equivalent_property_edges(spark, sf))
    subs = O.subtypes_match(_roots(spark, ["AFRICA"]), V.subclass_edges(spark, sf),
                            V.equivalent_class_edges(spark, sf))
    return D.artificial_property(p, "x:ringbolt", preds, subs, ["ECONOMY", "SMALL"])


def fixture_artificial(spark, sf):
    return D.artificial_properties(pat(spark, sf), FIXTURE_RULES, V.subclass_edges(spark, sf),
                                   V.equivalent_class_edges(spark, sf),
                                   V.equivalent_property_edges(spark, sf))


@query("d10_artificial_properties")
def _d10(spark, sf):
    return fixture_artificial(spark, sf)


def profile_view(spark, sf):
    """F-PAT in the words of the shipped rules: keywords in the predicates,
    class IRIs among the objects, regions below the root classes."""
    word = F.split_part("predicate", F.lit(" "), F.lit(2))
    predicate = F.concat(F.lit("http://x/"), F.when(word == "bolt", "headquarter").when(word == "ring", "residence")
                         .when(word == "gear", "aliasName").when(word == "rod", "memberOf").otherwise("other"))
    obj = (F.when(F.col("object") == "SMALL", D.CITY[0]).when(F.col("object") == "ECONOMY", D.COUNTRY[1])
           .when(F.col("object") == "PROMO", D.REGION[2]).when(F.col("object") == "STANDARD", "FRANCE").otherwise("KENYA"))
    rows = pat(spark, sf).filter("src = 0").withColumns({"predicate": predicate, "object": obj})
    roots = spark.createDataFrame([("AFRICA", D.ORG), ("EUROPE", D.PERSON)], "child string, parent string")
    return with_pair(rows), V.subclass_edges(spark, sf).unionByName(roots)


@query("d10_profile_rules")
def _d10p(spark, sf):
    """All shipped rules at once."""
    rows, subclass = profile_view(spark, sf)
    return D.artificial_properties(rows, D.PROFILE_RULES, subclass)


@query("d11_extend_profile")
def _d11(spark, sf):
    return D.extend_profile(B.clean(pat(spark, sf), kw=NOISE_KW), fixture_artificial(spark, sf))


# ------------------------------------------------------------------ F
def sentences_with_rel(spark, sf):
    return SF.strip_direction(deduped_sentences(spark, sf))


def fixture_tags(spark, sf):
    """Tagger output for the deduped sentences, one tag array per sentence."""
    return V.token_tag_arrays(deduped_sentences(spark, sf))


@query("f1_strip_direction")
def _f1(spark, sf):
    return sentences_with_rel(spark, sf).select("sentence", "relation", "rel")


@query("f2_extract_entity")
def _f2(spark, sf):
    s = SF.extract_entity(SF.extract_entity(deduped_sentences(spark, sf), "e1"), "e2")
    return s.select("sentence", "e1", "e2")


@query("f3_strip_markers")
def _f3(spark, sf):
    return SF.strip_markers(deduped_sentences(spark, sf)).select("sentence", "clean")


SPAN_COLS = ["e1_start", "e1_end", "e2_start", "e2_end"]


@query("f4_entity_spans")
def _f4(spark, sf):
    s = SF.entity_spans(deduped_sentences(spark, sf))
    return s.select("sentence", *[F.col(c).cast("bigint").alias(c) for c in SPAN_COLS])


@query("f5_entity_types")
def _f5(spark, sf):
    s = SF.entity_types(SF.entity_spans(deduped_sentences(spark, sf)), fixture_tags(spark, sf))
    return s.select("sentence", F.size("e1_types").cast("bigint").alias("n_e1_types"),
                    F.size("e2_types").cast("bigint").alias("n_e2_types"))


@query("f6_types_as_csv")
def _f6(spark, sf):
    s = SF.entity_types(SF.entity_spans(deduped_sentences(spark, sf)), fixture_tags(spark, sf))
    return SF.types_as_csv(s).select("sentence", "e1_type_CNLP", "e2_type_CNLP")


@query("f7_prepare_sentences")
def _f7(spark, sf):
    recs = V.sentence_order(V.marked_sentences(spark, sf)).select("sentence", "relation", "ord")
    return SF.prepare_sentences(recs, fixture_tags(spark, sf))


# ------------------------------------------------------------------ G / H (vectors)
from tessera.operators import fits as FT  # noqa: E402
from tessera.operators import network as NW  # noqa: E402
from tessera.operators import labels as G  # noqa: E402
from tessera.operators import metrics as M  # noqa: E402
from tessera.operators import scoring as H  # noqa: E402

VID = ["vec_id"]


def vec_rows(spark, sf):
    return V.vectors(spark, sf)


def vec_space(spark, sf):
    return H.space_from_long(V.vector_space(spark, sf))


def vec_mapping(spark, sf):
    return V.vector_mapping(spark, sf)


def with_targets(spark, sf):
    """Vectors with their label vector, flags and gate (the H4-H8 input)."""
    lv = G.label_vectors(vec_rows(spark, sf), vec_mapping(spark, sf), vec_space(spark, sf))
    return G.no_relation_flag(lv)


def sentence_frame(spark, sf):
    return sentences_with_rel(spark, sf).select("sentence", "rel")


@query("g1_map_relations")
def _g1(spark, sf):
    return G.map_relations(sentence_frame(spark, sf), V.relation_mapping(spark, sf)).select(
        "sentence", "rel", "prop")


@query("g1_unmapped_count")
def _g1b(spark, sf):
    return G.unmapped_count(sentence_frame(spark, sf), V.relation_mapping(spark, sf))


@query("g2_integer_labels")
def _g2(spark, sf):
    return H.integer_labels(V.relation_mapping(spark, sf)).select("rel", "prop", "int_label")


@query("g3_no_relation_flag")
def _g3(spark, sf):
    return G.no_relation_flag(sentence_frame(spark, sf)).select("sentence", "rel", "is_no_relation", "attribute")


@query("g4_label_vectors")
def _g4(spark, sf):
    lv = G.label_vectors(vec_rows(spark, sf), vec_mapping(spark, sf), vec_space(spark, sf))
    return lv.select("vec_id", F.posexplode("target").alias("component", "value")).select(
        "vec_id", F.col("component").cast("bigint").alias("component"), _r6("value"))


def onehot_space(spark, sf):
    il = H.integer_labels(V.relation_mapping(spark, sf))
    return H.space_from_long(il.select(F.col("prop").alias("predicate"), F.col("int_label").alias("row_order"),
                                       F.col("int_label").alias("component"), F.lit(1.0).alias("value")))


def _joined(*cols):
    """Arrays of numbers as text, which both engines compare alike."""
    return [F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",").alias(c) for c in cols]


@query("g5_training_rows")
def _g5(spark, sf):
    s = sentence_frame(spark, sf).withColumn("id", F.col("sentence"))
    vocab = G.build_vocabulary(s)
    rows = G.training_rows(s, V.relation_mapping(spark, sf), onehot_space(spark, sf), vocab)
    return rows.select("id", *_joined("input_ids", "attention_mask", "target"), "rel", "prop",
                       F.col("int_label").cast("bigint").alias("int_label"), "is_no_relation", "attribute")


def tampered(stored, id_expr):
    """Every seventh stored label vector is changed in its first number."""
    first = F.concat(F.array(F.element_at("target", 1) + 1), F.slice("target", 2, F.size("target")))
    return stored.withColumn("target", F.when(F.expr(id_expr) % 7 == 0, first).otherwise(F.col("target")))


@query("g6_check_label_vectors")
def _g6(spark, sf):
    stored = G.label_vectors(vec_rows(spark, sf), vec_mapping(spark, sf), vec_space(spark, sf))
    return G.check_label_vectors(tampered(stored, "vec_id"), vec_rows(spark, sf), vec_mapping(spark, sf), vec_space(spark, sf),
                                 id_col="vec_id")


@query("g7_check_nearest")
def _g7(spark, sf):
    out = G.check_nearest(vec_rows(spark, sf), vec_space(spark, sf), VID)
    return out.select("vec_id", "prop", "nearest", _r6("vec_sum"), _r6("sim"))


@query("g8_encode_sequences")
def _g8(spark, sf):
    s = sentence_frame(spark, sf).withColumn("id", F.col("sentence"))
    return G.encode_sequences(s, G.build_vocabulary(s)).select("id", *_joined("input_ids", "attention_mask"))


@query("g9_build_vocabulary")
def _g9(spark, sf):
    return G.build_vocabulary(sentence_frame(spark, sf))


@query("g10_check_encoding")
def _g10(spark, sf):
    s = sentence_frame(spark, sf).withColumn("id", F.col("sentence"))
    vocab = G.build_vocabulary(s)
    stored = G.encode_sequences(s, vocab)
    changed = F.transform("input_ids", lambda x: x + 1)  # in a slice of the rows
    stored = stored.withColumn("input_ids", F.when(F.length("id") % 7 == 0, changed).otherwise(F.col("input_ids")))
    return G.check_encoding(stored, s, vocab)


@query("g11_check_vector_owner")
def _g11(spark, sf):
    stored = G.label_vectors(vec_rows(spark, sf), vec_mapping(spark, sf), vec_space(spark, sf))
    return G.check_vector_owner(tampered(stored, "vec_id"), vec_space(spark, sf), vec_mapping(spark, sf), id_col="vec_id")


@query("g12_corruption_check")
def _g12(spark, sf):
    space = vec_space(spark, sf)
    stored = G.label_vectors(vec_rows(spark, sf), vec_mapping(spark, sf), space).select(
        "vec_id", F.col("target").alias("vec"))
    parts = []
    for name, vecs in (("label_vectors", stored), ("embeddings", vec_rows(spark, sf).select("vec_id", "vec"))):
        c = G.corruption_check(vecs, space, VID)
        parts.append(c.agg(F.count(F.lit(1)).alias("n_checked"),
                           F.count_if("corrupt").alias("n_corrupt")).withColumn("source", F.lit(name)))
    return parts[0].unionByName(parts[1]).select("source", "n_checked", "n_corrupt")


@query("g13_mini_batches")
def _g13(spark, sf):
    return G.mini_batches(vec_rows(spark, sf).select("vec_id", "rel"), 128, 7, "vec_id")


@query("h1_nearest_property")
def _h1(spark, sf):
    n = H.nearest_property(vec_rows(spark, sf).select("vec_id", "vec"), vec_space(spark, sf), VID)
    return n.select("vec_id", "nearest", F.col("nearest_order").cast("bigint").alias("nearest_order"), _r6("sim"))


def gated(spark, sf):
    return H.gated_predict(vec_rows(spark, sf), vec_space(spark, sf), vec_mapping(spark, sf), VID)


@query("h2_gated_predict")
def _h2(spark, sf):
    return gated(spark, sf).select("vec_id", F.col("rel").alias("y_true"), "y_pred")


@query("h2_gated_predict_scattered")
def _h2s(spark, sf):
    """H2 on a space whose row orders have wide gaps, by the inverted index."""
    s = vec_space(spark, sf)
    wide = H.Space(s.rows.withColumn("row_order", F.col("row_order") * 1009 + 300), s.entries, s.dims)
    p = H.gated_predict(vec_rows(spark, sf), wide, vec_mapping(spark, sf), VID, max_entries=0)
    return p.select("vec_id", F.col("rel").alias("y_true"), "y_pred")


@query("i5_nearest_all_predicates")
def _i5(spark, sf):
    """Nearest row among all rows of a space, none of them mapped: customers
    by nation and balance, row orders with gaps; suppliers ask."""
    c = V.table(spark, sf, "customer").select(
        F.col("c_name").alias("predicate"), (F.col("c_custkey") * 3).cast("bigint").alias("row_order"),
        F.explode(F.array(F.struct(F.col("c_nationkey").cast("bigint").alias("component"), F.lit(1.0).alias("value")),
                          F.struct(F.lit(25).cast("bigint").alias("component"),
                                   (F.col("c_acctbal").cast("double") / 10000).alias("value")))).alias("e"))
    space = H.space_from_long(c.select("predicate", "row_order", "e.component", "e.value"))
    nation = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.when(i == F.col("s_nationkey"), 1.0).otherwise(0.0))
    ask = V.table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(nation, F.array(F.col("s_acctbal").cast("double") / 10000)).alias("vec"))
    near = H.nearest_property(ask, space, ["s_suppkey"])
    return near.select("s_suppkey", "nearest", F.col("nearest_order").cast("bigint").alias("nearest_order"), _r6("sim"))


def scored(spark, sf):
    return H.class_scores(vec_rows(spark, sf), vec_space(spark, sf), VID)


@query("h3_top_class")
def _h3(spark, sf):
    return H.top_class(scored(spark, sf), vec_mapping(spark, sf)).select("vec_id", "y_pred")


@query("h4_projection_loss")
def _h4(spark, sf):
    return H.projection_loss(with_targets(spark, sf)).select(_r6("projection_loss"))


@query("h5_gate_loss")
def _h5(spark, sf):
    return H.gate_loss(with_targets(spark, sf)).select(_r6("gate_loss"))


@query("h6_composed_loss")
def _h6(spark, sf):
    return H.composed_loss(with_targets(spark, sf)).select(_r6("loss"), _r6("projection_loss"), _r6("gate_loss"))


@query("h7_cross_entropy")
def _h7(spark, sf):
    il = F.broadcast(H.integer_labels(vec_mapping(spark, sf)).select("prop", "int_label"))
    return H.cross_entropy(scored(spark, sf).join(il, "prop")).select(_r6("cross_entropy"))


@query("h8_epoch_loss")
def _h8(spark, sf):
    e = H.epoch_loss(with_targets(spark, sf))
    return e.select(_r6("epoch_loss"), _r6("epoch_projection_loss"), _r6("epoch_gate_loss"),
                    F.col("n_batches").cast("bigint").alias("n_batches"))


def quality_predictions(spark, sf):
    lab = V.table(spark, sf, "labels")
    return lab.select("doc_id", F.col("quality").cast("string").alias("y_true"),
                      F.col("toxic").cast("string").alias("y_pred"))


@query("h9_classification_report")
def _h9(spark, sf):
    return M.classification_report(quality_predictions(spark, sf), ["0", "1"])


@query("h10_confusion_matrix")
def _h10(spark, sf):
    return M.confusion_matrix(quality_predictions(spark, sf), ["0", "1"])


EMB_LABELS = ["no_relation"] + [f"rel{i}" for i in range(1, 10)]


@query("h11_evaluate")
def _h11(spark, sf):
    _, report, _ = M.evaluate(vec_rows(spark, sf), vec_space(spark, sf), vec_mapping(spark, sf),
                              EMB_LABELS, VID)
    return report


@query("h11_confusion_matrix")
def _h11b(spark, sf):
    _, _, cm = M.evaluate(vec_rows(spark, sf), vec_space(spark, sf), vec_mapping(spark, sf),
                          EMB_LABELS, VID)
    return cm


@query("h12_fit_gate")
def _h12(spark, sf):
    _, out = FT.fit_gate(with_targets(spark, sf), "vec", "attribute")
    return out.select("vec_id", "rel", "gate")


def labelled_rows(spark, sf):
    """Vectors with their integer label."""
    il = F.broadcast(H.integer_labels(vec_mapping(spark, sf)).select("prop", "int_label"))
    return vec_rows(spark, sf).join(il, "prop")


@query("h13_fit_baseline")
def _h13(spark, sf):
    _, out = NW.fit_baseline(labelled_rows(spark, sf))
    return out.select("vec_id", "int_label", "pred_label")


@query("h13_baseline_forward")
def _h13f(spark, sf):
    """The baseline's scores against a forward pass by SQL functions."""
    net, out = NW.fit_baseline(labelled_rows(spark, sf))
    return NW.forward_error(out, net)


@query("h14_fit_projector")
def _h14(spark, sf):
    t = with_targets(spark, sf)
    return FT.project(t, FT.fit_projector(t), ["vec_id"])


@query("h14_projector_residual")
def _h14r(spark, sf):
    """What is left of the normal equations of the fitted projector."""
    t = with_targets(spark, sf)
    return FT.projector_residual(t, FT.fit_projector(t))


@query("h12_gate_gradient")
def _h12g(spark, sf):
    """The gradient of the gate's loss at the fitted weights."""
    w, out = FT.fit_gate(with_targets(spark, sf), "vec", "attribute")
    return FT.gate_gradient(out, w)


# ------------------------------------------------------------------ flagship
from tessera.plans.flagship import most_probable_pairs  # noqa: E402


@query("q0_most_probable_pairs")
def _q0(spark, sf):
    return most_probable_pairs(spark, sf, min_freq=1)


# ------------------------------------------------------------------ A (round trips through files)
from tessera import scratch_path  # noqa: E402
from tessera.sources import io as IO  # noqa: E402
from tessera.sources.patterns import read_patterns, write_patterns  # noqa: E402
from tessera.sources.records import read_marked_records  # noqa: E402


@query("a1_read_patterns")
def _a1(spark, sf):
    path = scratch_path(spark, "profile")
    write_patterns(pat(spark, sf), path)
    return read_patterns(spark, path).select(*PAT_COLS)


@query("a2_read_marked_records")
def _a2(spark, sf):
    path = scratch_path(spark, "records")
    IO.write_marked_records(V.marked_sentences(spark, sf), path, V.SENTENCE_KEY, "gzip")
    recs = read_marked_records(spark, path, by_number=True).withColumn("ord", F.struct("file_no", "rec_id"))
    return dedupe_last_label(recs).select("sentence", "relation")


@query("a3_dedupe_last_label")
def _a3(spark, sf):
    return deduped_sentences(spark, sf).select("sentence", "relation")


@query("a4_sentences_round_trip")
def _a4(spark, sf):
    path = scratch_path(spark, "sentences")
    IO.write_sentences(_f7(spark, sf), path)
    return IO.read_sentences(spark, path)


@query("a4_sentences_csv_round_trip")
def _a4c(spark, sf):
    path = scratch_path(spark, "sentences-csv")
    IO.write_sentences_csv(_f7(spark, sf), path)
    back = IO.read_sentences_csv(spark, path)
    # types come back null where they were empty, as in the reference's reload
    return back.fillna("", ["e1_type_CNLP", "e2_type_CNLP"])


@query("a5_space_round_trip")
def _a5(spark, sf):
    path = scratch_path(spark, "space")
    IO.write_space(SP.build_space(pat(spark, sf), PROPERTY_LIST, CLONES), path)
    return _long6(IO.read_space(spark, path))


@query("a6_read_mapping")
def _a6(spark, sf):
    path = scratch_path(spark, "mapping")
    IO.write_mapping(V.relation_mapping(spark, sf), path)
    return IO.read_mapping(spark, path)


@query("a7_read_property_list")
def _a7(spark, sf):
    path = scratch_path(spark, "plist")
    preds = pat(spark, sf).select("predicate").distinct()
    lines = preds.select(F.lit(0).alias("k"), "predicate").unionByName(
        spark.createDataFrame([(1, ""), (2, "after the blank line")], "k int, predicate string"))
    IO.write_lines(lines, "predicate", path, ["k", "predicate"])
    return IO.read_property_list(spark, path)


@query("a8_materialise_label_vectors")
def _a8(spark, sf):
    path = scratch_path(spark, "labelvec")
    lv = G.label_vectors(vec_rows(spark, sf), vec_mapping(spark, sf), vec_space(spark, sf))
    back = IO.materialise_label_vectors(lv.select("vec_id", "target"), path)
    return back.select("vec_id", F.posexplode("target").alias("component", "value")).select(
        "vec_id", F.col("component").cast("bigint").alias("component"), _r6("value"))


# ------------------------------------------------------------------ I (planned in the reference)
from tessera.operators import planned as PL  # noqa: E402


@query("i1_majority_type")
def _i1(spark, sf):
    s = PL.majority_type(SF.entity_spans(deduped_sentences(spark, sf)), fixture_tags(spark, sf))
    return s.select("sentence", "e1_major", "e2_major")


def prepared(spark, sf):
    """What I2 and I3 read of the prepared sentences."""
    return _f7(spark, sf).select("sentence", "rel", "e1_type_CNLP", "e2_type_CNLP")


@query("i2_impute_types")
def _i2(spark, sf):
    return PL.impute_types(prepared(spark, sf)).select("sentence", "rel", "e1_type_CNLP", "e2_type_CNLP")


@query("i3_resolve_types")
def _i3(spark, sf):
    return PL.resolve_types(prepared(spark, sf)).select("sentence", "rel", "e1_type_CNLP", "e2_type_CNLP")


@query("i4_clones_from_mapping")
def _i4(spark, sf):
    m = V.relation_mapping(spark, sf).select(
        "rel", F.regexp_replace("prop", "^prop:(small|medium|large)$", "prop:size").alias("prop"))
    return PL.clones_from_mapping(m)


@query("i6_instances_statistic")
def _i6(spark, sf):
    """The ``instances`` statistic end to end: profile files written and read
    in the instances layout, then E1-E3 on that column."""
    path = scratch_path(spark, "profile-instances")
    write_patterns(pat(spark, sf).withColumnRenamed("frequency", "instances"), path, "instances")
    p = read_patterns(spark, path, statistic="instances")
    probs = SP.probabilities(p, "instances")
    space = SP.full_space(probs, "instances")
    return space.entries.select("predicate", "component", _r6("value"))
