"""Property tests (hypothesis) for invariants of SURVEY §5(c)."""

from hypothesis import given, settings, strategies as st

from conftest import pat_df
from tessera.operators import metrics as M
from tessera.operators import ontology as O
from tessera.operators import space as SP

SETTINGS = settings(max_examples=10, deadline=None)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("pqr"), st.sampled_from("xyz"),
                          st.integers(1, 50)), min_size=1, max_size=30, unique_by=lambda t: t[:3]))
def test_probabilities_sum_to_one_per_predicate(spark_session_holder, data):
    spark = spark_session_holder
    probs = SP.probabilities(pat_df(spark, data))
    for r in probs.groupBy("predicate").sum("prob").collect():
        assert abs(r["sum(prob)"] - 1.0) < 1e-9


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), max_size=15),
       st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=3))
def test_closure_contains_roots_and_is_closed(spark_session_holder, edges, roots):
    spark = spark_session_holder
    sub = spark.createDataFrame(edges, "child string, parent string")
    got = {(r["root"], r["type"]) for r in O.subtypes(O.values_frame(spark, roots), sub).collect()}
    for root in roots:
        assert (root, root) in got
    for root, t in got:
        for child, parent in edges:
            if parent == t:
                assert (root, child) in got


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abcz"), st.sampled_from("abcz")), min_size=1, max_size=40))
def test_confusion_matrix_sums_to_rows_in_list(spark_session_holder, pairs):
    spark = spark_session_holder
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    labels = ["a", "b", "c"]
    cm = M.confusion_matrix(df, labels).collect()
    assert len(cm) == 9
    assert sum(r["n"] for r in cm) == sum(1 for t, p in pairs if t in labels and p in labels)
