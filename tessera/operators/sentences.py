"""Sentence preparation (F1-F7): direction stripping, entity extraction,
marker removal, entity token spans and entity types from a tag table.
All native expressions; the tag lookup is an equi-join on (key, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.sources.records import dedupe_last_label

MARKERS = ("<e1>", "</e1>", "<e2>", "</e2>")


def strip_direction(df: DataFrame) -> DataFrame:
    """``rel`` = text before the first ``(`` (whole text if none)."""
    return df.withColumn("rel", F.substring_index(F.col("relation"), "(", 1))


def extract_entity(df: DataFrame, marker: str = "e1", out: str | None = None,
                   on_missing: str = "error") -> DataFrame:
    """greedy ``<m>(.*)</m>`` group, not trimmed.  ``on_missing``:
    ``'error'`` fails the query, ``'null'`` yields null."""
    pattern = f"<{marker}>(.*)</{marker}>"
    hit = F.col("sentence").rlike(pattern)
    val = F.regexp_extract(F.col("sentence"), pattern, 1)
    if on_missing == "error":
        expr = F.when(hit, val).otherwise(
            F.raise_error(F.concat(F.lit(f"no <{marker}> entity in: "), F.col("sentence"))))
    elif on_missing == "null":
        expr = F.when(hit, val)
    else:
        raise ValueError("on_missing must be 'error' or 'null'")
    return df.withColumn(out or marker, expr)


def clean_sentence(col) -> F.Column:
    out = col
    for m in MARKERS:
        out = F.replace(out, F.lit(m), F.lit(""))
    return out


def strip_markers(df: DataFrame, out: str = "clean") -> DataFrame:
    """removes the four marker strings, spacing untouched."""
    return df.withColumn(out, clean_sentence(F.col("sentence")))


_MARK_FIELDS = {"<e1>": "a", "</e1>": "b", "<e2>": "c", "</e2>": "d"}


def _marker_scan(toks):
    """One pass over the tokens: for each marker the index of its last
    occurrence (``a``-``d``) and how many marker tokens precede it
    (``na``-``nd``); nulls when a marker is absent."""
    init = F.struct(*[F.lit(None).cast("int").alias(f) for f in "abcd"],
                    *[F.lit(None).cast("int").alias("n" + f) for f in "abcd"],
                    F.lit(0).alias("seen"))

    def step(acc, x):
        t, i = x["t"], x["i"]
        fields = []
        for m, f in _MARK_FIELDS.items():
            fields.append(F.when(t == F.lit(m), i).otherwise(acc[f]).alias(f))
        for m, f in _MARK_FIELDS.items():
            fields.append(F.when(t == F.lit(m), acc["seen"]).otherwise(acc["n" + f]).alias("n" + f))
        is_marker = t.isin(*MARKERS)
        fields.append((acc["seen"] + F.when(is_marker, F.lit(1)).otherwise(F.lit(0))).alias("seen"))
        return F.struct(*fields)

    indexed = F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.aggregate(indexed, init, step)


def entity_spans(df: DataFrame, order_safe: bool = False) -> DataFrame:
    """token positions of both entities in the marker-free sentence.

    For the last ``<e1>``, ``</e1>``, ``<e2>``, ``</e2>`` token at index i the
    positions are i, i-2, i-2, i-4; a missing marker gives 0.  These fixed
    offsets assume e1 precedes e2; ``order_safe`` instead subtracts the
    markers actually seen before each one.  The tokens are cut once."""
    if not order_safe:
        offsets = {"e1_start": ("<e1>", 0), "e1_end": ("</e1>", 2), "e2_start": ("<e2>", 2), "e2_end": ("</e2>", 4)}
        out = df.withColumn("_back", F.reverse(tokens(F.col("sentence"))))
        # the first place from the end is the last occurrence
        found = {name: F.array_position("_back", m) for name, (m, _) in offsets.items()}
        spans = {name: F.coalesce(F.when(found[name] > 0, F.size("_back") - found[name].cast("int") - F.lit(off)), F.lit(0))
                 for name, (_, off) in offsets.items()}
        return out.withColumns(spans).drop("_back")
    out = df.withColumn("_scan", _marker_scan(tokens(F.col("sentence"))))
    sc = F.col("_scan")
    for name, f, closing in (("e1_start", "a", 0), ("e1_end", "b", 1),
                             ("e2_start", "c", 0), ("e2_end", "d", 1)):
        out = out.withColumn(name, F.coalesce(sc[f] - sc["n" + f] - F.lit(closing), F.lit(0)))
    return out.drop("_scan")


def tag_arrays(tags: DataFrame, key: str = "sentence") -> DataFrame:
    """(key, tag_arr) or (key, tag_map) from tagger output: one array per key
    (key, tags), tag i for token i, is kept as it is; long rows
    (key, pos, tag) are grouped once per sentence into a position map (a
    sentence's tags, bounded by its length)."""
    if "tags" in tags.columns:
        return tags.select(key, F.col("tags").alias("tag_arr"))
    return tags.groupBy(key).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("pos").cast("bigint"), F.col("tag")))).alias("tag_map"))


def tag_at(tm: DataFrame, pos):
    """Tag at a 0-based token position (null outside the sentence)."""
    if "tag_arr" in tm.columns:
        p = pos.cast("int")
        return F.when(p >= 0, F.try_element_at(F.col("tag_arr"), p + F.lit(1)))
    return F.try_element_at(F.col("tag_map"), pos.cast("bigint"))


def entity_types(spans: DataFrame, tags: DataFrame, key: str = "sentence") -> DataFrame:
    """tags of the first and last token of each entity, as a sorted set
    without ``O``.  ``tags`` is tagger output keyed like ``spans`` (see
    ``tag_arrays``).  A position outside the sentence finds no tag.

    One join on the key: the sentence side is already partitioned by it
    after the dedupe, so only the tag side moves."""
    tm = tag_arrays(tags, key)
    j = spans.join(tm, key, "left")

    def types(a, b):
        look = [tag_at(tm, F.col(c)) for c in (a, b)]
        arr = F.filter(F.array(*look), lambda t: t.isNotNull() & (t != F.lit("O")))
        return F.array_sort(F.array_distinct(arr))

    return (j.withColumn("e1_types", types("e1_start", "e1_end"))
            .withColumn("e2_types", types("e2_start", "e2_end")).drop(*[c for c in tm.columns if c != key]))


def types_as_csv(df: DataFrame, suffix: str = "CNLP") -> DataFrame:
    """comma-joined sorted types, ``""`` when there are none."""
    def csv(c):
        return F.coalesce(F.array_join(F.array_sort(F.col(c)), ","), F.lit(""))
    return (df.withColumn(f"e1_type_{suffix}", csv("e1_types"))
            .withColumn(f"e2_type_{suffix}", csv("e2_types")))


def prepare_sentences(records: DataFrame, tags: DataFrame, order: str = "ord",
                      on_missing: str = "error") -> DataFrame:
    """A3 -> F1 -> F2 -> F4 -> F5 -> F6.  ``records`` has
    (sentence, relation, ``order``); ``tags`` is keyed by sentence."""
    s = dedupe_last_label(records, "sentence", order)
    s = strip_direction(s)
    s = extract_entity(s, "e1", on_missing=on_missing)
    s = extract_entity(s, "e2", on_missing=on_missing)
    s = entity_spans(s)
    s = types_as_csv(entity_types(s, tags))
    return s.select("sentence", "relation", "rel", "e1", "e2", "e1_type_CNLP", "e2_type_CNLP")
