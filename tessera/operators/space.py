"""Property space.

A space is kept sparse and long:

* ``rows``    (predicate, row_order)        one row per space row, zero rows included
* ``entries`` (predicate, component, value) non-zero coordinates only
* ``dims``    (component, label)            0-based dense component ids

so memory is proportional to the patterns, never predicates x pairs.  The
dense/wide forms exist only as exports (``to_dense``, ``to_wide``) behind
an explicit size check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.index import dense_index
from tessera.functions.vectors import dense_from_map
from tessera.session import checkpoint_dir

CLONE_MARK = "@"

# The clone list of the reference's relation space (properties
# shared by several relations, one clone per relation).
PROFILE_CLONES = [
    "http://dbpedia.org/ontology/headquarter_@1",
    "http://dbpedia.org/ontology/headquarter_@2",
    "http://dbpedia.org/ontology/headquarter_@3",
    "http://dbpedia.org/ontology/membership_@1",
    "http://dbpedia.org/ontology/membership_@2",
    "http://dbpedia.org/ontology/membership_@3",
    "http://dbpedia.org/ontology/residence_@1",
    "http://dbpedia.org/ontology/residence_@2",
    "http://dbpedia.org/ontology/residence_@3",
    "http://dbpedia.org/ontology/alias_@1",
    "http://dbpedia.org/ontology/alias_@2",
]


@dataclass
class Space:
    rows: DataFrame
    entries: DataFrame
    dims: DataFrame
    # row names in row order when they come from a bounded, driver-side list
    row_names: list[str] | None = None

    def long(self) -> DataFrame:
        """rows left join entries: (predicate, row_order, component, value);
        a zero row appears once with null component/value."""
        return self.rows.join(self.entries, "predicate", "left").select(
            "predicate", "row_order", "component", "value")


# ------------------------------------------------------------------ E1
def probabilities(df: DataFrame, statistic: str = "frequency") -> DataFrame:
    """``tot`` = statistic total of the predicate and
    ``prob = ((statistic*100)/tot)*0.01`` (the reference's arithmetic).

    The total is a partial aggregate joined back on the predicate (not a
    window), so a predicate with a huge share of the patterns is combined
    map-side and split by AQE's skew join instead of landing in one task."""
    tot = df.groupBy("predicate").agg(F.sum(statistic).alias("tot"))
    out = df.join(tot, "predicate")
    prob = ((F.col(statistic) * F.lit(100)).cast("double") / F.col("tot").cast("double")) * F.lit(0.01)
    return out.withColumn("prob", prob)


# ------------------------------------------------------------------ E2
def dimensions(df: DataFrame) -> DataFrame:
    """Distinct pairs with a dense 0-based ``component`` in pair order."""
    pairs = df.select(F.col("pair").alias("label")).distinct()
    return dense_index(pairs, ["label"], "component").select("component", "label")


# ------------------------------------------------------------------ E3
def first_prob(df: DataFrame, statistic: str = "frequency") -> DataFrame:
    """One value per (predicate, pair): the first row's prob, first = lowest
    ``src`` then larger statistic (all rows still count in ``tot``)."""
    key = F.struct(F.col("src"), (-F.col(statistic)).alias("negf"))
    return df.groupBy("predicate", "pair").agg(F.min_by("prob", key).alias("value"))


def vectorise(probs: DataFrame, dims: DataFrame, statistic: str = "frequency") -> DataFrame:
    """Entries (predicate, component, value) of every predicate."""
    fp = first_prob(probs, statistic)
    return (fp.join(dims.withColumnRenamed("label", "pair"), "pair")
            .select("predicate", "component", "value"))


def property_rows(spark: SparkSession, names: list[str]) -> DataFrame:
    """A property list as (predicate, row_order); the first occurrence of a
    repeated name keeps its place.  Size bounded by the given list."""
    seen, rows = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            rows.append((n, len(rows)))
    schema = T.StructType([T.StructField("predicate", T.StringType()),
                           T.StructField("row_order", T.LongType())])
    return spark.createDataFrame(rows, schema)


def listed_once(rows: DataFrame) -> DataFrame:
    """A property table with one row per predicate, its first, and row
    orders without gaps (as for a Python list)."""
    first = rows.groupBy("predicate").agg(F.min(F.col("row_order").cast("bigint")).alias("_first"))
    return dense_index(first, ["_first", "predicate"], "row_order").select("predicate", "row_order")


def _unique(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


def full_space(probs: DataFrame, statistic: str = "frequency") -> Space:
    """E2 + E3 for every predicate (notebook mode): rows in predicate order.
    The first-row table is checkpointed once; dims, rows and entries all
    read it instead of recomputing the totals."""
    checkpoint_dir(probs.sparkSession)
    fp = first_prob(probs, statistic).checkpoint()
    dims = dense_index(fp.select(F.col("pair").alias("label")).distinct(), ["label"], "component").select(
        "component", "label")
    entries = (fp.join(dims.withColumnRenamed("label", "pair"), "pair")
               .select("predicate", "component", "value"))
    rows = dense_index(fp.select("predicate").distinct(), ["predicate"], "row_order")
    return Space(rows, entries, dims)


# ------------------------------------------------------------------ E4
def restrict_to(space: Space, rows: DataFrame | list[str]) -> Space:
    """Only the listed predicates, in list order; a listed predicate
    without patterns is a zero row (present in ``rows`` only).  ``rows`` is
    a Python list, which is broadcast, or a (predicate, row_order) DataFrame
    of any size, for which the join is left to AQE; of a repeated predicate
    the first row counts."""
    names = None
    if not isinstance(rows, DataFrame):
        names = _unique(list(rows))
        r = F.broadcast(property_rows(space.rows.sparkSession, names))
    else:
        r = listed_once(rows)
    return Space(r, space.entries.join(r.select("predicate"), "predicate", "left_semi"), space.dims, names)


# ------------------------------------------------------------------ E5
def drop_zero_dims(space: Space) -> Space:
    """E5: removes components that are 0 in every kept row and re-indexes
    the rest densely, keeping their order."""
    nz = space.entries.filter(F.col("value") != 0)
    used = nz.select("component").distinct()
    remap = dense_index(used, ["component"], "new_component")
    dims = (remap.join(space.dims, "component")
            .select(F.col("new_component").alias("component"), "label"))
    entries = (nz.join(remap, "component")
               .select("predicate", F.col("new_component").alias("component"), "value"))
    return Space(space.rows, entries, dims, space.row_names)


# ------------------------------------------------------------------ E6
def clone_base(name: str) -> str | None:
    """Base of a clone name: the text before ``@`` minus the separator
    character in front of it (``x_@2`` -> ``x``)."""
    i = name.find(CLONE_MARK)
    if i < 0:
        return None
    return name[:i - 1] if i >= 1 else name[:i]


def disambiguate(space: Space, clones: list[str]) -> Space:
    """Every clone ``base_@k`` becomes a copy of its base row plus its own
    new dimension set to 1; then the base rows are dropped.  Row order:
    surviving rows, then clones in list order.  A missing base fails the
    query.  The clone list is a bounded parameter."""
    spark = space.rows.sparkSession
    items = [(c, clone_base(c)) for c in clones if clone_base(c) is not None]
    if not items:
        return space
    n_dims = space.dims.agg(F.coalesce(F.max("component") + 1, F.lit(0)).alias("d"))
    schema = T.StructType([T.StructField("predicate", T.StringType()),
                           T.StructField("base", T.StringType()),
                           T.StructField("k", T.LongType())])
    cl = spark.createDataFrame([(c, b, i) for i, (c, b) in enumerate(items)], schema)
    checked = (F.broadcast(cl).join(space.rows.withColumnRenamed("predicate", "base")
                                    .withColumnRenamed("row_order", "base_order"), "base", "left")
               .withColumn("base", F.when(F.col("base_order").isNotNull(), F.col("base"))
                           .otherwise(F.raise_error(F.concat(F.lit("clone base not in space: "),
                                                             F.col("predicate"))))))
    bases = F.broadcast(cl.select(F.col("base").alias("predicate")).distinct())
    base_names = sorted({b for _, b in items})
    if space.row_names is not None:
        missing = [b for b in base_names if b not in space.row_names]
        if missing:
            raise ValueError(f"clone base not in space: {missing}")
        kept = [n for n in space.row_names if n not in base_names]
        names = kept + [c for c, _ in items]
        surv = spark.createDataFrame([(n, i) for i, n in enumerate(kept)], "predicate string, row_order bigint")
        clone_rows = spark.createDataFrame([(c, len(kept) + i) for i, (c, _) in enumerate(items)],
                                           "predicate string, row_order bigint")
    else:
        names = None
        kept_rows = space.rows.join(bases, "predicate", "left_anti")
        # row order: surviving rows keep their relative order, clones follow
        surv = dense_index(kept_rows, ["row_order"], "_r").select("predicate", F.col("_r").alias("row_order"))
        offset = kept_rows.agg(F.count(F.lit(1)).alias("_nk")).first()["_nk"]
        clone_rows = checked.select("predicate", (F.lit(offset) + F.col("k")).alias("row_order"))
    copies = (space.entries.withColumnRenamed("predicate", "base")
              .join(F.broadcast(checked.select("base", "predicate")), "base")
              .select("predicate", "component", "value"))
    d = n_dims.first()["d"]
    extra_dims = checked.select((F.lit(d) + F.col("k")).cast("bigint").alias("component"),
                                F.concat(F.lit("add"), (F.col("k") + 1).cast("string")).alias("label"))
    ones = checked.select("predicate", (F.lit(d) + F.col("k")).cast("bigint").alias("component"),
                          F.lit(1.0).alias("value"))
    entries = (space.entries.join(bases, "predicate", "left_anti")
               .unionByName(copies).unionByName(ones))
    return Space(surv.unionByName(clone_rows), entries, space.dims.unionByName(extra_dims), names)


# ------------------------------------------------------------------ E7
def add_constant_row(space: Space, name: str = "no_relation", value: float = -1.0) -> Space:
    """A row holding ``value`` in every dimension (extra ones included),
    appended after the other rows."""
    if space.row_names is not None:
        nxt = len(space.row_names)
    else:
        nxt = space.rows.agg(F.coalesce(F.max("row_order") + 1, F.lit(0)).alias("r")).first()["r"]
    spark = space.rows.sparkSession
    row = spark.createDataFrame([(name, int(nxt))], "predicate string, row_order bigint")
    filler = space.dims.select(F.lit(name).alias("predicate"), "component",
                               F.lit(float(value)).alias("value"))
    names = None if space.row_names is None else space.row_names + [name]
    return Space(space.rows.unionByName(row), space.entries.unionByName(filler), space.dims, names)


# ------------------------------------------------------------------ E8
def n_dims(space: Space) -> int:
    return int(space.dims.agg(F.coalesce(F.max("component") + 1, F.lit(0))).first()[0])


def to_dense(space: Space, max_dims: int = 1_000_000, dims: int | None = None) -> DataFrame:
    """(predicate, row_order, vec array<double>) for consumers that need a
    dense vector; refuses spaces wider than ``max_dims``."""
    d = n_dims(space) if dims is None else dims
    if d > max_dims:
        raise ValueError(f"space has {d} dimensions, above max_dims={max_dims}")
    m = space.entries.groupBy("predicate").agg(
        F.map_from_entries(F.collect_list(F.struct("component", "value"))).alias("m"))
    return (space.rows.join(m, "predicate", "left")
            .select("predicate", "row_order",
                    dense_from_map(F.coalesce(F.col("m"), F.create_map().cast("map<bigint,double>")),
                                   d).alias("vec")))


def to_wide(space: Space, max_cols: int = 1000) -> DataFrame:
    """rows = predicates, one column ``c<k>`` per component (pivot on the
    known component list).  Refuses more than ``max_cols`` columns."""
    d = n_dims(space)
    if d > max_cols:
        raise ValueError(f"{d} components exceed max_cols={max_cols}; use the long form")
    comps = list(range(d))
    piv = (space.entries.groupBy("predicate").pivot("component", comps).agg(F.first("value")))
    out = space.rows.join(piv, "predicate", "left")
    cols = [F.coalesce(F.col(str(c)), F.lit(0.0)).alias(f"c{c}") for c in comps]
    return out.select("predicate", "row_order", *cols)


def to_long(wide: DataFrame) -> DataFrame:
    """Inverse of ``to_wide``: (predicate, component, value), zeros dropped."""
    comp_cols = [c for c in wide.columns if c.startswith("c") and c[1:].isdigit()]
    arr = F.array(*[F.struct(F.lit(int(c[1:])).cast("bigint").alias("component"),
                             F.col(c).cast("double").alias("value")) for c in comp_cols])
    return (wide.select("predicate", F.explode(arr).alias("e"))
            .select("predicate", "e.component", "e.value").filter(F.col("value") != 0))


# ------------------------------------------------------------------ E9
def row_sums(space: Space) -> DataFrame:
    """Sum of every row (0 for a zero row)."""
    s = space.entries.groupBy("predicate").agg(F.sum("value").alias("row_sum"))
    return (space.rows.join(s, "predicate", "left")
            .select("predicate", "row_order", F.coalesce("row_sum", F.lit(0.0)).alias("row_sum")))


# ------------------------------------------------------------------ E10
def build_space(df: DataFrame, property_list: list[str] | DataFrame | None = None,
                clones: list[str] | None = None, filler: str | None = "no_relation",
                statistic: str = "frequency") -> Space:
    """E1 -> E2 -> E3 -> E4 -> E5 -> E6 -> E7.

    With a property list the patterns are restricted first (totals are per
    predicate, so this does not change any probability) and only the pairs
    of the kept rows are indexed, once (exactly the E2 ids after E5's
    re-index).  ``property_list=None`` keeps every
    predicate (notebook mode)."""
    spark = df.sparkSession
    if property_list is None:
        rows = dense_index(df.select("predicate").distinct(), ["predicate"], "row_order")
    elif isinstance(property_list, DataFrame):
        rows = listed_once(property_list)
        # a predicate's total only depends on its own rows: restrict first
        df = df.join(rows.select("predicate"), "predicate", "left_semi")
    else:
        rows = property_rows(spark, list(property_list))
        # restrict before the totals; a listed IN filter reaches the scan
        df = df.filter(F.col("predicate").isin(_unique(list(property_list))))
    probs = probabilities(df, statistic)
    checkpoint_dir(spark)
    # computed once: the dense index and the entries both read the checkpoint
    fp = first_prob(probs, statistic).filter(F.col("value") != 0).checkpoint()
    dims = dense_index(fp.select(F.col("pair").alias("label")).distinct(), ["label"], "component")
    entries = (fp.join(dims.withColumnRenamed("label", "pair"), "pair")
               .select("predicate", "component", "value"))
    names = None if property_list is None or isinstance(property_list, DataFrame) else _unique(list(property_list))
    space = Space(rows, entries, dims.select("component", "label"), names)
    if clones:
        space = disambiguate(space, clones)
    if filler is not None:
        space = add_constant_row(space, filler, -1.0)
    return space
