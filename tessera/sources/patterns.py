"""Pattern-profile source (A1) and the pair key (B1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_SEP = "#-#"

#: What the usual data-frame readers take for a missing field.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
           "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# file names of a profile directory, per statistic: (object patterns, datatype patterns)
PROFILE_FILES = {
    "frequency": ("object_akp.txt", "datatype_akp.txt"),
    "instances": ("object_patterns.txt", "datatype_patterns.txt"),
}


def pair_col(subject: str = "subject", obj: str = "object"):
    return F.concat(F.col(subject), F.lit(PAIR_SEP), F.col(obj))


def with_pair(df: DataFrame) -> DataFrame:
    """B1: adds ``pair`` = subject#-#object."""
    return df.withColumn("pair", pair_col())


def pattern_schema(statistic: str = "frequency") -> T.StructType:
    return T.StructType([
        T.StructField("subject", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField(statistic, T.LongType()),
    ])


def read_patterns(spark: SparkSession, profile_dir: str, statistic: str = "frequency",
                  null_as_nan: bool = True) -> DataFrame:
    """A1: the object and datatype pattern files of a profile, unioned
    (object patterns first, ``src`` 0, then datatype patterns, ``src`` 1).

    Files are headerless and ``;``-separated.  With ``null_as_nan`` a missing
    subject/predicate/object (an empty field or one of ``MISSING``) becomes
    the literal ``"nan"`` and takes part in grouping like any other value.  A
    count may be written as a decimal (``12.0``); a count that is not a whole
    number, or a row without one, fails the query."""
    if statistic not in PROFILE_FILES:
        raise ValueError(f"statistic must be one of {sorted(PROFILE_FILES)}")
    obj_file, dt_file = PROFILE_FILES[statistic]
    base = profile_dir.rstrip("/")
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in pattern_schema(statistic)])
    number = F.expr(f"try_cast({statistic} as double)")
    count = F.when(number == F.floor(number), F.coalesce(F.expr(f"try_cast({statistic} as bigint)"), number.cast("bigint"))).otherwise(
        F.raise_error(F.concat(F.lit(f"not a whole {statistic}: "), F.coalesce(F.col(statistic), F.lit("(missing)")))))

    def load(name, src):
        return (spark.read.schema(schema)
                .csv(f"{base}/{name}", sep=";", header=False, quote='"', escape='"')
                .withColumn(statistic, count.cast("bigint")).withColumn("src", F.lit(src)))

    df = load(obj_file, 0).unionByName(load(dt_file, 1))
    if null_as_nan:
        for c in ("subject", "predicate", "object"):
            df = df.withColumn(c, F.when(F.col(c).isNull() | F.col(c).isin(MISSING), F.lit("nan")).otherwise(F.col(c)))
    return with_pair(df).select("subject", "predicate", "object", statistic, "pair", "src")


def write_patterns(df: DataFrame, profile_dir: str, statistic: str = "frequency") -> None:
    """Writes a pattern table in the profile layout read by ``read_patterns``
    (one folder per file name, Spark part files inside)."""
    obj_file, dt_file = PROFILE_FILES[statistic]
    base = profile_dir.rstrip("/")
    cols = ["subject", "predicate", "object", statistic]
    for name, src in ((obj_file, 0), (dt_file, 1)):
        (df.filter(F.col("src") == src).select(*cols)
         .write.mode("overwrite").csv(f"{base}/{name}", sep=";", header=False))
