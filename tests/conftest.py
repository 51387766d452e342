import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    ckpt = tempfile.mkdtemp(prefix="tessera-test-ckpt-")
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt, "spark.default.parallelism": "4"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tessera-test-")


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def pat_df(spark, data, src=0):
    from tessera.sources.patterns import with_pair
    df = spark.createDataFrame(data, "subject string, predicate string, object string, frequency bigint")
    from pyspark.sql import functions as F
    return with_pair(df.withColumn("src", F.lit(src)))


@pytest.fixture(scope="session")
def spark_session_holder(spark):
    """The session for hypothesis tests (function-scoped fixtures are
    reset between generated examples, session ones are not)."""
    return spark
