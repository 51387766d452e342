"""Session helpers: building a local session for tests/bench and finding the
shared folder used for checkpoints and written intermediate tables."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int = 8, driver_memory: str = "8g",
                  extra: dict | None = None) -> SparkSession:
    """Local session used by tests and the bench.  On a cluster, build the
    session with the cluster's own settings; nothing here is required."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Most rows of an Arrow batch whose rows are whole texts.
TEXTS_PER_BATCH = 2000


def bound_batches(spark: SparkSession) -> None:
    """Lets Spark hand whole texts to Python in batches of at most
    ``TEXTS_PER_BATCH`` rows (a setting of the session; a smaller one is kept).
    An executor and its workers hold several copies of a batch for each task:
    growing buffers, Arrow columns, Python strings and what is returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    It is read from the session.  When the setting is absent, a folder below
    the warehouse is used; on a cluster, that is an error if the warehouse is
    on a machine's own disk, which other machines do not see."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-scratch"
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-scratch"
        refuse_own_disk(getattr(sc, "master", "local"), configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def refuse_own_disk(master: str, folder: str) -> None:
    """Raises ValueError if ``folder`` is on the driver's own disk and the
    tasks run on other machines."""
    local = master == "local" or master.startswith("local[")
    if not local and re.match(r"file:|/|[^:/]+(/|$)", folder):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {folder} is on one machine's disk")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
