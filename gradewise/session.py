"""Spark session helpers.

Library code never assumes a session config it did not check: the driver may
hand us its own session.  ``get_spark`` is for scripts and tests only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "gradewise") -> SparkSession:
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is left
    alone; where it is unset there, this raises, since a folder of the driver's
    machine would be lost to the executors.  In local mode, where driver and
    executors are one process, a scratch folder is made.
    """
    sc = spark.sparkContext
    active = sc.getCheckpointDir()
    if active:
        return active
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gradewise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a partition for heavy per-row work on narrow rows (puzzles, responses).
ROWS_A_TASK = 50_000

#: Partitions that a shuffle fills while it reads; for more (``spark.shuffle.sort.bypassMergeThreshold``,
#: 200 unless set otherwise) a task gathers all its rows in memory first.
DEALT_AT_ONCE = 200


def tasks_for(df, rows: int = ROWS_A_TASK) -> int:
    """Number of partitions of about ``rows`` rows for ``df``, at least one per core; counts the rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df, min_partitions: int | None = None, rows: int | None = None):
    """Give CPU-heavy per-row work at least one partition per core.

    A small table is often a single file and so a single scan partition; the
    per-row work (solving, scoring, tokenising) would then run in one task.
    Large inputs already have many partitions and are returned unchanged, so
    this adds no shuffle at scale.

    With ``rows``, work that takes far longer than reading its narrow rows, no partition has many
    more than that: a task's time and memory then do not grow with the input, whose scan cuts files
    by bytes.  The rows are counted first and shuffled.

    Rows are dealt by a hash of their place in the scan: dealing them in turn would sort all rows of
    a file in the task that reads it.  ``df`` reads a table (a scan gives its rows in the same order
    when a task is run again); other frames are dealt in turn by the caller.

    A file with one row group is read by one task, whatever its size.  Many partitions are therefore
    dealt in two steps: that task fills ``DEALT_AT_ONCE`` partitions as it reads, and each of these is
    dealt on, so no task holds the rows of a file.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if rows:
        target = max(target, tasks_for(df, rows))
    if df.rdd.getNumPartitions() >= target:
        return df
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    if target > DEALT_AT_ONCE:
        # a new hash between the steps: Spark drops the first of two repartitions that follow each other
        placed = placed.repartition(DEALT_AT_ONCE, "_place").withColumn("_place", F.xxhash64("_place"))
    return placed.repartition(target, "_place").drop("_place")
