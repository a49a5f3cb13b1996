"""Positional semantics on DataFrames.

The batch model of the reference is positional (chunk, repeat, reorder, pad,
first-N splits).  A DataFrame has no position, so every positional operator
takes an explicit total order and goes through ``with_global_index``.

Plan: range-partition on the order key, sort inside each partition and
checkpoint the result to the shared checkpoint folder (``spark.checkpoint.dir``).
Then count rows per partition (partial aggregate, one row per partition), turn
counts into offsets (a table bounded by the partition count, so it is safe to
broadcast) and add the in-partition position from ``monotonically_increasing_id``.

The checkpoint is what makes this correct: the range partitioner samples its
bounds with a seed tied to the RDD, so two independent evaluations of the same
plan can cut partitions differently.  Reading one written copy twice gives the
counting pass and the numbering pass the same partitions, and a lost executor
re-reads the written copy instead of re-sampling.  The order key must be
unique; ties make positions non-deterministic.

The number of ranges follows from the rows themselves.  A frame that only reads
one table is as large as its files at most; anything else (a join's estimate is
the product of its sides) is written once first, and the written bytes count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _cols(order_cols) -> list[Column]:
    if isinstance(order_cols, (str, Column)):
        order_cols = [order_cols]
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


#: Bytes of a range: of the files of a table, or of the written (compressed) rows.
PARTITION_BYTES = 128 << 20
WRITTEN_BYTES = 32 << 20


def _reads_one_table(plan) -> bool:
    leaves = plan.collectLeaves()
    return leaves.size() == 1 and leaves.apply(0).getClass().getSimpleName() == "LogicalRelation"


def _written(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``df`` written once to the shared folder, and their bytes there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(df.schema).parquet(path), files.getContentSummary(folder).getLength()


def sized(df: DataFrame, num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """``df``, or its rows read back, and the number of ranges for them: the number asked for,
    else enough for their bytes, and at least the session's shuffle partitions."""
    if num_partitions:
        return df, int(num_partitions)
    plan = df._jdf.queryExecution().optimizedPlan()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if _reads_one_table(plan):
        return df, max(least, -(-int(str(plan.stats().sizeInBytes())) // PARTITION_BYTES))
    rows, size = _written(df)
    return rows, max(least, -(-size // WRITTEN_BYTES))


def with_global_index(df: DataFrame, order_cols, name: str = "idx",
                      num_partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Add a 0-based dense position ``name`` following ``order_cols``.

    With ``key`` (a unique column) and column-name ``order_cols``, only the key
    and the order columns are indexed and checkpointed, and the position is
    joined back on the key: for wide tables this writes far less, at the price
    of one shuffle join.
    """
    if key is not None:
        names = [order_cols] if isinstance(order_cols, str) else list(order_cols)
        if not all(isinstance(c, str) for c in names):
            raise ValueError("the narrow form needs order columns given by name")
        narrow = df.select(*dict.fromkeys([key, *names]))
        positions = with_global_index(narrow, names, name, num_partitions).select(key, name)
        return df.join(positions, key)
    cols = _cols(order_cols)
    ensure_checkpoint_dir(df.sparkSession)
    df, n = sized(df, num_partitions)
    ranged = (df.repartitionByRange(n, *cols)
              .sortWithinPartitions(*cols)
              .checkpoint(eager=True)
              .withColumn("_gw_pid", F.spark_partition_id())
              .withColumn("_gw_mid", F.monotonically_increasing_id()))
    # one row per partition: bounded by the partition count, not the data
    counts = ranged.groupBy("_gw_pid").agg(F.count(F.lit(1)).alias("_gw_n"))
    before = Window.orderBy("_gw_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_gw_pid", F.coalesce(F.sum("_gw_n").over(before), F.lit(0)).alias("_gw_off"))
    local = F.col("_gw_mid") - F.shiftleft(F.col("_gw_pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), "_gw_pid")
            .withColumn(name, (F.col("_gw_off") + local).cast("long"))
            .drop("_gw_pid", "_gw_mid", "_gw_off"))


def row_count(df: DataFrame) -> Column:
    """Total row count of ``df`` as a scalar-subquery column (no driver trip)."""
    return df.select(F.count(F.lit(1))).scalar()
