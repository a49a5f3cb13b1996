"""Streaming metrics over an append-only log of scored responses.

The reference appends scored samples to per-step logs and reads metrics in
batch; here the same log is a file stream: ``readStream`` over the folder,
aggregate, and write results with ``availableNow`` (process what is there,
then stop).  Checkpoints live in the shared checkpoint folder, so a restarted
query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORED_SCHEMA = "run string, step long, source string, event_id long, ts timestamp_ntz, score double"


def scored_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = 1) -> DataFrame:
    """The log as a stream; without a number of files a micro-batch takes all that is there."""
    reader = spark.readStream.schema(SCORED_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(folder)


def running_means(stream: DataFrame, out_path: str, checkpoint: str):
    """Running mean / count per (run, step, source), updated every micro-batch.

    Update mode: every micro-batch appends the totals that it changed, tagged with
    the batch id; ``latest_means`` keeps the last version of each."""
    agg = stream.groupBy("run", "step", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"))

    def write(batch_df, batch_id):
        batch_df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)
    return (agg.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_means(spark: SparkSession, out_path: str) -> DataFrame:
    """Final totals of every (run, step, source): those of its latest micro-batch."""
    best = spark.read.parquet(out_path).groupBy("run", "step", "source").agg(
        F.max_by(F.struct("n", "score_sum"), "batch_id").alias("v"))
    return best.select("run", "step", "source", "v.n", "v.score_sum")


def closed_means(stream: DataFrame, out_path: str, checkpoint: str, idle: str = "1 day", delay: str = "1 hour"):
    """X1 with a timeout of the state: count and sum per (run, step, source), written once, when no row
    came for ``idle`` of event time and the watermark has passed that.

    ``running_means`` keeps a state for every key that ever came; here a key leaves the state when it is
    written, so the state is bounded by the open keys.  A key that comes back later has a further row
    (``first_at`` and ``closed_at`` tell them apart); rows older than the watermark by ``idle`` are
    dropped, unless an open row of their key takes them in.  Keys still open at the end of the log stay
    in the checkpoint for the next run."""
    agg = (stream.withColumn("event_time", event_time("ts")).withWatermark("event_time", delay)
           .groupBy("run", "step", "source", F.session_window("event_time", idle).alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum")))
    out = agg.select("run", "step", "source", F.col("w.start").alias("first_at"), F.col("w.end").alias("closed_at"), "n", "score_sum")
    return (out.writeStream.outputMode("append").format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def event_time(ts_ntz) -> "F.Column":
    """Absolute event time from a wall-clock (NTZ) value read as UTC, computed
    from its fields so the session time zone plays no part."""
    c = F.col(ts_ntz)
    secs = (F.datediff(F.to_date(c), F.lit("1970-01-01")).cast("long") * 86400
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))
    return F.timestamp_seconds(secs)


def utc_day(ts_ltz) -> "F.Column":
    """Calendar day (UTC) of an absolute timestamp, independent of the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(F.col(ts_ltz)) / 86400).cast("int"))


def windowed_metrics(stream: DataFrame, out_path: str, checkpoint: str, window: str = "1 day",
                     delay: str = "1 hour"):
    """Per-window, per-source count and mean with a watermark.

    Update mode: every micro-batch appends the windows it changed (tagged with
    the batch id); ``latest_windows`` keeps the last version of each window.
    Rows older than the watermark are dropped and closed windows leave the
    state, so state stays bounded by the open windows."""
    agg = (stream.withColumn("event_time", event_time("ts")).withWatermark("event_time", delay)
           .groupBy(F.window("event_time", window).alias("w"), "source")
           .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source", "n", "mean_score")

    def write(batch_df, batch_id):
        batch_df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)
    return (out.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """Final value of every window: the row of its latest micro-batch."""
    r = spark.read.parquet(out_path)
    best = r.groupBy("window_start", "window_end", "source").agg(
        F.max_by(F.struct("n", "mean_score"), "batch_id").alias("v"))
    return best.select("window_start", "window_end", "source", "v.n", "v.mean_score")


def late_rows(stream: DataFrame, out_path: str, checkpoint: str, window_seconds: int = 86400, delay_seconds: int = 3600):
    """What the watermark drops, as a table.

    A row is late if its window ended at or before the watermark: the latest event time of earlier
    micro-batches less the delay, as for ``windowed_metrics`` over the same micro-batches.  Each
    micro-batch writes its late rows, with the watermark they missed, and its own latest event time
    below folders of its number, so a batch that is run again replaces what it wrote.  ``read_late_rows``
    reads them."""
    second = F.unix_seconds(event_time("ts"))

    def write(batch_df, batch_id):
        spark = batch_df.sparkSession
        batch_df.agg(F.max(second).alias("latest")).write.mode("overwrite").parquet(f"{out_path}/latest/batch_id={batch_id}")
        before = spark.read.schema("latest long, batch_id long").parquet(f"{out_path}/latest").filter(F.col("batch_id") < batch_id)
        # one row per micro-batch: a scalar
        mark = before.select(F.max("latest") - delay_seconds).scalar()
        end = (F.floor(second / window_seconds) + 1) * window_seconds
        late = batch_df.withColumn("watermark", F.timestamp_seconds(mark)).filter(end <= F.unix_seconds("watermark"))
        late.write.mode("overwrite").parquet(f"{out_path}/late/batch_id={batch_id}")
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_late_rows(spark: SparkSession, out_path: str) -> DataFrame:
    """Late rows with their micro-batch (``batch_id``) and the ``watermark`` they missed."""
    return spark.read.schema(f"{SCORED_SCHEMA}, watermark timestamp, batch_id long").parquet(f"{out_path}/late")
