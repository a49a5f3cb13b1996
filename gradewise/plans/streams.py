"""Streaming queries (X1, X2): the events table, written as an append-only log of scored
samples that arrives in slices, some rows long after their time, is consumed as a file
stream after each slice.  Every run starts from the checkpoint of the one before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import rnd
from ..session import spread, table
from ..sources.io import scratch_path
from ..streaming import metrics as X
from .registry import register

SLICES = 3
LATE_EVERY, LATE_SECONDS = 10, 5 * 86400  # every tenth event arrives five days after its time


def _slices(spark, sf):
    """Folder of the log, appended slice by slice of the arrival time while this is iterated over."""
    ev = spread(table(spark, sf, "events").select(
        F.lit("r0").alias("run"), F.expr("event_id div 1024").alias("step"), F.col("event_type").alias("source"),
        "event_id", "ts", F.col("value").alias("score")))
    arrives = F.unix_seconds(X.event_time("ts")) + F.when(F.col("event_id") % LATE_EVERY == 0, LATE_SECONDS).otherwise(0)
    first, last = ev.agg(F.min(arrives), F.max(arrives)).first()
    folder = scratch_path(spark, "x_log")
    for i in range(SLICES if first is not None else 0):
        slice_ = F.expr(f"(_arrives - {first}) * {SLICES} div {last - first + 1}")
        ev.withColumn("_arrives", arrives).filter(slice_ == i).drop("_arrives").write.mode("append").json(folder)
        yield folder


_SLICES_SQL = f"""
e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
             CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN event_id % {LATE_EVERY} = 0 THEN {LATE_SECONDS} ELSE 0 END AS arrives FROM events),
s AS (SELECT *, (arrives - (SELECT min(arrives) FROM e)) * {SLICES} // (SELECT max(arrives) - min(arrives) + 1 FROM e) AS slice FROM e),
m AS (SELECT slice, max(sec) AS latest FROM s GROUP BY slice),
w AS (SELECT m.slice, max(b.latest) - 3600 AS mark FROM m JOIN m b ON b.slice < m.slice GROUP BY m.slice),
r AS (SELECT s.*, w.mark, coalesce((sec // 86400 + 1) * 86400 <= mark, false) AS late FROM s LEFT JOIN w USING (slice))
"""


@register("X1", """
SELECT 'r0' AS run, event_id // 1024 AS step, event_type AS source, count(*) AS n, round(avg(value), 6) AS mean_score
FROM events GROUP BY 1, 2, 3""")
def x1_running_means(spark, sf):
    out, ck = scratch_path(spark, "x1_out"), scratch_path(spark, "x1_ck")
    for folder in _slices(spark, sf):
        X.running_means(X.scored_stream(spark, folder, None), out, ck).awaitTermination()
    r = X.latest_means(spark, out)
    return r.select("run", "step", "source", "n", rnd(F.col("score_sum") / F.col("n")).alias("mean_score"))


@register("X2", "WITH " + _SLICES_SQL + """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS source, count(*) AS n, round(avg(value), 6) AS mean_score
FROM r WHERE NOT late GROUP BY 1, 2""")
def x2_windowed(spark, sf):
    """Daily windows with a one-hour watermark (update mode): rows whose day is closed when they
    arrive are dropped."""
    out, ck = scratch_path(spark, "x2_out"), scratch_path(spark, "x2_ck")
    for folder in _slices(spark, sf):
        X.windowed_metrics(X.scored_stream(spark, folder, None), out, ck).awaitTermination()
    r = X.latest_windows(spark, out)
    return r.select(X.utc_day("window_start").cast("string").alias("day"), "source", "n",
                    rnd("mean_score").alias("mean_score"))


@register("X2_late", "WITH " + _SLICES_SQL + "SELECT event_id, event_type AS source, slice AS arrived, mark AS watermark FROM r WHERE late")
def x2_late_rows(spark, sf):
    """The rows that X2 drops, with the slice they came in and the watermark they missed."""
    out, ck = scratch_path(spark, "x2_late"), scratch_path(spark, "x2_late_ck")
    for folder in _slices(spark, sf):
        X.late_rows(X.scored_stream(spark, folder, None), out, ck).awaitTermination()
    return X.read_late_rows(spark, out).select("event_id", "source", F.col("batch_id").alias("arrived"),
                                               F.unix_seconds("watermark").alias("watermark"))
