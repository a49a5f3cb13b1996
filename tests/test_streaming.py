"""Watermark semantics of the streaming metrics: rows older than the watermark
are dropped once a later file has moved it."""

import json
import os

from gradewise.sources.io import scratch_path
from gradewise.streaming import metrics as X


def _write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def _row(i, ts, score):
    return {"run": "r", "step": 0, "source": "s", "event_id": i, "ts": ts, "score": score}


def test_late_rows_are_dropped(spark):
    base = scratch_path(spark, "t_stream").replace("file:", "")
    log = os.path.join(base, "log")
    _write(log, "a.json", [_row(1, "2024-01-01 10:00:00", 1.0), _row(2, "2024-01-03 12:00:00", 3.0)])
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")
    X.windowed_metrics(X.scored_stream(spark, log), out, ck).awaitTermination()
    # second arrival: one row for the closed first day (late), one for the open third day
    _write(log, "b.json", [_row(3, "2024-01-01 11:00:00", 100.0), _row(4, "2024-01-03 13:00:00", 5.0)])
    X.windowed_metrics(X.scored_stream(spark, log), out, ck).awaitTermination()
    rows = {str(X_day): (n, m) for X_day, n, m in
            X.latest_windows(spark, out).select(X.utc_day("window_start").cast("string"), "n", "mean_score").collect()}
    assert rows["2024-01-01"] == (1, 1.0)          # the late row did not change the closed day
    assert rows["2024-01-03"] == (2, 4.0)          # the on-time row was added


def test_late_and_kept_rows_add_up(spark):
    """Rows in any order: what the windows counted and what the table of late rows holds are all rows,
    and a micro-batch that is run again replaces its late rows."""
    base = scratch_path(spark, "t_late").replace("file:", "")
    log = os.path.join(base, "log")
    slices = [[_row(1, "2024-01-03 12:00:00", 1.0), _row(2, "2024-01-01 10:00:00", 2.0)],  # nothing before: none is late
              [_row(3, "2024-01-02 23:59:59", 3.0), _row(4, "2024-01-03 00:00:00", 4.0)],   # a closed day, an open one
              [],
              [_row(5, "2024-01-05 01:00:00", 5.0), _row(6, "2024-01-01 00:00:00", 6.0)],
              [_row(7, "2024-01-04 23:00:00", 7.0)],  # its day ended at the watermark
              [_row(8, "2024-01-05 00:00:00", 8.0)]]
    paths = {k: os.path.join(base, k) for k in ("out", "ck", "late", "late_ck")}
    for i, rows in enumerate(slices):
        _write(log, f"{i}.json", rows)
        X.windowed_metrics(X.scored_stream(spark, log, None), paths["out"], paths["ck"]).awaitTermination()
        X.late_rows(X.scored_stream(spark, log, None), paths["late"], paths["late_ck"]).awaitTermination()
    late = {r.event_id: r.watermark.isoformat(sep=" ") for r in X.read_late_rows(spark, paths["late"]).collect()}
    assert set(late) == {3, 6, 7}
    kept = X.latest_windows(spark, paths["out"]).selectExpr("sum(n)", "sum(n * mean_score)").first()
    assert tuple(kept) == (5, 1.0 + 2.0 + 4.0 + 5.0 + 8.0)


def test_idle_keys_are_written_once_and_leave_the_state(spark):
    base = scratch_path(spark, "t_closed").replace("file:", "")
    log, out, ck = (os.path.join(base, k) for k in ("log", "out", "ck"))

    def at(step, i, ts, score):
        return _row(i, ts, score) | {"step": step}
    slices = [[at(0, 1, "2024-01-01 20:00:00", 2.0), at(0, 2, "2024-01-01 10:00:00", 1.0)],
              [at(0, 3, "2024-01-02 06:00:00", 3.0), at(1, 4, "2024-01-03 08:00:00", 4.0)],  # step 0 is idle from here
              [at(0, 5, "2024-01-01 12:00:00", 100.0),                                       # too late: step 0 is closed
               at(0, 6, "2024-01-04 00:00:00", 5.0), at(1, 7, "2024-01-06 12:00:00", 6.0)],  # step 0 comes back
              [at(2, 8, "2024-01-06 12:00:00", 7.0)]]                                        # still open, as step 1 is
    for i, rows in enumerate(slices):
        _write(log, f"{i}.json", rows)
        X.closed_means(X.scored_stream(spark, log, None), out, ck).awaitTermination()
    rows = spark.read.parquet(out).orderBy("step", "first_at").collect()
    assert [(r.step, r.n, r.score_sum) for r in rows] == [(0, 3, 6.0), (0, 1, 5.0), (1, 1, 4.0)]
    assert (rows[0].closed_at - rows[0].first_at).total_seconds() == 86400 + 20 * 3600
