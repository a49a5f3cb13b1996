"""Source / sink queries (S1-S13): data is written under the shared
checkpoint folder and read back, so each query checks a round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import rnd
from ..operators.index import with_global_index
from ..session import table
from ..sources import io as S
from .registry import register


def _src(sf, name):
    return f"{sf.rstrip('/')}/{name}.parquet"


@register("S1", """
SELECT 0 AS file_order, r_regionkey AS key, r_name AS name FROM region
UNION ALL SELECT 1, n_nationkey, n_name FROM nation""")
def s1_read_many(spark, sf):
    df = spark.read.parquet(_src(sf, "region")).select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    df2 = spark.read.parquet(_src(sf, "nation")).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    path_a, path_b = (S.scratch_path(spark, x) + "/part" for x in ("s1_region", "s1_nation"))  # equal base names
    df.write.parquet(path_a)
    df2.write.parquet(path_b)
    both = S.read_parquet_files(spark, [path_a, path_b])
    return both.select("file_order", "key", "name")


@register("S2", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def s2_jsonl(spark, sf):
    path = S.scratch_path(spark, "s2_events")
    S.write_jsonl(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path)
    r = S.read_jsonl(spark, path, "event_id long, user_id long, event_type string, value double")
    return r.select("event_id", "user_id", "event_type", rnd("value").alias("value"))


@register("S3", """
SELECT u.text AS prompt, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
def s3_dialogues(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    pairs = u.join(a, ["conv_id", "turn"])
    gt_none = F.lit(None).cast("struct<value:string>")
    items = pairs.select(F.to_json(F.array(
        F.struct(F.lit("human").alias("from"), F.col("q").alias("value"), gt_none.alias("ground_truth")),
        F.struct(F.lit("assistant").alias("from"), F.lit(None).cast("string").alias("value"),
                 F.struct(F.col("r").alias("value")).alias("ground_truth")))).alias("value"))
    path = S.scratch_path(spark, "s3_dialogues")
    items.write.text(path)
    return S.read_dialogues(spark, path)


@register("S4", "SELECT lang AS split, count(*) AS n FROM documents GROUP BY 1")
def s4_parquet_splits(spark, sf):
    path = S.scratch_path(spark, "s4_docs")
    S.write_parquet_splits(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("S5", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def s5_write_jsonl(spark, sf):
    path = S.scratch_path(spark, "s5_conv")
    S.write_jsonl(table(spark, sf, "conversations"), path)
    r = S.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")
    return r.select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


@register("S7", "SELECT o_orderkey // 1000 AS batch_id, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey FROM orders) GROUP BY 1")
def s7_resumable(spark, sf):
    """First run writes the batches of the first half, the second run skips them and writes the rest."""
    o = with_global_index(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    path = S.scratch_path(spark, "s7_batches")
    n = o.count()
    first_batches = (-(-n // 1000)) // 2            # half of the batches, whole batches only
    S.resumable_write(o.filter(F.col("idx") < first_batches * 1000), path, "idx", 1000)
    S.resumable_write(o, path, "idx", 1000)
    return S.read_resumable(spark, path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@register("S8", "SELECT doc_id, n_chars > 2000 AS correct FROM documents")
def s8_resume_eval(spark, sf):
    """Stored results for labelled documents, new results only for the rest."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("correct"))
    stored = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    path = S.scratch_path(spark, "s8_results")
    stored.write.parquet(path)
    return S.resume_results(spark.read.parquet(path), d, ["doc_id"]).select("doc_id", "correct")


@register("S9", "SELECT event_id // 1024 AS step, event_id, round(value, 6) AS score FROM events")
def s9_step_log(spark, sf):
    ev = table(spark, sf, "events").select(F.expr("event_id div 1024").alias("step"), "event_id", F.col("value").alias("score"))
    path = S.scratch_path(spark, "s9_log")
    S.append_log(ev.filter(F.col("step") % 2 == 0), path)
    S.append_log(ev.filter(F.col("step") % 2 == 1), path)
    r = spark.read.json(path)
    return r.select(F.col("step").cast("long").alias("step"), "event_id", rnd("score").alias("score"))


@register("S10", "SELECT event_type AS metric, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def s10_metric_log(spark, sf):
    ev = table(spark, sf, "events")
    m = ev.groupBy(F.col("event_type").alias("metric"), F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("value"))
    path = S.scratch_path(spark, "s10_metrics")
    S.append_log(m.withColumn("run", F.lit("r0")), path, "day", fmt="parquet")
    return spark.read.parquet(path).select("metric", F.col("day").cast("string").alias("day"), rnd("value").alias("value"))


@register("S11", """
SELECT doc_id, lang AS "meta/lang", source AS "meta/origin/source", n_chars AS "meta/origin/n_chars" FROM documents""")
def s11_flatten(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.struct("lang", F.struct("source", "n_chars").alias("origin")).alias("meta"))
    return S.flatten(d)


@register("S12", """
WITH m AS (SELECT event_id // 1024 AS step, round(avg(value), 4) AS v FROM events GROUP BY 1)
SELECT max(v) AS best, max(v) > 20 AS passed FROM m""")
def s12_parse_log(spark, sf):
    ev = table(spark, sf, "events")
    long = ev.groupBy(F.expr("event_id div 1024").alias("step")).agg(F.round(F.avg("value"), 4).alias("value")) \
        .withColumn("metric", F.lit("critic/rewards/mean"))
    path = S.scratch_path(spark, "s12_lines")
    S.metric_lines(long).write.text(path)
    return S.best_value_check(S.parse_metric_lines(spark, path), "critic/rewards/mean", 20.0)


@register("S13", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def s13_save_load(spark, sf):
    path = S.scratch_path(spark, "s13_batch")
    S.save_batch(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    r = S.load_batch(spark, path)
    return r.select("o_orderkey", "o_custkey", rnd("o_totalprice").alias("o_totalprice"))
