"""Metric queries (A4-A14) and the flagship training-step chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import rnd
from ..operators import advantage as adv
from ..operators import metrics as M
from ..session import table
from .credit import _GRPO_TOKENS_SQL
from .fixtures import rollouts
from .registry import register

MAX_RESPONSE_LEN, MAX_PROMPT_LEN = 8, 16

_A4_METRICS = [
    "score_mean", "score_max", "score_min", "rewards_mean", "rewards_max", "rewards_min",
    "advantages_mean", "advantages_max", "advantages_min", "advantages_zero",
    "returns_mean", "returns_max", "returns_min", "values_mean", "values_max", "values_min",
    "vf_explained_var", "response_length_mean", "response_length_max", "response_length_min",
    "response_length_clip_ratio", "prompt_length_mean", "prompt_length_max", "prompt_length_min",
    "prompt_length_clip_ratio"]


def _grpo_batch(spark, sf, kl_beta: float | None = None):
    ro = rollouts(spark, sf).withColumn("prompt_length", (F.col("uid") % 13 + 4).cast("int"))
    if kl_beta is not None:
        ro = adv.apply_kl_penalty(ro, beta=kl_beta, kind="low_var_kl")
    return adv.grpo_advantage(ro)


def _a4_long(spark, sf, kl_beta=None):
    batch = _grpo_batch(spark, sf, kl_beta)
    wide = M.data_metrics(batch, ["step"], MAX_RESPONSE_LEN, MAX_PROMPT_LEN)
    wide = wide.select("step", *[F.col(c).cast("double").alias(c) for c in _A4_METRICS])
    return M.to_long(wide, ["step"], _A4_METRICS)


def training_step_metrics(spark, sf):
    """Flagship: rollouts -> low-variance KL penalty -> GRPO -> per-step metrics."""
    return _a4_long(spark, sf, kl_beta=0.001).select("step", "metric", rnd("value").alias("value"))


_A4_SQL = "WITH " + _GRPO_TOKENS_SQL + f""",
seqm AS (SELECT uid, step, sum(score) AS sc, CAST(sum(mask) AS DOUBLE) AS rlen,
                CAST(uid % 13 + 4 AS DOUBLE) AS plen FROM tok GROUP BY uid, step),
s AS (SELECT step, avg(sc) AS score_mean, max(sc) AS score_max, min(sc) AS score_min,
             avg(sc) AS rewards_mean, max(sc) AS rewards_max, min(sc) AS rewards_min,
             avg(rlen) AS response_length_mean, max(rlen) AS response_length_max, min(rlen) AS response_length_min,
             avg(CASE WHEN rlen = {MAX_RESPONSE_LEN} THEN 1.0 ELSE 0.0 END) AS response_length_clip_ratio,
             avg(plen) AS prompt_length_mean, max(plen) AS prompt_length_max, min(plen) AS prompt_length_min,
             avg(CASE WHEN plen = {MAX_PROMPT_LEN} THEN 1.0 ELSE 0.0 END) AS prompt_length_clip_ratio
      FROM seqm GROUP BY step),
t AS (SELECT step, avg(advantage) AS advantages_mean, max(advantage) AS advantages_max,
             min(advantage) AS advantages_min,
             avg(CASE WHEN advantage = 0 THEN 1.0 ELSE 0.0 END) AS advantages_zero,
             avg(advantage) AS returns_mean, max(advantage) AS returns_max, min(advantage) AS returns_min,
             avg(val) AS values_mean, max(val) AS values_max, min(val) AS values_min,
             1.0 - var_samp(advantage - val) / (var_samp(advantage) + 1e-5) AS vf_explained_var
      FROM adv WHERE mask = 1 GROUP BY step),
w AS (SELECT * FROM s JOIN t USING (step))
SELECT step, metric, value
FROM w UNPIVOT (value FOR metric IN ({", ".join(_A4_METRICS)}))
"""


@register("A4", "SELECT step, metric, round(value, 6) AS value FROM (" + _A4_SQL + ")")
def a4_data_metrics(spark, sf):
    return _a4_long(spark, sf).select("step", "metric", rnd("value").alias("value"))


@register("A6", "SELECT metric, round(avg(value), 6) AS value FROM (" + _A4_SQL + ") GROUP BY metric")
def a6_reduce_metrics(spark, sf):
    long = _a4_long(spark, sf)
    return M.mean_per_key(long, ["metric"], "value").select("metric", rnd("value").alias("value"))


# sections charged per event type: fixed values of this fixture
_SECTION_OF = {"view": "gen", "click": "ref", "purchase": "values", "signup": "adv", "error": "update_actor"}


@register("A5", """
WITH ro AS (SELECT event_id // 1024 AS step, user_id, count(*) AS rlen, any_value(user_id % 13 + 4) AS plen
            FROM events GROUP BY 1, 2),
toks AS (SELECT step, sum(plen) AS pt, sum(rlen) AS rt FROM ro GROUP BY step),
tim AS (SELECT event_id // 1024 AS step,
               CASE event_type WHEN 'view' THEN 'gen' WHEN 'click' THEN 'ref' WHEN 'purchase' THEN 'values'
                    WHEN 'signup' THEN 'adv' WHEN 'error' THEN 'update_actor' END AS section,
               sum(value) / 1000.0 AS seconds
        FROM events GROUP BY 1, 2)
SELECT step, section, round(seconds, 6) AS timing_s,
       round(seconds * 1000.0 / CASE WHEN section = 'gen' THEN rt ELSE pt + rt END, 6) AS timing_per_token_ms
FROM tim JOIN toks USING (step)
""")
def a5_timing(spark, sf):
    ro = rollouts(spark, sf, write=False).select(
        "step", (F.col("uid") % 13 + 4).alias("prompt_length"),
        F.size("response_ids").alias("response_length"))
    ev = table(spark, sf, "events")
    sec = F.lit(None).cast("string")
    for k, v in reversed(list(_SECTION_OF.items())):
        sec = F.when(F.col("event_type") == k, F.lit(v)).otherwise(sec)
    timings = ev.groupBy(F.expr("event_id div 1024").alias("step"), sec.alias("section")).agg(
        (F.sum("value") / 1000.0).alias("seconds"))
    out = M.timing_metrics(ro, timings, ["step"])
    return out.select("step", "section", rnd("timing_s").alias("timing_s"),
                      rnd("timing_per_token_ms").alias("timing_per_token_ms"))


@register("A7", """
SELECT event_type AS data_source, round(avg(value), 6) AS test_score FROM events GROUP BY 1
""")
def a7_score_by_source(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("data_source"), "value")
    return M.mean_per_key(ev, ["data_source"], "value", "test_score").select(
        "data_source", rnd("test_score").alias("test_score"))


def _extra_map(ev):
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.withColumn("extra", F.create_map(F.lit("k"), k, F.lit("value"), F.col("value")))


@register("A8", """
SELECT event_type AS data_source, key, round(avg(v), 6) AS mean FROM (
  SELECT event_type, 'k' AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events
  UNION ALL SELECT event_type, 'value', value FROM events) GROUP BY 1, 2
""")
def a8_extra_means(spark, sf):
    ev = _extra_map(table(spark, sf, "events")).withColumnRenamed("event_type", "data_source")
    out = M.extra_score_means(ev, "data_source", "extra")
    return out.select("data_source", "key", rnd("mean").alias("mean"))


@register("A9", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, key, round(avg(v), 6) AS mean, round(max(v), 6) AS max,
       round(min(v), 6) AS min FROM (
  SELECT ts, 'k' AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events
  UNION ALL SELECT ts, 'value', value FROM events) GROUP BY 1, 2
""")
def a9_extra_reward_stats(spark, sf):
    ev = _extra_map(table(spark, sf, "events")).withColumn("day", F.to_date("ts").cast("string"))
    out = M.extra_reward_stats(ev, ["day"], "extra")
    return out.select("day", "key", rnd("mean").alias("mean"), rnd("max").alias("max"), rnd("min").alias("min"))


@register("A10", """
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS d, max(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS best,
                  count(*) AS k FROM events GROUP BY 1, 2)
SELECT round(avg(CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_at_k, max(k) AS k, count(*) AS n_prompts FROM p
""")
def a10_pass_at_k(spark, sf):
    ev = table(spark, sf, "events").select(
        F.struct("user_id", F.to_date("ts").alias("d")).alias("prompt"),
        F.when(F.col("value") > 100, 1).otherwise(0).alias("score"))
    out = M.pass_at_k(ev, "prompt", "score")
    return out.select(rnd("pass_at_k").alias("pass_at_k"), "k", "n_prompts")


@register("A11", """
SELECT lang AS subject, round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM documents GROUP BY ROLLUP (lang)
""")
def a11_accuracy(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("subject"),
                                             (F.col("n_chars") > 2000).alias("correct"))
    out = M.accuracy_by_subject(d, "subject", "correct")
    return out.select("subject", rnd("accuracy").alias("accuracy"), "n")


@register("A12", """
SELECT round(avg(m), 6) AS mean_loss, count(*) AS n_batches
FROM (SELECT event_id // 256 AS b, avg(value) AS m FROM events GROUP BY 1)
""")
def a12_mean_loss(spark, sf):
    ev = table(spark, sf, "events")
    per_batch = ev.groupBy(F.expr("event_id div 256").alias("b")).agg(F.avg("value").alias("m"))
    return per_batch.agg(rnd(F.avg("m")).alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))


# Qwen2-7B shape (fixed values of the FLOPs example)
_QWEN7B = dict(hidden=3584, vocab=152064, layers=28, heads=28, kv_heads=4, intermediate=18944)


@register("A13", """
WITH c AS (SELECT 3584::BIGINT AS h, 152064::BIGINT AS v, 28::BIGINT AS l, 28::BIGINT AS nh, 4::BIGINT AS kv, 18944::BIGINT AS im),
n AS (SELECT (h * im * 3 + h * ((nh * (h // nh)) + 2 * kv * (h // nh) + nh * (h // nh))) * l + v * h * 2 AS dense_n,
             h // nh AS hd, nh, l FROM c)
SELECT doc_id // 128 AS batch, CAST(sum(n_chars) AS DOUBLE) AS tokens_sum,
       round((6.0 * any_value(dense_n) * sum(n_chars)
              + 12.0 * sum(CAST(n_chars AS DOUBLE) * n_chars) * any_value(hd) * any_value(nh) * any_value(l)) / 1e12, 3) AS tflops
FROM documents, n GROUP BY 1
""")
def a13_flops(spark, sf):
    d = table(spark, sf, "documents").select(F.expr("doc_id div 128").alias("batch"), "n_chars")
    out = M.flops_estimate(d, ["batch"], "n_chars", **_QWEN7B)
    return out.select("batch", F.col("tokens_sum").cast("double").alias("tokens_sum"),
                      F.round("tflops", 3).alias("tflops"))


@register("A14", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def a14_distinct(spark, sf):
    d = table(spark, sf, "documents")
    # a 256-bit hash as the shuffle key instead of the text
    return (d.groupBy(F.sha2("text", 256).alias("_h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
             .drop("_h"))
