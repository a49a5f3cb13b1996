"""Training / evaluation metrics (A2, A4-A14) as grouped aggregates.

Every metric is a partial aggregate over rows (or exploded tokens), so the
shuffle carries one small record per group and partition, whatever the skew.
Metric tables are long: (group keys..., metric, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_sum, masked_row_sum


def masked_variance(df: DataFrame, values: str, mask: str, batch_keys: list[str],
                    unbiased: bool = True) -> DataFrame:
    """A2: masked variance per batch; raises when the mask sums to 0 or 1 (unbiased)."""
    rows = df.select(*batch_keys,
                     masked_row_sum(values, mask).alias("_s"),
                     masked_row_sum(F.transform(F.col(values), lambda v: v * v), mask).alias("_ss"),
                     array_sum(mask, 0).cast("double").alias("_m"))
    agg = rows.groupBy(*batch_keys).agg(F.sum("_s").alias("s"), F.sum("_ss").alias("ss"),
                                        F.sum("_m").alias("m"))
    mean = F.col("s") / F.col("m")
    var = F.col("ss") / F.col("m") - mean * mean
    if unbiased:
        var = (F.when(F.col("m") == 0, F.raise_error(F.lit("masked variance of a batch without any valid token")))
               .when(F.col("m") == 1, F.raise_error(F.lit("masked variance needs two valid tokens")))
               .otherwise(var * F.col("m") / (F.col("m") - 1)))
    return agg.select(*batch_keys, var.alias("masked_var"))


def data_metrics(df: DataFrame, group_by: list[str], max_response_length: int,
                 max_prompt_length: int, use_critic: bool = True,
                 scores="token_level_scores", rewards="token_level_rewards",
                 adv="advantages", returns="returns", values="values",
                 mask="response_mask", prompt_len="prompt_length") -> DataFrame:
    """A4: score / reward / advantage / return / value / length statistics per batch.

    Sequence-level statistics come from row sums; token-level ones from the
    masked tokens.  The explained variance uses ``var_samp`` over tokens.  The
    token rows come from ``explode`` feeding a partial aggregate in the same
    code-generated stage, so they stream through and only one record per batch
    and partition is shuffled (a per-row struct accumulator was tried and was
    slower: it runs interpreted).
    """
    resp_len = array_sum(mask, 0).cast("double")
    seq = df.select(
        *group_by,
        array_sum(scores).alias("_score"), array_sum(rewards).alias("_reward"),
        resp_len.alias("_rlen"), F.col(prompt_len).cast("double").alias("_plen"),
        F.arrays_zip(F.col(adv).alias("a"), F.col(returns).alias("r"),
                     (F.col(values) if use_critic else F.col(returns)).alias("v"),
                     F.col(mask).alias("m")).alias("_tok"))
    tok = seq.select(*group_by, F.explode("_tok").alias("t")).filter(F.col("t.m") == 1)
    seq_aggs = seq.groupBy(*group_by).agg(
        F.avg("_score").alias("score_mean"), F.max("_score").alias("score_max"), F.min("_score").alias("score_min"),
        F.avg("_reward").alias("rewards_mean"), F.max("_reward").alias("rewards_max"), F.min("_reward").alias("rewards_min"),
        F.avg("_rlen").alias("response_length_mean"), F.max("_rlen").alias("response_length_max"),
        F.min("_rlen").alias("response_length_min"),
        F.avg(F.when(F.col("_rlen") == max_response_length, 1.0).otherwise(0.0)).alias("response_length_clip_ratio"),
        F.avg("_plen").alias("prompt_length_mean"), F.max("_plen").alias("prompt_length_max"),
        F.min("_plen").alias("prompt_length_min"),
        F.avg(F.when(F.col("_plen") == max_prompt_length, 1.0).otherwise(0.0)).alias("prompt_length_clip_ratio"))
    tok_aggs = [
        F.avg("t.a").alias("advantages_mean"), F.max("t.a").alias("advantages_max"), F.min("t.a").alias("advantages_min"),
        F.avg(F.when(F.col("t.a") == 0, 1.0).otherwise(0.0)).alias("advantages_zero"),
        F.avg("t.r").alias("returns_mean"), F.max("t.r").alias("returns_max"), F.min("t.r").alias("returns_min")]
    if use_critic:
        tok_aggs += [
            F.avg("t.v").alias("values_mean"), F.max("t.v").alias("values_max"), F.min("t.v").alias("values_min"),
            (1.0 - F.var_samp(F.col("t.r") - F.col("t.v")) / (F.var_samp("t.r") + 1e-5)).alias("vf_explained_var")]
    tok_agg = tok.groupBy(*group_by).agg(*tok_aggs)
    return seq_aggs.join(tok_agg, group_by) if group_by else seq_aggs.crossJoin(tok_agg)


def to_long(df: DataFrame, keys: list[str], metric_cols: list[str],
            metric="metric", value="value") -> DataFrame:
    """Wide metric row -> long (keys..., metric, value) table (S10 format)."""
    return df.unpivot(keys, metric_cols, metric, value)


def timing_metrics(batch_lengths: DataFrame, timings: DataFrame, group_by: list[str],
                   prompt_len="prompt_length", response_len="response_length") -> DataFrame:
    """A5: seconds per section and ms per token.

    ``timings`` has (group_by..., section, seconds).  The generation section
    is charged response tokens; ref/values/adv/update_* all tokens.
    """
    toks = batch_lengths.groupBy(*group_by).agg(
        F.sum(prompt_len).alias("_pt"), F.sum(response_len).alias("_rt"))
    t = timings.join(toks, group_by)
    per_tok = F.when(F.col("section") == "gen", F.col("_rt")).when(
        F.col("section").isin("ref", "values", "adv", "update_critic", "update_actor"),
        F.col("_pt") + F.col("_rt"))
    return t.select(*group_by, "section", F.col("seconds").alias("timing_s"),
                    (F.col("seconds") * 1000.0 / per_tok).alias("timing_per_token_ms"))


def mean_per_key(df: DataFrame, keys: list[str], value: str, out: str = "value") -> DataFrame:
    """Mean per key (metric name, data source, ...)."""
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def extra_score_means(df: DataFrame, source: str, extra_map: str) -> DataFrame:
    """Mean of every extra-info entry per (source, key) (fixed Q10: grouped by sample)."""
    kv = df.select(source, F.explode(extra_map).alias("key", "v"))
    return kv.groupBy(source, "key").agg(F.avg("v").alias("mean"))


def extra_reward_stats(df: DataFrame, group_by: list[str], extra_map: str) -> DataFrame:
    """Mean / max / min per extra reward key."""
    kv = df.select(*group_by, F.explode(extra_map).alias("key", "v"))
    return kv.groupBy(*group_by, "key").agg(F.avg("v").alias("mean"), F.max("v").alias("max"),
                                            F.min("v").alias("min"))


def pass_at_k(df: DataFrame, prompt_key: str, score: str, source: str | None = None) -> DataFrame:
    """A10: share of prompts whose best sample scores exactly 1 (k = samples per prompt)."""
    keys = [source] if source else []
    best = df.groupBy(*keys, prompt_key).agg(F.max(score).alias("_best"), F.count(F.lit(1)).alias("_k"))
    return best.groupBy(*keys).agg(
        F.avg(F.when(F.col("_best") == 1, 1.0).otherwise(0.0)).alias("pass_at_k"),
        F.max("_k").alias("k"), F.count(F.lit(1)).alias("n_prompts"))


def accuracy_by_subject(df: DataFrame, subject: str, correct: str) -> DataFrame:
    """Accuracy per subject and the sample-weighted accuracy (subject NULL row)."""
    return df.rollup(subject).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"),
                                  F.count(F.lit(1)).alias("n"))


def flops_estimate(df: DataFrame, group_by: list[str], seqlen: str, hidden: int, vocab: int,
                   layers: int, heads: int, kv_heads: int, intermediate: int,
                   seconds: Column | float = 1.0) -> DataFrame:
    """Dense 6·N·Σs plus attention 12·Σs²·head_dim·heads·layers, in TFLOP/s."""
    head_dim = hidden // heads
    q, k, v = heads * head_dim, kv_heads * head_dim, kv_heads * head_dim
    mlp = hidden * intermediate * 3
    attn_lin = hidden * (q + k + v + heads * head_dim)
    dense_n = (mlp + attn_lin) * layers + vocab * hidden * 2
    s = F.col(seqlen).cast("double")
    agg = df.groupBy(*group_by).agg(F.sum(s).alias("tokens_sum"), F.sum(s * s).alias("seqlen_sq_sum"))
    flops = 6.0 * dense_n * F.col("tokens_sum") + 12.0 * F.col("seqlen_sq_sum") * head_dim * heads * layers
    return agg.withColumn("tflops", flops / F.lit(seconds) / 1e12)
