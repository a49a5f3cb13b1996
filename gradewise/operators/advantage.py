"""Credit assignment over rollout tables.

A rollout table has one row per sampled response with token arrays aligned by
position (rewards, mask, values, log-probs).  Group statistics (GRPO, RLOO) are
computed with ``groupBy`` + join back rather than a window: the aggregate is
partial (map-side combine) and the join lets AQE split a hot group, where a
window would sort a whole hot group inside one task.  Batch-wide centring uses
a scalar subquery (one broadcast number), or a per-batch aggregate when batch
keys are given.  Backward scans (GAE, discounted returns) run in an Arrow-
batched pandas UDF, vectorised over rows; everything else is native.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import array_sum, masked_row_mean, masked_row_sum
from ..functions.common import as_col
from ..session import ensure_checkpoint_dir

EPS = 1e-6


# --- W1 / W2: group-normalised outcome advantages ----------------------------

def _group_stats(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_g_n"),
        F.avg(score).alias("_g_mean"),
        F.stddev_samp(score).alias("_g_std"))


def group_normalized_score(df: DataFrame, uid: str | list[str], score: str,
                           out: str = "norm_score", eps: float = EPS) -> DataFrame:
    """W1 on a scalar score column: ``(s - mean_g) / (std_g + eps)``.

    A single-member group uses mean 0 and std 1 (as the reference does).
    """
    keys = [uid] if isinstance(uid, str) else list(uid)
    stats = _group_stats(df, keys, score)
    s = F.col(score).cast("double")
    norm = F.when(F.col("_g_n") == 1, s / (1.0 + eps)).otherwise(
        (s - F.col("_g_mean")) / (F.col("_g_std") + eps))
    return df.join(stats, keys).withColumn(out, norm).drop("_g_n", "_g_mean", "_g_std")


def leave_one_out_score(df: DataFrame, uid: str | list[str], score: str,
                        out: str = "loo_score") -> DataFrame:
    """W2 on a scalar score: ``s·n/(n-1) - mean·n/(n-1)``; single member unchanged."""
    keys = [uid] if isinstance(uid, str) else list(uid)
    stats = _group_stats(df, keys, score)
    s, n, mean = F.col(score).cast("double"), F.col("_g_n"), F.col("_g_mean")
    val = F.when(n > 1, s * n / (n - 1) - mean * n / (n - 1)).otherwise(s)
    return df.join(stats, keys).withColumn(out, val).drop("_g_n", "_g_mean", "_g_std")


def grpo_advantage(df: DataFrame, uid="uid", rewards="token_level_rewards",
                   mask="response_mask", eps: float = EPS) -> DataFrame:
    """Outcome score = Σ token rewards, normalised per uid, spread over the mask."""
    scored = df.withColumn("_score", array_sum(rewards))
    out = group_normalized_score(scored, uid, "_score", "_adv", eps)
    adv = F.transform(F.col(mask), lambda m: F.col("_adv") * m)
    return out.withColumn("advantages", adv).withColumn("returns", adv).drop("_score", "_adv")


def rloo_advantage(df: DataFrame, uid="uid", rewards="token_level_rewards",
                   mask="response_mask") -> DataFrame:
    """Leave-one-out baseline per uid, spread over the mask."""
    scored = df.withColumn("_score", array_sum(rewards))
    out = leave_one_out_score(scored, uid, "_score", "_adv")
    adv = F.transform(F.col(mask), lambda m: F.col("_adv") * m)
    return out.withColumn("advantages", adv).withColumn("returns", adv).drop("_score", "_adv")


# --- A3: masked centring ------------------------------------------------------

def masked_whiten(df: DataFrame, values: str, mask: str, out: str,
                  batch_keys: list[str] | None = None, scale: bool = False,
                  shift_mean: bool = True) -> DataFrame:
    """A3: ``values - masked_mean`` over the batch (Q1: no division by std unless ``scale``).

    The masked variance is still checked: a batch whose mask sums to 0 or 1
    raises, as in the reference.  Without ``batch_keys`` the whole table is one
    batch and its statistics come from a scalar subquery.
    """
    row = df.select(*(batch_keys or []),
                    masked_row_sum(values, mask).alias("_s"),
                    masked_row_sum(F.transform(F.col(values), lambda v: v * v), mask).alias("_ss"),
                    array_sum(mask, 0).cast("double").alias("_m"))
    aggs = [F.sum("_s").alias("_w_s"), F.sum("_ss").alias("_w_ss"), F.sum("_m").alias("_w_m")]
    if batch_keys:
        stats = row.groupBy(*batch_keys).agg(*aggs)
        base = df.join(stats, batch_keys)
        s, ss, m = F.col("_w_s"), F.col("_w_ss"), F.col("_w_m")
    else:
        stats = row.agg(*aggs)
        # scalar subqueries cannot sit inside lambdas: bind them to columns first
        base = (df.withColumn("_w_s", stats.select("_w_s").scalar())
                  .withColumn("_w_ss", stats.select("_w_ss").scalar())
                  .withColumn("_w_m", stats.select("_w_m").scalar()))
        s, ss, m = F.col("_w_s"), F.col("_w_ss"), F.col("_w_m")
    mean = s / m
    var = (ss / m - mean * mean) * m / (m - 1)
    checked_mean = (F.when(m == 0, F.raise_error(F.lit("masked mean of a batch without any valid token")))
                    .when(m == 1, F.raise_error(F.lit("masked variance needs two valid tokens")))
                    .otherwise(mean))
    if scale:
        fn = lambda v: (v - checked_mean) / F.sqrt(var + 1e-8)
    else:
        fn = lambda v: v - checked_mean
    res = base.withColumn(out, F.transform(F.col(values), fn))
    if not shift_mean:
        res = res.withColumn(out, F.transform(F.col(out), lambda v: v + mean))
    return res.drop("_w_s", "_w_ss", "_w_m")


# --- backward scans (W3, W4, W5) ---------------------------------------------

def _suffix_scan_np(xs: pd.Series, resets: pd.Series | None, factor: float,
                    chunk: int = 256) -> pd.Series:
    """out[t] = x[t] + factor * carry, carry = out[t] * reset[t] (reset defaults to 1).

    Rows are right-padded with zeros into a (rows x len) block and scanned
    column by column, so the Python loop runs over positions, not rows.
    """
    out = [None] * len(xs)
    arrs = [np.asarray(a, dtype=np.float64) if a is not None else None for a in xs]
    rs = None
    if resets is not None:
        rs = [np.asarray(a, dtype=np.float64) if a is not None else None for a in resets]
    for lo in range(0, len(arrs), chunk):
        idx = [i for i in range(lo, min(lo + chunk, len(arrs))) if arrs[i] is not None]
        if not idx:
            continue
        width = max(len(arrs[i]) for i in idx)
        if width == 0:
            for i in idx:
                out[i] = arrs[i]
            continue
        block = np.zeros((len(idx), width))
        keep = np.ones((len(idx), width))
        for r, i in enumerate(idx):
            block[r, :len(arrs[i])] = arrs[i]
            if rs is not None:
                keep[r, :len(rs[i])] = rs[i]
        res = np.empty_like(block)
        carry = np.zeros(len(idx))
        for t in range(width - 1, -1, -1):
            carry = block[:, t] + factor * carry
            res[:, t] = carry
            carry = carry * keep[:, t]
        for r, i in enumerate(idx):
            out[i] = res[r, :len(arrs[i])]
    return pd.Series(out)


def suffix_scan(x, factor: float, reset=None) -> Column:
    """Discounted suffix sum of an array column (Arrow-batched pandas UDF)."""
    if reset is None:
        @F.pandas_udf("array<double>")
        def _scan(xs: pd.Series) -> pd.Series:
            return _suffix_scan_np(xs, None, factor)
        return _scan(as_col(x))

    @F.pandas_udf("array<double>")
    def _scan_reset(xs: pd.Series, rs: pd.Series) -> pd.Series:
        return _suffix_scan_np(xs, rs, factor)
    return _scan_reset(as_col(x), as_col(reset))


def scanned_once(df: DataFrame) -> DataFrame:
    """The frame with its scan column, written to the shared checkpoint folder: the statistics
    and the output both read it, and the Python scan must not run for each of them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gae_advantage(df: DataFrame, rewards="token_level_rewards", values="values",
                  mask="response_mask", gamma: float = 1.0, lam: float = 1.0,
                  batch_keys: list[str] | None = None) -> DataFrame:
    """GAE (mask ignored inside the recursion, Q2), returns = adv + values,
    then masked centring of the advantages over the batch."""
    v = F.col(values)
    delta = F.zip_with(F.col(rewards), v, lambda r, vt: r - vt)
    nxt = F.transform(v, lambda _x, i: F.coalesce(F.try_element_at(v, i + 2), F.lit(0.0)))
    delta = F.zip_with(delta, nxt, lambda d, nv: d + F.lit(gamma) * nv)
    out = scanned_once(df.withColumn("_raw_adv", suffix_scan(delta, gamma * lam)))
    out = out.withColumn("returns", F.zip_with(F.col("_raw_adv"), v, lambda a, b: a + b))
    return masked_whiten(out, "_raw_adv", mask, "advantages", batch_keys).drop("_raw_adv")


def reinforce_pp_advantage(df: DataFrame, rewards="token_level_rewards", mask="response_mask",
                           gamma: float = 1.0, batch_keys: list[str] | None = None) -> DataFrame:
    """Discounted return reset after the mask ends, centred, times mask."""
    out = scanned_once(df.withColumn("returns", suffix_scan(F.col(rewards), gamma, reset=F.col(mask))))
    out = masked_whiten(out, "returns", mask, "_adv", batch_keys)
    return out.withColumn("advantages", F.zip_with(F.col("_adv"), F.col(mask), lambda a, m: a * m)).drop("_adv")


def remax_advantage(df: DataFrame, rewards="token_level_rewards", mask="response_mask",
                    baseline="reward_baselines") -> DataFrame:
    """Reverse cumulative masked reward minus the greedy baseline on valid tokens."""
    masked = F.zip_with(F.col(rewards), F.col(mask), lambda r, m: r * m)
    out = df.withColumn("returns", suffix_scan(masked, 1.0))
    return out.withColumn("advantages", F.zip_with(
        F.col("returns"), F.col(mask), lambda r, m: r - F.col(baseline) * m))


# --- W6: estimator switch -----------------------------------------------------

ESTIMATORS = {
    "gae": gae_advantage,
    "grpo": grpo_advantage,
    "rloo": rloo_advantage,
    "reinforce_plus_plus": reinforce_pp_advantage,
    "remax": remax_advantage,
}


def compute_advantage(df: DataFrame, estimator: str, **kwargs) -> DataFrame:
    try:
        fn = ESTIMATORS[estimator]
    except KeyError:
        raise NotImplementedError(f"unknown advantage estimator {estimator!r}") from None
    return fn(df, **kwargs)


# --- W7 / W8: KL ----------------------------------------------------------------

def kl_estimate(logp, ref_logp, kind: str = "kl") -> Column:
    """Per-token KL estimate between policy and reference log-probs."""
    logp, ref_logp = as_col(logp), as_col(ref_logp)
    if kind == "kl":
        return F.zip_with(logp, ref_logp, lambda a, b: a - b)
    if kind == "abs":
        return F.zip_with(logp, ref_logp, lambda a, b: F.abs(a - b))
    if kind == "mse":
        return F.zip_with(logp, ref_logp, lambda a, b: 0.5 * (a - b) * (a - b))
    if kind == "low_var_kl":
        def lv(a, b):
            kl = b - a
            return F.least(F.greatest(F.exp(kl) - kl - 1, F.lit(-10.0)), F.lit(10.0))
        return F.zip_with(logp, ref_logp, lv)
    raise NotImplementedError(f"unknown kl penalty {kind!r}")


def apply_kl_penalty(df: DataFrame, beta: float | Column, kind: str = "kl",
                     scores="token_level_scores", logp="old_log_probs",
                     ref_logp="ref_log_prob", mask="response_mask") -> DataFrame:
    """``rewards = scores - beta·kl·mask`` and per-row masked-mean KL (``row_kl``).

    The batch KL of the reference is ``avg(row_kl)``; see ``metrics.kl_metrics``.
    """
    kld = F.zip_with(kl_estimate(logp, ref_logp, kind), F.col(mask), lambda k, m: k * m)
    beta = as_col(beta)
    return (df.withColumn("_kld", kld)
              .withColumn("token_level_rewards",
                          F.zip_with(F.col(scores), F.col("_kld"), lambda s, k: s - beta * k))
              .withColumn("row_kl", masked_row_mean("_kld", mask))
              .drop("_kld"))


def adaptive_kl_coef(steps: DataFrame, init_coef: float, target: float, horizon: float,
                     run="run", step="step", current_kl="current_kl", n_steps="n_steps") -> DataFrame:
    """Coefficient in force at each step of each run.

    ``value *= 1 + clip(kl/target - 1, ±0.2)·n/horizon`` after every step; the
    multiplier does not depend on the value, so the coefficient is a running
    product over earlier steps: ``init · exp(Σ ln mult)``.  Runs are the window
    partitions; steps inside one run are few (one per training step).
    """
    err = F.least(F.greatest(F.col(current_kl) / target - 1, F.lit(-0.2)), F.lit(0.2))
    mult = 1 + err * F.col(n_steps) / horizon
    safe = F.when(mult > 0, mult).otherwise(F.raise_error(F.lit("adaptive KL multiplier must be positive")))
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return (steps.withColumn("_ln_mult", F.log(safe))
            .withColumn("kl_coef", init_coef * F.exp(F.coalesce(F.sum("_ln_mult").over(w), F.lit(0.0))))
            .withColumn("next_kl_coef", F.col("kl_coef") * F.exp(F.col("_ln_mult")))
            .drop("_ln_mult"))


# --- W10-W13: losses as masked means over the batch ---------------------------

def policy_loss(df: DataFrame, group_by: list[str], logp="log_probs", old_logp="old_log_probs",
                adv="advantages", mask="response_mask", clip_low: float = 0.2,
                clip_high: float = 0.2) -> DataFrame:
    """Clipped surrogate loss, clip fraction and approx KL per batch."""
    neg_kl = F.zip_with(F.col(logp), F.col(old_logp), lambda a, b: a - b)
    z = F.arrays_zip(neg_kl.alias("nk"), F.col(adv).alias("a"))

    def loss(s):
        ratio = F.exp(s["nk"])
        l1 = -s["a"] * ratio
        l2 = -s["a"] * F.least(F.greatest(ratio, F.lit(1.0 - clip_low)), F.lit(1.0 + clip_high))
        return F.struct(F.greatest(l1, l2).alias("loss"), F.when(l2 > l1, 1.0).otherwise(0.0).alias("clip"))
    parts = F.transform(z, loss)
    rows = df.select(*group_by,
                     masked_row_sum(F.transform(parts, lambda p: p["loss"]), mask).alias("_l"),
                     masked_row_sum(F.transform(parts, lambda p: p["clip"]), mask).alias("_c"),
                     masked_row_sum(F.transform(neg_kl, lambda x: -x), mask).alias("_k"),
                     array_sum(mask, 0).cast("double").alias("_m"))
    return rows.groupBy(*group_by).agg(
        (F.sum("_l") / F.sum("_m")).alias("pg_loss"),
        (F.sum("_c") / F.sum("_m")).alias("pg_clipfrac"),
        (F.sum("_k") / F.sum("_m")).alias("ppo_kl"))


def value_loss(df: DataFrame, group_by: list[str], vpreds="vpreds", returns="returns",
               values="values", mask="response_mask", clip: float = 0.5) -> DataFrame:
    """Clipped value loss (0.5 · masked mean of the max) and clip fraction."""
    z = F.arrays_zip(F.col(vpreds).alias("p"), F.col(returns).alias("r"), F.col(values).alias("v"))

    def one(s):
        clipped = F.greatest(F.least(s["p"], s["v"] + clip), s["v"] - clip)
        l1 = (s["p"] - s["r"]) * (s["p"] - s["r"])
        l2 = (clipped - s["r"]) * (clipped - s["r"])
        return F.struct(F.greatest(l1, l2).alias("loss"), F.when(l2 > l1, 1.0).otherwise(0.0).alias("clip"))
    parts = F.transform(z, one)
    rows = df.select(*group_by,
                     masked_row_sum(F.transform(parts, lambda p: p["loss"]), mask).alias("_l"),
                     masked_row_sum(F.transform(parts, lambda p: p["clip"]), mask).alias("_c"),
                     array_sum(mask, 0).cast("double").alias("_m"))
    return rows.groupBy(*group_by).agg(
        (0.5 * F.sum("_l") / F.sum("_m")).alias("vf_loss"),
        (F.sum("_c") / F.sum("_m")).alias("vf_clipfrac"))


def masked_batch_mean(df: DataFrame, group_by: list[str], token_values: Column, mask: str,
                      out: str) -> DataFrame:
    """W12/W13 building block: Σ x·m / Σ m per batch (partial aggregates)."""
    rows = df.select(*group_by, masked_row_sum(token_values, mask).alias("_x"),
                     array_sum(mask, 0).cast("double").alias("_m"))
    return rows.groupBy(*group_by).agg((F.sum("_x") / F.sum("_m")).alias(out))


def sft_loss(df: DataFrame, group_by: list[str], token_loss="token_loss",
             loss_mask="loss_mask", out="sft_loss") -> DataFrame:
    """Next-token loss; loss at position t predicts t+1, so the mask drops its last item."""
    n = F.size(F.col(loss_mask)) - 1
    rows = df.select(*group_by, F.slice(F.col(loss_mask), 1, n).alias("_lm"),
                     F.slice(F.col(token_loss), 1, n).alias("_tl"))
    return masked_batch_mean(rows, group_by, F.col("_tl"), "_lm", out)
