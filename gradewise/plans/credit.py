"""Credit-assignment queries (W1-W13, A1-A3) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import array_sum, entropy_from_logits, logprob_of_label, masked_row_mean
from ..functions.common import rnd, seeded_draw, seeded_sql
from ..operators import advantage as adv
from ..session import table
from .fixtures import ROLLOUT_TOKENS_SQL, explode_tokens, rollouts
from .registry import register

GAMMA, LAM = 0.99, 0.95


@register("W1", """
SELECT event_id, user_id,
       round(CASE WHEN count(*) OVER w = 1 THEN value / (1 + 1e-6)
                  ELSE (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6) END, 6) AS advantage
FROM events WINDOW w AS (PARTITION BY user_id)
""")
def w1_grpo_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    out = adv.group_normalized_score(ev, "user_id", "value", "advantage")
    return out.select("event_id", "user_id", rnd("advantage").alias("advantage"))


@register("W2", """
SELECT event_id, user_id,
       round(CASE WHEN count(*) OVER w > 1
                  THEN value * count(*) OVER w / (count(*) OVER w - 1)
                       - avg(value) OVER w * count(*) OVER w / (count(*) OVER w - 1)
                  ELSE value END, 6) AS advantage
FROM events WINDOW w AS (PARTITION BY user_id)
""")
def w2_rloo_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    out = adv.leave_one_out_score(ev, "user_id", "value", "advantage")
    return out.select("event_id", "user_id", rnd("advantage").alias("advantage"))


_GRPO_TOKENS_SQL = ROLLOUT_TOKENS_SQL + """,
seq AS (SELECT uid, step, sum(score) AS s FROM tok GROUP BY uid, step),
grp AS (SELECT uid, count(*) AS g_n, avg(s) AS g_mean, stddev_samp(s) AS g_std FROM seq GROUP BY uid),
nrm AS (SELECT seq.uid, seq.step,
               CASE WHEN g_n = 1 THEN s / (1 + 1e-6) ELSE (s - g_mean) / (g_std + 1e-6) END AS a
        FROM seq JOIN grp USING (uid)),
adv AS (SELECT tok.*, nrm.a * tok.mask AS advantage FROM tok JOIN nrm USING (uid, step))
"""


@register("W1_tokens", "WITH " + _GRPO_TOKENS_SQL + """
SELECT uid, step, pos, round(advantage, 6) AS advantage FROM adv
""")
def w1_grpo_rollouts(spark, sf):
    out = adv.grpo_advantage(rollouts(spark, sf))
    long = explode_tokens(out, ["uid", "step"], ["advantages"])
    return long.select("uid", "step", "pos", rnd("advantages").alias("advantage"))


@register("W2_tokens", "WITH " + ROLLOUT_TOKENS_SQL + """,
seq AS (SELECT uid, step, sum(score) AS s FROM tok GROUP BY uid, step),
grp AS (SELECT uid, count(*) AS g_n, avg(s) AS g_mean FROM seq GROUP BY uid),
nrm AS (SELECT seq.uid, seq.step,
               CASE WHEN g_n > 1 THEN s * g_n / (g_n - 1) - g_mean * g_n / (g_n - 1) ELSE s END AS a
        FROM seq JOIN grp USING (uid))
SELECT uid, step, pos, round(nrm.a * mask, 6) AS advantage FROM tok JOIN nrm USING (uid, step)
""")
def w2_rloo_rollouts(spark, sf):
    out = adv.rloo_advantage(rollouts(spark, sf))
    long = explode_tokens(out, ["uid", "step"], ["advantages"])
    return long.select("uid", "step", "pos", rnd("advantages").alias("advantage"))


_GAE_SQL = ROLLOUT_TOKENS_SQL + f""",
d AS (SELECT *, score + {GAMMA} * coalesce(lead(val) OVER (PARTITION BY uid, step ORDER BY pos), 0) - val AS delta
      FROM tok),
g AS (SELECT *, sum(power({GAMMA * LAM}, pos) * delta) OVER (PARTITION BY uid, step ORDER BY pos
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / power({GAMMA * LAM}, pos) AS raw_adv
      FROM d),
mu AS (SELECT step, sum(raw_adv * mask) / sum(mask) AS mu FROM g GROUP BY step),
gae AS (SELECT g.*, raw_adv - mu AS advantage, raw_adv + val AS ret FROM g JOIN mu USING (step))
"""


@register("W3", "WITH " + _GAE_SQL + """
SELECT uid, step, pos, round(advantage, 6) AS advantage, round(ret, 6) AS ret FROM gae
""")
def w3_gae(spark, sf):
    ro = rollouts(spark, sf, "token_level_rewards", "values", "response_mask", write=False)
    out = adv.gae_advantage(ro, gamma=GAMMA, lam=LAM, batch_keys=["step"])
    long = explode_tokens(out, ["uid", "step"], ["advantages", "returns"])
    return long.select("uid", "step", "pos", rnd("advantages").alias("advantage"),
                       rnd("returns").alias("ret"))


@register("W4", "WITH " + ROLLOUT_TOKENS_SQL + f""",
r AS (SELECT *, CASE WHEN mask = 0 THEN score ELSE
        sum(CASE WHEN mask = 1 THEN power({GAMMA}, pos) * score ELSE 0 END) OVER (PARTITION BY uid, step ORDER BY pos
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / power({GAMMA}, pos) END AS ret
      FROM tok),
mu AS (SELECT step, sum(ret * mask) / sum(mask) AS mu FROM r GROUP BY step)
SELECT uid, step, pos, round((ret - mu) * mask, 6) AS advantage, round(ret, 6) AS ret FROM r JOIN mu USING (step)
""")
def w4_reinforce_pp(spark, sf):
    ro = rollouts(spark, sf, "token_level_rewards", "response_mask", write=False)
    out = adv.reinforce_pp_advantage(ro, gamma=GAMMA, batch_keys=["step"])
    long = explode_tokens(out, ["uid", "step"], ["advantages", "returns"])
    return long.select("uid", "step", "pos", rnd("advantages").alias("advantage"),
                       rnd("returns").alias("ret"))


def greedy_baselines(spark, sf):
    """J6 input: per-prompt greedy score, here the mean view value / 100 of the user."""
    ev = table(spark, sf, "events")
    return (ev.filter(F.col("event_type") == "view").groupBy(F.col("user_id").alias("uid"))
              .agg((F.avg("value") / 100.0).alias("reward_baselines")))


@register("W5", "WITH " + ROLLOUT_TOKENS_SQL + """,
base AS (SELECT user_id AS uid, avg(value) / 100.0 AS b FROM events WHERE event_type = 'view' GROUP BY user_id),
r AS (SELECT *, sum(score * mask) OVER (PARTITION BY uid, step ORDER BY pos
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM tok)
SELECT uid, step, pos, round(ret - b * mask, 6) AS advantage, round(ret, 6) AS ret
FROM r JOIN base USING (uid)
""")
def w5_remax(spark, sf):
    ro = rollouts(spark, sf).join(greedy_baselines(spark, sf), "uid")   # J6
    out = adv.remax_advantage(ro)
    long = explode_tokens(out, ["uid", "step"], ["advantages", "returns"])
    return long.select("uid", "step", "pos", rnd("advantages").alias("advantage"),
                       rnd("returns").alias("ret"))


@register("J6", """
SELECT user_id AS uid, (event_id // 1024) AS step, count(*) AS n_tokens, round(any_value(b), 6) AS baseline
FROM events JOIN (SELECT user_id, avg(value) / 100.0 AS b FROM events WHERE event_type = 'view' GROUP BY user_id) USING (user_id)
GROUP BY 1, 2
""")
def j6_baseline_join(spark, sf):
    ro = rollouts(spark, sf, write=False).join(greedy_baselines(spark, sf), "uid")
    return ro.select("uid", "step", F.size("response_ids").cast("long").alias("n_tokens"),
                     rnd("reward_baselines").alias("baseline"))


@register("W7", "WITH " + ROLLOUT_TOKENS_SQL + """
SELECT uid, step, pos,
       round(old_logp - ref_logp, 6) AS kl,
       round(abs(old_logp - ref_logp), 6) AS kl_abs,
       round(0.5 * (old_logp - ref_logp) * (old_logp - ref_logp), 6) AS kl_mse,
       round(least(greatest(exp(ref_logp - old_logp) - (ref_logp - old_logp) - 1, -10), 10), 6) AS kl_low_var
FROM tok
""")
def w7_kl(spark, sf):
    ro = rollouts(spark, sf, write=False)
    cols = {k: adv.kl_estimate("old_log_probs", "ref_log_prob", kind)
            for k, kind in [("kl", "kl"), ("kl_abs", "abs"), ("kl_mse", "mse"), ("kl_low_var", "low_var_kl")]}
    long = explode_tokens(ro.select("uid", "step", *[c.alias(k) for k, c in cols.items()]),
                          ["uid", "step"], list(cols))
    return long.select("uid", "step", "pos", *[rnd(k).alias(k) for k in cols])


@register("W8", "WITH " + ROLLOUT_TOKENS_SQL + """
SELECT uid, step,
       round(sum((old_logp - ref_logp) * mask) / sum(mask), 6) AS row_kl,
       round(sum(score - 0.1 * (old_logp - ref_logp) * mask), 6) AS reward
FROM tok GROUP BY uid, step
""")
def w8_kl_penalty(spark, sf):
    out = adv.apply_kl_penalty(rollouts(spark, sf, write=False), beta=0.1, kind="kl")
    return out.select("uid", "step", rnd("row_kl").alias("row_kl"),
                      rnd(array_sum("token_level_rewards")).alias("reward"))


@register("W8_batch", "WITH " + ROLLOUT_TOKENS_SQL + """,
rows AS (SELECT uid, step, sum((old_logp - ref_logp) * mask) / sum(mask) AS row_kl FROM tok GROUP BY uid, step)
SELECT step, round(avg(row_kl), 6) AS batch_kl, count(*) AS n_rows FROM rows GROUP BY step
""")
def w8_batch_kl(spark, sf):
    out = adv.apply_kl_penalty(rollouts(spark, sf, write=False), beta=0.1, kind="kl")
    return out.groupBy("step").agg(rnd(F.avg("row_kl")).alias("batch_kl"),
                                   F.count(F.lit(1)).alias("n_rows"))


def _daily_kl(spark, sf):
    ev = table(spark, sf, "events")
    kl = (-F.log(1.0 + F.col("value")) / 10.0) - (-F.col("value") / 1000.0 - 0.05)
    return (ev.groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("day"))
              .agg(F.avg(kl).alias("current_kl"), F.count(F.lit(1)).alias("n_steps")))


@register("W9", """
WITH d AS (
  SELECT event_type AS run, CAST(ts AS DATE) AS day,
         avg((-ln(1 + value) / 10.0) - (-value / 1000.0 - 0.05)) AS current_kl, count(*) AS n_steps
  FROM events GROUP BY 1, 2),
m AS (SELECT *, 1 + least(greatest(current_kl / 0.1 - 1, -0.2), 0.2) * n_steps / 10000.0 AS mult FROM d)
SELECT run, CAST(day AS VARCHAR) AS day,
       round(0.2 * exp(coalesce(sum(ln(mult)) OVER (PARTITION BY run ORDER BY day
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 8) AS kl_coef
FROM m
""")
def w9_adaptive_kl(spark, sf):
    out = adv.adaptive_kl_coef(_daily_kl(spark, sf), init_coef=0.2, target=0.1, horizon=10000.0,
                               step="day")
    return out.select("run", F.col("day").cast("string").alias("day"),
                      F.round("kl_coef", 8).alias("kl_coef"))


@register("W10", "WITH " + _GRPO_TOKENS_SQL + """,
p AS (SELECT *, exp(logp - old_logp) AS ratio FROM adv),
q AS (SELECT *, -advantage * ratio AS l1, -advantage * least(greatest(ratio, 0.8), 1.2) AS l2 FROM p)
SELECT step, round(sum(greatest(l1, l2) * mask) / sum(mask), 6) AS pg_loss,
       round(sum(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END * mask) / sum(mask), 6) AS pg_clipfrac,
       round(sum(-(logp - old_logp) * mask) / sum(mask), 6) AS ppo_kl
FROM q GROUP BY step
""")
def w10_policy_loss(spark, sf):
    out = adv.grpo_advantage(rollouts(spark, sf))
    res = adv.policy_loss(out, ["step"])
    return res.select("step", *[rnd(c).alias(c) for c in ("pg_loss", "pg_clipfrac", "ppo_kl")])


@register("W11", "WITH " + _GAE_SQL + """,
c AS (SELECT *, greatest(least(vpred, val + 0.5), val - 0.5) AS vclip FROM gae),
l AS (SELECT *, (vpred - ret) * (vpred - ret) AS l1, (vclip - ret) * (vclip - ret) AS l2 FROM c)
SELECT step, round(0.5 * sum(greatest(l1, l2) * mask) / sum(mask), 6) AS vf_loss,
       round(sum(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END * mask) / sum(mask), 6) AS vf_clipfrac
FROM l GROUP BY step
""")
def w11_value_loss(spark, sf):
    ro = rollouts(spark, sf, "token_level_rewards", "values", "response_mask", "vpreds", write=False)
    out = adv.gae_advantage(ro, gamma=GAMMA, lam=LAM, batch_keys=["step"])
    res = adv.value_loss(out, ["step"], clip=0.5)
    return res.select("step", rnd("vf_loss").alias("vf_loss"), rnd("vf_clipfrac").alias("vf_clipfrac"))


_EMB_LSE_SQL = """
e AS (SELECT vec_id, label, CAST(embedding[label + 1] AS DOUBLE) AS picked, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT vec_id, max(x) AS mx FROM e GROUP BY vec_id),
lse AS (SELECT vec_id, any_value(label) AS label, any_value(picked) AS picked,
               any_value(mx) + ln(sum(exp(x - mx))) AS lse,
               sum(exp(x - mx) * x) / sum(exp(x - mx)) AS px
        FROM e JOIN m USING (vec_id) GROUP BY vec_id)
"""


@register("W12", "WITH " + _EMB_LSE_SQL + """
SELECT label, round(avg(lse - px), 6) AS entropy_loss FROM lse GROUP BY label
""")
def w12_entropy_loss(spark, sf):
    emb = table(spark, sf, "embeddings")
    rows = emb.select("label", F.array(entropy_from_logits("embedding")).alias("ent"),
                      F.array(F.lit(1)).alias("m"))
    res = adv.masked_batch_mean(rows, ["label"], F.col("ent"), "m", "entropy_loss")
    return res.select("label", rnd("entropy_loss").alias("entropy_loss"))


@register("W13", "WITH " + _EMB_LSE_SQL + """,
s AS (SELECT vec_id // 8 AS seq, vec_id % 8 AS pos, -(picked - lse) AS loss,
             count(*) OVER (PARTITION BY vec_id // 8) AS n FROM lse)
SELECT seq // 8 AS batch, round(sum(loss * CASE WHEN pos >= 2 THEN 1 ELSE 0 END)
                          / sum(CASE WHEN pos >= 2 THEN 1 ELSE 0 END), 6) AS sft_loss
FROM s WHERE pos < n - 1 GROUP BY 1
""")
def w13_sft_loss(spark, sf):
    """Token losses = -log p(label | embedding logits); sequences of 8 vectors;
    the first two positions are prompt (loss mask 0)."""
    emb = table(spark, sf, "embeddings")
    tok = emb.select((F.col("vec_id") / 8).cast("long").alias("seq"),
                     F.col("vec_id"),
                     (-logprob_of_label("embedding", "label")).alias("loss"))
    seqs = tok.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("vec_id", "loss"))).alias("t"))
    seqs = seqs.select((F.col("seq") / 8).cast("long").alias("batch"),
                       F.transform("t", lambda x: x["loss"]).alias("token_loss"),
                       F.transform("t", lambda x: F.when((x["vec_id"] % 8) >= 2, 1).otherwise(0)).alias("loss_mask"))
    res = adv.sft_loss(seqs, ["batch"])
    return res.select("batch", rnd("sft_loss").alias("sft_loss"))


# --- A1-A3: masked statistics -------------------------------------------------

@register("A1", "WITH " + ROLLOUT_TOKENS_SQL + """
SELECT uid, step, round(sum(score * mask), 6) AS masked_sum,
       round(sum(score * mask) / sum(mask), 6) AS masked_mean
FROM tok GROUP BY uid, step
""")
def a1_masked_mean(spark, sf):
    ro = rollouts(spark, sf, write=False)
    from ..functions.arrays import masked_row_sum
    return ro.select("uid", "step", rnd(masked_row_sum("token_level_scores", "response_mask")).alias("masked_sum"),
                     rnd(masked_row_mean("token_level_scores", "response_mask")).alias("masked_mean"))


@register("A2", "WITH " + ROLLOUT_TOKENS_SQL + """,
mu AS (SELECT step, sum(score * mask) / sum(mask) AS mu, sum(mask) AS m FROM tok GROUP BY step)
SELECT step, round(sum((score - mu) * (score - mu) * mask) / any_value(m) * any_value(m) / (any_value(m) - 1), 6) AS masked_var
FROM tok JOIN mu USING (step) GROUP BY step
""")
def a2_masked_var(spark, sf):
    from ..operators.metrics import masked_variance
    res = masked_variance(rollouts(spark, sf, write=False), "token_level_scores", "response_mask", ["step"])
    return res.select("step", rnd("masked_var").alias("masked_var"))


@register("A3", "WITH " + ROLLOUT_TOKENS_SQL + """,
mu AS (SELECT sum(score * mask) / sum(mask) AS mu FROM tok)
SELECT uid, step, pos, round(score - mu, 6) AS whitened FROM tok, mu
""")
def a3_whiten(spark, sf):
    out = adv.masked_whiten(rollouts(spark, sf), "token_level_scores", "response_mask", "whitened")
    long = explode_tokens(out, ["uid", "step"], ["whitened"])
    return long.select("uid", "step", "pos", rnd("whitened").alias("whitened"))


@register("W6", "WITH " + _GRPO_TOKENS_SQL + """
SELECT 'grpo' AS estimator, step, round(sum(advantage), 6) AS adv_sum FROM adv GROUP BY step
UNION ALL
SELECT 'reinforce_plus_plus', step, round(sum(adv), 6) FROM (
  SELECT r.step, (r.ret - mu.mu) * r.mask AS adv FROM (
    SELECT *, CASE WHEN mask = 0 THEN score ELSE
      sum(CASE WHEN mask = 1 THEN power(0.99, pos) * score ELSE 0 END) OVER (PARTITION BY uid, step ORDER BY pos
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / power(0.99, pos) END AS ret FROM tok) r
  JOIN (SELECT step, sum(ret * mask) / sum(mask) AS mu FROM (
    SELECT *, CASE WHEN mask = 0 THEN score ELSE
      sum(CASE WHEN mask = 1 THEN power(0.99, pos) * score ELSE 0 END) OVER (PARTITION BY uid, step ORDER BY pos
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / power(0.99, pos) END AS ret FROM tok) GROUP BY step) mu
  USING (step)) GROUP BY step
""")
def w6_estimator_switch(spark, sf):
    """The estimator chosen by name (unknown names raise); two estimators shown."""
    ro = rollouts(spark, sf)
    out = None
    for name, kw in [("grpo", {}), ("reinforce_plus_plus", {"gamma": GAMMA, "batch_keys": ["step"]})]:
        a = adv.compute_advantage(ro, name, **kw)
        r = a.groupBy("step").agg(rnd(F.sum(array_sum("advantages"))).alias("adv_sum")).withColumn("estimator", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out.select("estimator", "step", "adv_sum")


@register("W14", "SELECT event_id, user_id, event_type FROM events ORDER BY "
          + seeded_sql("event_id", 5)
          + ", event_id LIMIT 50")
def w14_validation_sample(spark, sf):
    """Deterministic sample of 50 validation rows: seeded order, then the first 50 (the limit is the feature)."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ev.orderBy(seeded_draw("event_id", 5), "event_id").limit(50)


@register("J2", """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS group_n,
       round(avg(value) OVER (PARTITION BY user_id), 6) AS group_mean FROM events""")
def j2_group_stats_to_rows(spark, sf):
    """Group statistics joined back to every row by uid (partial aggregate + join, skew-safe)."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    stats = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("group_n"), F.avg("value").alias("group_mean"))
    return ev.join(stats, "user_id").select("event_id", "user_id", "group_n", rnd("group_mean").alias("group_mean"))
