"""Derived input tables built by Spark from the driver tables.

Every fixture reads a driver table and grows with it.  Groups that are
collected into arrays are bounded by construction: a rollout is one user's
events inside a block of ``ROLLOUT_BLOCK`` consecutive event ids, so no single
user, however hot, produces an array longer than the block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import eos_mask
from ..session import table

ROLLOUT_BLOCK = 1024

# Token id per event type; 1 is the end-of-sequence token.
EVENT_TOKENS = {"error": 1, "view": 3, "click": 4, "purchase": 5, "signup": 6}
OTHER_TOKEN = 7


def event_token(col="event_type"):
    expr = F.lit(OTHER_TOKEN)
    for name, tok in reversed(list(EVENT_TOKENS.items())):
        expr = F.when(F.col(col) == name, F.lit(tok)).otherwise(expr)
    return expr


def rollouts_from_events(events: DataFrame, block: int = ROLLOUT_BLOCK) -> DataFrame:
    """One rollout row per (step, uid): the user's events of one id block, in time order.

    Derived values are irrational functions of ``value`` so that results do
    not sit on decimal rounding ties when compared across engines.
    Token arrays (all aligned): response_ids, response_mask (eos = error event),
    token_level_scores = ln(1+value)/5, values = sqrt(value)/20, old_log_probs =
    -ln(1+value)/10, ref_log_prob = -value/1000 - 0.05, log_probs = 0.9·old,
    vpreds = 1.1·values.
    """
    ev = events.select(
        F.col("user_id").alias("uid"),
        F.expr(f"event_id div {block}").alias("step"),
        "ts", "event_id", "value", event_token().alias("token"))
    grouped = ev.groupBy("step", "uid").agg(
        F.sort_array(F.collect_list(F.struct("ts", "event_id", "value", "token"))).alias("_t"))
    v = F.transform("_t", lambda x: x["value"])
    out = grouped.select(
        "step", "uid",
        F.transform("_t", lambda x: x["token"]).alias("response_ids"),
        v.alias("_v"))
    out = out.select(
        "step", "uid", "response_ids",
        eos_mask("response_ids", 1).alias("response_mask"),
        F.transform("_v", lambda x: F.log(1.0 + x) / 5.0).alias("token_level_scores"),
        F.transform("_v", lambda x: F.sqrt(x) / 20.0).alias("values"),
        F.transform("_v", lambda x: -F.log(1.0 + x) / 10.0).alias("old_log_probs"),
        F.transform("_v", lambda x: -x / 1000.0 - 0.05).alias("ref_log_prob"))
    return (out.withColumn("token_level_rewards", F.col("token_level_scores"))
               .withColumn("log_probs", F.transform("old_log_probs", lambda x: x * 0.9))
               .withColumn("vpreds", F.transform("values", lambda x: x * 1.1)))


def rollouts(spark: SparkSession, sf_dir: str, *columns: str, write: bool = True) -> DataFrame:
    """The rollout table (with ``columns`` only those, after the keys).

    Written once to the shared checkpoint folder for queries that read it in
    several branches (group statistics, sequence metrics, token metrics): they
    prune different columns, so Spark cannot share one exchange between them.
    Queries of one branch pass ``write=False`` and let Catalyst prune.
    """
    out = rollouts_from_events(table(spark, sf_dir, "events"))
    if columns:
        out = out.select("step", "uid", *columns)
    if not write:
        return out
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return out.checkpoint(eager=True)


def explode_tokens(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Long form (keys..., pos, arrays...) of aligned token arrays."""
    z = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
    return (df.select(*keys, F.posexplode(z).alias("pos", "_z"))
              .select(*keys, "pos", *[F.col("_z")[a].alias(a) for a in arrays]))


# DuckDB twin of ``rollouts_from_events`` in long form: one row per token.
ROLLOUT_TOKENS_SQL = f"""
ev AS (
  SELECT user_id AS uid, event_id // {ROLLOUT_BLOCK} AS step, event_id, ts, value,
         CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 3 WHEN 'click' THEN 4
              WHEN 'purchase' THEN 5 WHEN 'signup' THEN 6 ELSE 7 END AS token,
         row_number() OVER (PARTITION BY user_id, event_id // {ROLLOUT_BLOCK} ORDER BY ts, event_id) - 1 AS pos
  FROM events),
ev2 AS (
  SELECT *, min(CASE WHEN token = 1 THEN pos END) OVER (PARTITION BY uid, step) AS first_eos,
            count(*) OVER (PARTITION BY uid, step) AS n
  FROM ev),
tok AS (
  SELECT uid, step, pos, token, n,
         CASE WHEN first_eos IS NULL OR pos <= first_eos THEN 1 ELSE 0 END AS mask,
         ln(1 + value) / 5.0 AS score, sqrt(value) / 20.0 AS val,
         -ln(1 + value) / 10.0 AS old_logp, -value / 1000.0 - 0.05 AS ref_logp,
         0.9 * (-ln(1 + value) / 10.0) AS logp, 1.1 * (sqrt(value) / 20.0) AS vpred
  FROM ev2)
"""
