"""Physical-plan properties that matter at scale, read from ``explain()``."""

from pyspark.sql import functions as F

from conftest import SMALL_SF
from gradewise.operators import advantage as adv
from gradewise.operators.scoring import first_rows_per_key
from gradewise.plans.credit import greedy_baselines
from gradewise.session import table


def _plan(df, capsys):
    df.explain(mode="formatted")
    return capsys.readouterr().out


def test_group_statistics_use_partial_aggregates_not_windows(spark, capsys):
    ev = table(spark, SMALL_SF, "events").select("event_id", "user_id", "value")
    plan = _plan(adv.group_normalized_score(ev, "user_id", "value", "a"), capsys)
    assert "Window" not in plan
    assert "HashAggregate" in plan and "partial_" in plan


def test_scan_reads_only_needed_columns_and_pushes_filters(spark, capsys):
    plan = _plan(greedy_baselines(spark, SMALL_SF), capsys)
    read = [line for line in plan.splitlines() if line.strip().startswith("ReadSchema")]
    assert read and all("props" not in line and "ts" not in line for line in read)
    assert "PushedFilters" in plan and "EqualTo(event_type,view)" in plan


def test_first_rows_per_key_limits_before_the_shuffle(spark, capsys):
    ev = table(spark, SMALL_SF, "events").select("event_type", "event_id")
    plan = _plan(first_rows_per_key(ev, "event_type", "event_id", 3), capsys)
    assert "WindowGroupLimit" in plan
    # the partial limit sits below the first exchange: only the top rows are shuffled
    first_limit = plan.index("WindowGroupLimit")
    assert "Partial" in plan[first_limit:first_limit + 400] or plan.count("WindowGroupLimit") >= 2


def test_batch_centring_is_a_scalar_subquery(spark, capsys):
    from gradewise.plans.fixtures import rollouts
    out = adv.masked_whiten(rollouts(spark, SMALL_SF), "token_level_scores", "response_mask", "w")
    plan = _plan(out, capsys)
    assert "Subquery" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_global_index_keeps_range_partitions_and_is_repeatable(spark):
    from gradewise.operators.index import with_global_index
    df = spark.range(5000).withColumn("k", (F.col("id") * 7919) % 5000)
    out = with_global_index(df, ["k"], num_partitions=6)
    assert out.rdd.getNumPartitions() == 6
    first = sorted((r.k, r.idx) for r in out.collect())
    again = sorted((r.k, r.idx) for r in out.collect())
    assert first == again == [(k, k) for k in range(5000)]


def test_spread_leaves_large_inputs_alone(spark, capsys):
    from gradewise.session import spread
    many = spark.range(0, 1000, 1, numPartitions=32)
    assert spread(many, 8) is many
    few = spark.range(0, 1000, 1, numPartitions=1)
    assert spread(few, 8).rdd.getNumPartitions() == 8


def test_narrow_global_index_matches_the_wide_one(spark):
    from gradewise.operators.index import with_global_index
    o = table(spark, SMALL_SF, "orders")
    wide = {(r.o_orderkey, r.idx) for r in with_global_index(o, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "idx").collect()}
    narrow_df = with_global_index(o, ["o_totalprice", "o_orderkey"], key="o_orderkey")
    assert set(narrow_df.columns) == set(o.columns) | {"idx"}
    narrow = {(r.o_orderkey, r.idx) for r in narrow_df.select("o_orderkey", "idx").collect()}
    assert wide == narrow and len(wide) == o.count()
