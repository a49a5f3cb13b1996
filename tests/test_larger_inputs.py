"""Work that is done once, in bounded tasks, and for tables of any number of rows."""
from pyspark.sql import functions as F

from gradewise.functions import text as T
from gradewise.operators import analysis as M
from gradewise.operators import balance as L
from gradewise.operators import puzzles as K


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _keys(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def test_the_last_batch_need_not_be_a_multiple_of_the_parts(spark):
    """L1_equal, L7: 11 items in 4 equal parts raised."""
    df = spark.createDataFrame([(0, i, 10 * i % 7 + 1) for i in range(8)] + [(1, i, i) for i in range(11)], "b long, i long, n long")
    for method in ("kk", "greedy"):
        rows = L.balance(df, "b", "i", "n", 4, method, equal_size=True).collect()
        counts = [sorted(sum(r.b == b and r.part == p for r in rows) for p in range(4)) for b in (0, 1)]
        assert counts == [[2, 2, 2, 2], [2, 3, 3, 3]]


def test_few_survivors_find_what_all_candidates_find(spark, monkeypatch):
    """The words to meet against every statement tried, for all sizes."""
    g = K.generate(_keys(spark, 200)).select("k", "n", "statements", "solution_bits").checkpoint()
    quick = K.perturb(g).orderBy("k").collect()
    monkeypatch.setattr(K, "FEW", -1)  # every statement is tried
    assert quick and quick == K.perturb(g).orderBy("k").collect()
    assert {r.n for r in quick} == set(range(2, 9))


def test_generated_puzzles_are_aggregated_without_sorting_whole_rows(spark):
    """A struct in the aggregate's buffer sorted all rows of a task."""
    plan = _plan(K.generate(_keys(spark, 50)))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_repeated_and_null_keys_give_one_puzzle(spark):
    twice = spark.sql("SELECT explode(array(k, k, cast(null AS bigint))) AS k FROM (SELECT id AS k FROM range(60))")
    once = [r.asDict() for r in K.generate(_keys(spark, 60)).orderBy("k").collect()]
    assert once and [r.asDict() for r in K.generate(twice).orderBy("k").collect()] == once


def test_steps_and_short_puzzles_are_derived_once(spark):
    """K7, P20: a filter inferred or pushed below the puzzle derived it again."""
    from gradewise.plans.prep import p20_length_filter
    from gradewise.plans.puzzles import k7_reasoning_steps
    for query, mark in ((k7_reasoning_steps, "'Generate posexplode"), (p20_length_filter, "Generate explode")):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert not filters, mark


def test_term_counts_are_shuffled_once(spark):
    """M2: the tokens were made four times and the counts of a document's terms twice."""
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "d long, tokens array<string>")
    found = M.term_weights(df, "d")
    assert sorted((r.d, r.term, r.tf) for r in found.collect()) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert "size(tokens" not in optimized
    assert "ReusedExchange" in _plan(found)  # as it ran: the same columns in both uses


def test_language_search_and_strip(spark):
    """The shortened searches find what the plain ones do."""
    texts = ["", " ", "plain", " a b \n", "a ", "　x", "é", "∨ and ∧", "ж", "漢字 x", "a\U00020001", "Ѐ", "Ͽ", "\U0002fa1f", "가", "x y", "a \u0085", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    for r in df.select("t", T.py_strip("t").alias("a"), plain.alias("b"), T.has_non_latin("t").alias("c"), F.col("t").rlike(T.NON_LATIN_CLASS).alias("d"),
                       T.count_substr("t", "∧").alias("e")).collect():
        assert r.a == r.b and r.c == r.d and r.e == (r.t.count("∧") if r.t is not None else None)
    from gradewise.plans.scoring import puzzle_responses
    from gradewise.session import spread
    assert spread(spark.range(1000), rows=100).rdd.getNumPartitions() == 10
    assert puzzle_responses(spark, "/root/testdata/sf0.001").count() == 1500


def test_rows_are_dealt_to_tasks_without_a_sort(spark):
    """Dealing rows in turn sorts all rows of a task before, in the scan and after the aggregate."""
    from gradewise.plans import puzzles as Q
    from gradewise.session import spread
    few = spark.createDataFrame([(None,)] * 300 + [(7,)] * 300, "k long").coalesce(1)
    dealt = spread(few, 6)
    assert dealt.columns == ["k"] and "RoundRobin" not in _plan(dealt)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and sum(sizes) == 600 and max(sizes) < 200  # equal and null keys do not meet in one task
    assert sorted(str(r.k) for r in dealt.collect()) == ["7"] * 300 + ["None"] * 300
    plan = _plan(Q.generated(spark, "/root/testdata/sf0.001"))
    assert "RoundRobin" not in plan and "hashpartitioning(k" in plan


def test_many_tasks_are_dealt_in_two_steps(spark):
    """A scan task that deals to more than 200 partitions gathers all rows of its file in memory first."""
    from gradewise.session import DEALT_AT_ONCE, spread
    rows = [(None,)] * 2000 + [(7,)] * 2000 + [(i,) for i in range(6000)]
    few = spark.createDataFrame(rows, "k long").coalesce(1)
    target = 2 * DEALT_AT_ONCE
    dealt = spread(few, target)
    assert dealt.columns == ["k"]
    steps = [line for line in _plan(dealt).splitlines() if "Exchange" in line]
    assert len(steps) == 2 and f", {target})" in steps[0] and f", {DEALT_AT_ONCE})" in steps[1] and DEALT_AT_ONCE <= 200
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 0.98 * target and max(sizes) < 75  # 25 on average, copies and nulls apart
    assert sorted(str(r.k) for r in dealt.collect()) == sorted(str(k) for k, in rows)
    assert _plan(spread(few, DEALT_AT_ONCE)).count("Exchange") == 1


def test_the_keys_are_dealt_once(spark):
    """Asking the dealt keys for their partitions ran the scan and its shuffle, then they ran again."""
    from gradewise.plans import puzzles as Q
    from gradewise.session import table, tasks_for
    sf, tracker = "/root/testdata/sf0.001", spark.sparkContext.statusTracker()

    def stages(group, work):
        spark.sparkContext.setJobGroup(group, group)
        try:
            work()
            return sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group))
        finally:
            spark.sparkContext._jsc.clearJobGroup()
    counted = stages("rows-counted", lambda: tasks_for(table(spark, sf, "orders")))
    assert counted and stages("keys-dealt", lambda: Q.generated(spark, sf)) == counted


def test_numbers_stand_for_the_sampled_statements(spark):
    """P25, K2: statements as numbers, their solutions and texts against the statements themselves; null keys too."""
    keys = _keys(spark, 150).unionByName(spark.sql("SELECT cast(null AS bigint) AS k"))
    for n_people in (None, 9):
        d = K.numbered_people(keys, n_people=n_people).withColumn("codes", K.sampled_codes("k", "n", 3)).withColumn(
            "st", K.sampled_statements("k", "n", 3))
        same = d.select((F.transform("codes", K.coded_statement).eqNullSafe(F.col("st"))).alias("a"), K.coded_solution_words(
            F.col("codes"), F.col("n")).eqNullSafe(K.solution_words("st", "n")).alias("b")).collect()
        assert len(same) == 151 and all(r.a and r.b for r in same)


def test_names_are_in_the_order_of_their_draws(spark):
    """Names sorted as one text each against draws and names."""
    from gradewise.functions.common import seeded_digits
    from gradewise.operators import puzzle_text as PT
    g = K.generate(_keys(spark, 40))
    for uncommon, pool in ((False, PT.COMMON_NAMES), (True, PT.UNCOMMON_NAMES)):
        draws = F.array(*[F.struct(seeded_digits("k", 0, 5000 + i).alias("h"), F.lit(x).alias("name")) for i, x in enumerate(pool)])
        rows = K.render(g, uncommon_names=uncommon).select("names", F.slice(F.sort_array(draws)["name"], 1, F.col("n")).alias("plain")).collect()
        assert rows and all(r.names == r.plain for r in rows)


def test_perturbations_in_batches_are_those_of_the_columns(spark, monkeypatch):
    """F1, F2 (J5, K3): all puzzles of a size tried together, with one word, several words and odd rows."""
    g = K.generate(_keys(spark, 150)).select("k", "n", "statements", "solution_bits")
    g = g.unionByName(K.generate(_keys(spark, 12), n_people=9).select("k", "n", "statements", "solution_bits")).checkpoint()
    one = g.filter("n = 4").orderBy("k").limit(1)
    odd = [one, one.withColumn("k", F.lit(None).cast("long")), one.withColumn("k", F.lit(-(1 << 62))), one.withColumn("n", F.lit(None).cast("int")),
           one.withColumn("solution_bits", F.lit(None).cast("int")), one.withColumn("statements", F.lit(None).cast(one.schema["statements"].dataType)),
           one.withColumn("statements", F.expr("transform(statements, (s, i) -> if(i = 1, null, s))")),
           one.withColumn("statements", F.expr("transform(statements, (s, i) -> if(i < 3, named_struct('op', 'or', 'args', array(named_struct('lie', false, 'who', i), "
                                               "named_struct('lie', true, 'who', i))), s))"))]
    odd.append(one.selectExpr("k", "1 AS n", "slice(statements, 1, 1) AS statements", "0 AS solution_bits"))
    for x in odd:
        g = g.unionByName(x)
    plain = sorted(K.perturb(g).collect(), key=str)
    assert {r.n for r in plain} == set(range(2, 10)) and [r.k for r in plain].count(one.first().k) >= 3
    assert sorted(K.perturb(g, batches=True).collect(), key=str) == plain
    assert K.perturb(g, batches=True).dtypes == K.perturb(g).dtypes and K.perturb(g.limit(0), batches=True).count() == 0
    for few in (-1, 8):
        monkeypatch.setattr(K, "FEW", few)
        assert sorted(K.perturb(g, batches=True).collect(), key=str) == plain


def test_draws_of_many_texts_are_those_of_each():
    """F1, F2 (J5, K3): the md5 of all candidates at once; long keys take more than one block."""
    import hashlib

    import numpy as np
    from gradewise.operators.perturbations import draws
    starts = [b"1:5:", b"1:-123456:", None, b"1:" + b"9" * 60 + b":", b"1:12345678:", b""]
    of, number = np.repeat(np.arange(6), 1500), np.tile(np.arange(0, 7500, 5), 6)
    plain = [0 if starts[o] is None else int(hashlib.md5(starts[o] + b"%d" % i).hexdigest()[:15], 16) for o, i in zip(of, number)]
    assert draws(starts, of, number, 7500).tolist() == plain


def test_perturbation_queries_try_puzzles_in_batches(spark):
    """F1, F2 (J5, K3): the columns took 3 ms a puzzle; the clean side of J5 comes from the same shuffle."""
    from gradewise.plans.prep import j5_clean_perturbed
    from gradewise.plans.puzzles import k3_perturb_statement
    for query in (j5_clean_perturbed, k3_perturb_statement):
        df = query(spark, "/root/testdata/sf0.001")
        df.count()
        assert _plan(df).count("ArrowEvalPython") >= 1 and df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_responses_are_searched_for_fixed_texts_and_single_characters(spark):
    """F3 (R12): words, tags, marker and thinking against the plain rules, for odd texts."""
    import random
    import re
    draw = random.Random(5)
    parts = [*T.VERIFY_TAGS, " ", "  ", "\n", "\t", "\x0b", "\f", "\r", "\x1c", "\x85", " ", "　", "a", "<", "é", "漢", "\U0001F600", "Assistant:", "<|im_start|>assistant"]
    texts = [None, "", " ", " ", "\n\n"] + ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(400)]
    for _ in range(400):
        tags = [x + draw.choice(["", "", "x", "\n", "\n\n", "\U0001F600", "<"]) for x in T.VERIFY_TAGS]
        if draw.random() < 0.4:
            i, j = draw.randrange(6), draw.randrange(6)
            tags[i], tags[j] = tags[j], tags[i]
        texts.append("".join(tags) + draw.choice(["", "", "", "<answer>"]))
    white = "".join(T.WHITE_SPACE)

    def structure(t):
        at = {x: t.find(x) for x in T.VERIFY_TAGS}
        return all(t.count(x) == 1 for x in at) and all(at[a] <= at[b] for a, b in zip(T.VERIFY_TAGS[::2], T.VERIFY_TAGS[1::2])) and all(
            at[b] - at[a] - len(a) <= 1 for a, b in (("</think>", "<verify>"), ("</verify>", "<answer>")))

    def rest(t):
        marker = next((m for m in ("Assistant:", "<|im_start|>assistant") if m in t), "")
        return t.split(marker, 1)[1] if marker else t
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.approx_tokens("t").alias("words"), T.verify_structure("t").alias("ok"), T.assistant_part("t").alias("rest"),
                     T.think_content("t", "</verify>").alias("think")).collect()
    assert sum(bool(r.ok) for r in rows) > 50
    for r in rows:
        if r.t is None:
            assert (r.words, r.ok, r.rest, r.think) == (None, None, None, "")
            continue
        assert r.words == len(re.split(r"[ \t\n\x0b\f\r]+", r.t.strip(white))), r.t
        assert r.ok == structure(r.t), r.t
        assert r.rest == rest(r.t) and r.think == r.t[r.t.find("<think>") + 7:r.t.find("</verify>")]


def test_the_thinking_is_read_where_it_counts(spark):
    """F3 (R12): the factor was computed for all responses; a regex counted the words."""
    from gradewise.operators import scoring as S
    df = spark.createDataFrame([("<answer>Zoey is a knight</answer>", "(1) Zoey is a knight", None)], "response string, solution_text string, vlen int")
    for variant in ("new", "verify"):
        scored = S.puzzle_scores(df, variant, valid_response_length="vlen")
        lines = scored._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert any("CASE WHEN (_pz" in x and "<think>" in x for x in lines)
    assert S.puzzle_scores(df, "new", valid_response_length="vlen").collect()[0].outcome_score == 1.0
    plan = df.select(T.approx_tokens("response"))._jdf.queryExecution().optimizedPlan().toString()
    assert r"\s+, -1" not in plan
