"""Golden values for array, text and scoring functions."""

from pyspark.sql import functions as F

from gradewise.functions import arrays as A
from gradewise.functions import text as T
from gradewise.operators import advantage as adv
from gradewise.operators import scoring as S


def _one(spark, col, **lits):
    df = spark.createDataFrame([tuple(lits.values())], list(lits))
    return df.select(col.alias("x")).first().x


def test_eos_mask_docstring_example(spark):
    ids = F.array(*[F.lit(i) for i in [0, 0, 2, 42, 3, 5, 1, 0, 0]])
    assert _one(spark, A.eos_mask(ids, 1), k=1) == [1, 1, 1, 1, 1, 1, 1, 0, 0]


def test_position_ids_left_padded(spark):
    mask = F.array(*[F.lit(i) for i in [0, 0, 0, 0, 1, 1, 1, 1]])
    assert _one(spark, A.position_ids(mask), k=1) == [0, 0, 0, 0, 0, 1, 2, 3]


def test_pad_and_truncate(spark):
    ids, mask = A.pad_and_truncate(F.array(F.lit(5), F.lit(6)), 4, 0, left_pad=True, truncation="error")
    assert _one(spark, ids, k=1) == [0, 0, 5, 6]
    assert _one(spark, mask, k=1) == [0, 0, 1, 1]


def test_strict_and_flexible_numbers(spark):
    assert _one(spark, T.strict_number("s"), s="so #### 1,234 then") == "1234"
    assert _one(spark, T.strict_number("s"), s="no marker 12") is None
    assert _one(spark, T.flexible_number("s"), s="a 3 then 4.5 and .") == "4.5"


def test_last_boxed(spark):
    assert _one(spark, T.last_boxed("s"), s="x \\boxed{1} y \\boxed{\\frac{1}{2}} z") == "\\boxed{\\frac{1}{2}}"
    assert _one(spark, T.last_boxed("s"), s="no box") is None
    assert _one(spark, S.boxed_score("s", "g")["score"], s="\\boxed{\\dfrac12}", g="\\frac{1}{2}") == 1.0


def test_puzzle_pure_score(spark):
    truth = "(1) Zoey is a knight\n(2) Oliver is a knave"
    good = "Assistant: <think>hm</think><answer>Zoey is a knight, Oliver is a knave</answer>"
    bad = "Assistant: <think>hm</think><answer>Zoey is a knave, Oliver is a knave</answer>"
    assert _one(spark, S.puzzle_score_pure("r", "t")["score"], r=good, t=truth) == 1.0
    assert _one(spark, S.puzzle_score_pure("r", "t")["score"], r=bad, t=truth) == 0.0
    assert _one(spark, S.puzzle_score_v1("r", "t")["score"], r=bad, t=truth) == -0.5


def test_digit_task(spark):
    assert _one(spark, S.digit_ground_truth("p"), p="9,10:20,2") == "11,12"


def test_gae_matches_python_loop(spark):
    r, v, g, lam = [0.1, 0.0, 1.0], [0.5, 0.4, 0.2], 0.9, 0.8
    df = spark.createDataFrame([(r, v, [1, 1, 1])], "token_level_rewards array<double>, values array<double>, response_mask array<int>")
    out = adv.gae_advantage(df, gamma=g, lam=lam).first()
    last, advs = 0.0, []
    for t in reversed(range(3)):
        nv = v[t + 1] if t < 2 else 0.0
        last = r[t] + g * nv - v[t] + g * lam * last
        advs.append(last)
    advs = advs[::-1]
    assert [round(a, 9) for a in out.returns] == [round(a + b, 9) for a, b in zip(advs, v)]
    mean = sum(advs) / 3
    assert [round(a, 9) for a in out.advantages] == [round(a - mean, 9) for a in advs]
