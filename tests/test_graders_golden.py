"""Grader rules on single answers, taken from the rules themselves."""

import pytest
from pyspark.sql import functions as F

from gradewise.operators import scoring as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("response,answer", [
    ("so x = 12", "12"), ("the answer is 7", "7"), ("Therefore we get 42", "42"), ("The answer is 5. So done", "5"),
    ("no number here is fine", None), ("nothing", None), ("ANSWER: x is 3", "3"), ("\\boxed{8} is the answer", "8"),
    ("first 4 is the answer and more", "first 4"), ("we get\n17", "17"), ("value: 9", "9"), ("just 5", None),
])
def test_located_answer(spark, response, answer):
    assert value(spark, S.contest_math_answer(F.lit(response))) == answer


@pytest.mark.parametrize("answer,normal", [
    ("7 3/4", "7+3/4"), ("7\\frac{3}{4}", "7+3/4"), ("5 cm", "5"), ("5 meters^2", "5"), ("\\text{Yes}", "yes"), ("{12}", "12"),
    ("3 million", "3 *10^6"), ("1 or 2", "1 , 2"), ("50\\%", "50"), ("\\$4.0", "4"), ("1,000", "1000"), ("- 3", "-3"), ("2^\\circ", "2"),
])
def test_contest_normalisation(spark, answer, normal):
    assert value(spark, S.contest_math_normalize(F.lit(answer))) == normal


@pytest.mark.parametrize("a,b,same", [
    ("(1,000, 2)", "(1000, 2)", True), ("(1, 2)", "[1, 2)", False), ("(1, 2)", "(1,2)", True), ("(1, 2)", "(1, 2, 3)", False),
    ("1/2", "2/4", False), ("{1}", "1", True), ("3", "3.5", False), ("x+1", "X+1", True),
])
def test_tuples(spark, a, b, same):
    assert value(spark, S.tuples_equal(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("a,b,same", [
    ("1,000", "1000", True), ("50", "0.5", True), ("Yes", " yes ", True), ("a b", "ab", True), ("$5", "5", True), ("5%", "5", True),
    ("1.00001", "1", True), ("1.01", "1", False), ("1{,}234", "1234", True), ("5d", "5", False),
])
def test_numeric_equality(spark, a, b, same):
    assert value(spark, S.answers_equal(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("a,b,same", [("50", "0.5", False), ("0.5", "\\frac{1}{2}", True), ("1,000", "1000.0", True), ("3 ", "3", True),
                                      ("\\dfrac12", "1/2", True), ("x", "y", False)])
def test_open_math_equality(spark, a, b, same):
    assert value(spark, S.stripped_equal(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("gap,tokens,score", [
    ("", 501, 2.0), ("\n", 501, 2.0), ("\n", 500, -3.0), ("xx", 501, -3.0), ("\n", 1000, 1.0), (" so far ", 120, -4.0),
])
def test_verify_variant(spark, gap, tokens, score):
    response = f"<think>Ann, Bob</think>{gap}<verify>fine</verify>\n<answer>Ann is a knight, Bob is a knave</answer>"
    truth = "(1) Ann is a knight\n(2) Bob is a knave"
    got = value(spark, S.puzzle_score_verify(F.lit(response), F.lit(truth), F.lit(tokens), 1000))
    assert got["score"] == pytest.approx(score)
    frame = spark.createDataFrame([(response, truth, tokens)], "response string, solution_text string, n int")
    assert S.puzzle_scores(frame, "verify", valid_response_length="n", max_response_length=1000).first().score == pytest.approx(score)


def test_words_that_count_as_reflection(spark):
    for word, bonus in (("verify", 0), ("wait", 1), ("review, yet", 2)):
        text = f"<think>Ann Bob {word}</think><verify>ok</verify><answer>Ann is a knight, Bob is a knave</answer>"
        got = value(spark, S.puzzle_score_verify(F.lit(text), F.lit("(1) Ann is a knight\n(2) Bob is a knave"), F.lit(600), 1000))
        assert got["score"] == pytest.approx(2 + 2e-5 * bonus, abs=1e-9)


def test_recorded_outcomes_of_code(spark):
    reg = S.default_registry()
    rows = spark.createDataFrame([("apps", "1,1,1"), ("taco", "1,0"), ("codeforces", "1,1,1,1,1,1,1,1,1,1,0"), ("codecontests", "0")],
                                 "source string, outcomes string")
    got = rows.select(reg.score_column("source", F.lit("code"), "outcomes")["score"].alias("s")).collect()
    assert [r.s for r in got] == [1.0, 0.5, 1.0, 0.0]


def test_every_digit_prompt_comes_out_once(spark):
    from gradewise.plans import registry
    registry.load_all()
    rows = registry.QUERIES["K12_all"](spark, "/root/testdata/sf0.001").collect()
    want = {f"{a},{(a + d) % 16}:16,{k}" for a in range(17) for d in range(6) for k in range(9)}
    assert len(rows) == len(want) and {r.prompt for r in rows} == want and any(r.n_orders == 0 for r in rows)
    assert sum(r.n_orders for r in rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_digit_prompts_enumerate_all(spark):
    n = S.digit_prompt_count(16, 5, 8)
    got = {r.p for r in spark.range(n).select(S.digit_prompt_at("id", 16, 5, 8).alias("p")).collect()}
    want = {f"{a},{(a + d) % 16}:16,{k}" for a in range(17) for d in range(6) for k in range(9)}
    assert got == want and n == 17 * 6 * 9
