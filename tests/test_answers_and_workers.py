"""Expressions, nested forms, deadlines, chunks, exact repetition, partners and sized ranges."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conftest import SMALL_SF
from gradewise.functions import repetition
from gradewise.functions import text as T
from gradewise.operators import expressions as X
from gradewise.operators import index, puzzles
from gradewise.operators import scoring as S
from gradewise.operators import workers as U
from gradewise.session import table


@pytest.mark.parametrize("a,b,same", [
    ("2(x+1)", "2x+2", True), ("x+1", "x+2", False), ("sqrt(8)", "2sqrt(2)", True), ("\\sqrt{8}", "2\\sqrt{2}", True),
    ("\\frac{1}{2}", "0.5", True), ("\\frac12", "1/2", True), ("x^2-1", "(x-1)(x+1)", True), ("-x^2", "(-x)^2", False),
    ("\\sqrt[3]{27}", "3", True), ("2^{-1}", "1/2", True), ("x/0", "x/0", True), ("1/0", "2/0", False), ("\\pi", "3.14159", True),
    ("\\pi", "3.15", False), ("sin(x)^2+cos(x)^2", "1", True), ("(x^2-1)/(x-1)", "x+1", True), ("a+b+c", "c+b+a", False),
    ("two", "2", False), ("no 3", "no  3", True), ("", "", True), ("x", "", False), ("((", "x", False), ("2x y", "2 y x", True),
    ("x" * 500, "x" * 499, False), ("1000000", "1000050", True), ("x+1000000", "x+1000050", False), ("x^{1/2}", "sqrt(x)", True),
    ("-3", "- 3", True), ("--3", "3", True), ("0.1+0.2", "0.3", True), ("3!", "6", False),
])
def test_expressions(a, b, same):
    assert X.same_expression(a, b, 1e-4) is same and X.same_expression(b, a, 1e-4) is same


def test_both_moduli_are_prime():
    for p in X.PRIMES:  # strong tests to many bases
        d, r = p - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
            x = pow(base, d, p)
            assert x in (1, p - 1) or any(pow(x, 2 ** k, p) == p - 1 for k in range(1, r))


def test_polynomials_by_their_coefficients():
    rng = random.Random(4)
    for _ in range(300):
        p, q = ([rng.randrange(-3, 4) for _ in range(3)] for _ in range(2))
        product = [sum(p[i] * q[k - i] for i in range(3) if 0 <= k - i < 3) for k in range(5)]
        if rng.random() < 0.5:
            product[rng.randrange(5)] += 1
        want = product == [sum(p[i] * q[k - i] for i in range(3) if 0 <= k - i < 3) for k in range(5)]

        def text(c):
            return "+".join(f"({v})x^{k}" for k, v in enumerate(c))
        assert X.same_expression(f"({text(p)})({text(q)})", text(product), 1e-4) is want


@pytest.mark.parametrize("a,b,same", [
    ("Interval.open(1, 2)", "(1,2)", True), ("Interval(1,2)", "[1, 2]", True), ("Interval.Lopen(1,2)", "(1,2]", True),
    ("Interval.Ropen(1,2)", "[1,2)", True), ("(1,2]", "(1,2)", False), ("Matrix([[1, 2], [3, 4]])", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", True),
    ("Matrix([[1, 2, 3, 4]])", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", False), ("Point(1, 2)", "(1, 2)", True),
    ("(f(1,2), 3)", "(f(1,2),3)", True), ("((1,2),3)", "(1,2,3)", False), ("(2(x+1), 3)", "(2x+2, 3)", True),
    ("\\begin{bmatrix}x\\\\2x\\\\\\end{bmatrix}", "[[x],[x+x]]", True), ("(x+1)/2", "x/2+1/2", True), ("1, 2", "1,2", True), ("1, 2", "2, 1", False),
    ("(1, 2", "(1, 2", True), ("", "", True), ("()", "( )", True), (None, "1", None), ("\\left[ 1, 2 \\right)", "[1,2)", True),
])
def test_forms(spark, a, b, same):
    df = spark.createDataFrame([(a, b, 7)], "given string, truth string, kept int")
    row = X.with_forms_equal(df, "given", "truth", "same").first()
    assert row.same is same and row.kept == 7
    with pytest.raises(ValueError):
        X.with_forms_equal(df, "given", "truth", "KEPT")


def test_a_call_that_never_ends_leaves_the_others_scored(spark):
    def never_ends(x):
        while True:
            try:
                while x == 3:
                    pass
                return x / (x - 5)
            except Exception:  # a handler that would swallow an ordinary alarm
                if x == 5:
                    raise

    df = spark.range(12).coalesce(2).withColumnRenamed("id", "x")
    begin = time.time()
    rows = {r.x: (r.score, r.reason) for r in U.score_with_deadline(df, never_ends, ["x"], 0.3).collect()}
    assert time.time() - begin < 30
    assert rows.pop(3) == (0.0, "timeout") and rows.pop(5) == (0.0, "error: ZeroDivisionError")
    assert rows == {x: (x / (x - 5), None) for x in rows} and len(rows) == 10
    assert U.score_with_deadline(df.limit(0), never_ends, ["x"], 0.3).count() == 0
    with pytest.raises(ValueError):
        U.score_with_deadline(df.withColumn("Score", F.lit(1)), never_ends, ["x"], 1)


def test_scorers_by_name(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None)], "x string, y string")
    rows = U.score_with_deadline(df, U.named_scorer("operator", "eq"), ["x", "y"], 5).collect()
    assert [(r.score, r.reason) for r in rows] == [(0.0, None), (0.0, None)]
    with pytest.raises(ValueError):
        U.named_scorer("operator", "no_such_function")
    with pytest.raises(ImportError):
        U.named_scorer("no_such_module_of_ours", "f")


@pytest.mark.parametrize("rows", [1, 7, 64, 1000])
def test_chunks_of_any_size_give_the_same_rows(spark, rows):
    schema = StructType().add("id", "long").add("twice", "long")

    def twice(chunk):
        assert chunk.num_rows <= rows and chunk["id"].to_pylist() == sorted(chunk["id"].to_pylist(), reverse=True)
        return chunk.append_column("twice", [[2 * x for x in chunk["id"].to_pylist()]])
    df = spark.range(200).repartition(5)
    got = U.map_chunks(df, twice, schema, rows, F.col("id").desc())
    assert sorted(map(tuple, got.collect())) == [(x, 2 * x) for x in range(200)]


def test_a_function_with_another_schema_fails(spark):
    with pytest.raises(Exception, match="the function returned"):
        U.map_chunks(spark.range(5), lambda chunk: chunk, StructType().add("id", "string"), 2, "id").collect()
    assert U.map_chunks(spark.range(0), lambda chunk: chunk, StructType().add("id", "long"), 2, "id").count() == 0


def sorted_suffixes(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    total = 0
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        total += k
    return total


def test_repetition_is_that_of_sorted_suffixes():
    rng = random.Random(2)
    texts = ["", "a", "aa", "aaa", "ab" * 40, "ünï😀ünï😀", "a" * 300, "abcabcabd" * 9]
    texts += ["".join(rng.choice("ab \n"[:rng.randrange(1, 5)]) for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    assert list(repetition.shared_prefix_sums(texts)) == [sorted_suffixes(t) for t in texts]
    assert repetition.repetition_scores(texts) == [2 * sorted_suffixes(t) / (len(t) * (len(t) + 1)) if len(t) > 1 else 0.0 for t in texts]


def test_repetition_of_all_documents(spark):
    rows = table(spark, SMALL_SF, "documents").select("text", repetition.repetition_score("text").alias("s")).collect()
    for r in rows:
        n = len(r.text)
        assert r.s == pytest.approx(2 * sorted_suffixes(r.text) / (n * (n + 1)) if n > 1 else 0.0)


def steps_frame(spark, steps):
    return spark.createDataFrame([(k, 2, ["Ann", "Bob"], s) for k, s in enumerate(steps)],
                                 "k long, n int, names array<string>, cot_repeat_steps array<string>")


def test_further_partners_serve_what_the_next_one_cannot(spark):
    steps = [["same"]] * 40 + [["other"]]
    got = puzzles.replace_one_step(steps_frame(spark, steps)).collect()
    assert sorted(r.k for r in got) == list(range(41))
    assert all(r.replaced_steps == ["other" if r.k < 40 else "same"] for r in got)
    assert puzzles.replace_one_step(steps_frame(spark, [["same"]] * 9)).count() == 0
    assert puzzles.replace_one_step(steps_frame(spark, [["x"]])).count() == 0
    assert puzzles.replace_one_step(steps_frame(spark, [["x"]]).limit(0)).count() == 0


def partitions_asked(monkeypatch):
    asked = []
    plain = index.sized

    def noted(df, num_partitions=None):
        rows, n = plain(df, num_partitions)
        asked.append(n)
        return rows, n
    monkeypatch.setattr(index, "sized", noted)
    return asked


@pytest.mark.parametrize("key", ["M6", "P5", "P7", "P8", "L6", "L7"])
@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_ranges_of_small_tables_are_the_sessions_own(spark, monkeypatch, key, sf):
    import __spark_entry__ as E
    asked = partitions_asked(monkeypatch)
    E.queries()[key](spark, f"/root/testdata/sf{sf}").limit(1).collect()
    assert asked and set(asked) == {int(spark.conf.get("spark.sql.shuffle.partitions"))}


def test_wide_rows_get_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(index, "WRITTEN_BYTES", 1 << 16)
    wide = spark.range(3000).select("id", *[F.sha2((F.col("id") * 100 + k).cast("string"), 512).alias(f"c{k}") for k in range(6)])
    out = index.with_global_index(wide.join(spark.range(3000), "id"), "id")
    assert out.rdd.getNumPartitions() > 8
    assert sorted((r.id, r.idx) for r in out.select("id", "idx").collect()) == [(k, k) for k in range(3000)]


def test_long_answers_are_parsed_in_one_pass(spark):
    rambling = "Ann knight or Bob knave, " + "the isle is a riddle and so on " * 7000
    many = "Ann is a knight. " + "hm " * 60000 + "Bob is a knave"
    df = spark.createDataFrame([(rambling, ["Ann", "Bob"]), (many, ["Ann", "Bob"])], "a string, names array<string>")
    found = df.select(T.predicted_identities("a", "names").alias("p"))
    found.collect()
    begin = time.time()
    rows = found.collect()
    assert time.time() - begin < 2.0  # with the job around it; the quadratic pattern took minutes
    assert rows[0].p is None and [(x.name, x.role) for x in rows[1].p] == [("Ann", "knight"), ("Bob", "knave")]


@pytest.mark.parametrize("text,box", [
    ("<answer>so \\boxed{4}</answer>", "\\boxed{4}"), ("\\boxed{1} <answer>\\boxed{2} and \\boxed{3}</answer>", "\\boxed{2} and \\boxed{3}"),
    ("<answer>\\boxed{2}</answer> then \\boxed{5}", "\\boxed{2}"), ("\\boxed{7} }", "\\boxed{7} }"), ("\\boxed{7", None), ("none", None),
    ("<answer>\\boxed{1}</answer><answer>\\boxed{2}</answer>", "\\boxed{1}</answer><answer>\\boxed{2}"), ("\\boxed{3}</answer>", "\\boxed{3}"),
])
def test_box_of_an_open_answer(spark, text, box):
    import re
    head = S.text_before_last(F.lit(text), "</answer>")
    tagged = S.box_to_last_brace(F.when(F.instr(head, "<answer>") > 0, T.after_first(head, "<answer>")))
    got = spark.range(1).select(F.coalesce(tagged, S.box_to_last_brace(F.lit(text))).alias("v")).first().v
    in_tags = re.findall(r"(?s)<answer>.*?(\\boxed\{.*\}).*?</answer>", text)
    anywhere = re.findall(r"(?s)(\\boxed\{.*\})", text)
    assert got == box == (in_tags or anywhere or [None])[-1]
