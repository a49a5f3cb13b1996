"""Scoring queries (R1-R32, T7) over responses derived from the driver tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.common import seeded_draw, seeded_sql
from ..operators import expressions as X
from ..operators import scoring as S
from ..operators import workers as U
from ..session import ROWS_A_TASK, spread, table
from .registry import register

_NON_LATIN_SQL_R = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in T.NON_LATIN_RANGES) + "]"


# --- R1-R3: number answers built from lineitem -----------------------------------


def number_responses(spark, sf):
    li = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    x = F.floor("l_extendedprice")
    q = F.floor("l_quantity").cast("string")
    v = F.col("l_linenumber") % 4
    tail = (F.when(v == 0, F.concat(F.lit("Total: #### "), F.format_number(x, 0)))
             .when(v == 1, F.concat(F.lit("Total: #### $"), x.cast("string")))
             .when(v == 2, F.concat(F.lit("Total is "), x.cast("string"), F.lit(" dollars.")))
             .otherwise(F.concat(F.lit("Total: #### "), x.cast("string"), F.lit(". Check "), q, F.lit("."))))
    text = F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" ships "), q, F.lit(" units. "), tail)
    return li.select("l_orderkey", "l_linenumber", text.alias("response"), x.cast("string").alias("ground_truth"))


_NUM_SQL = r"""
WITH r AS (
  SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS ground_truth,
         'Line ' || l_linenumber || ' ships ' || CAST(floor(l_quantity) AS BIGINT) || ' units. ' ||
         CASE l_linenumber % 4
           WHEN 0 THEN 'Total: #### ' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT))
           WHEN 1 THEN 'Total: #### $' || CAST(floor(l_extendedprice) AS BIGINT)
           WHEN 2 THEN 'Total is ' || CAST(floor(l_extendedprice) AS BIGINT) || ' dollars.'
           ELSE 'Total: #### ' || CAST(floor(l_extendedprice) AS BIGINT) || '. Check ' || CAST(floor(l_quantity) AS BIGINT) || '.' END AS response
  FROM lineitem),
e AS (
  SELECT *, CASE WHEN regexp_matches(response, '#### (\-?[0-9\.\,]+)')
                 THEN replace(replace(regexp_extract(response, '#### (\-?[0-9\.\,]+)', 1), ',', ''), '$', '') END AS strict,
            regexp_extract_all(response, '(\-?[0-9\.\,]+)', 1) AS found
  FROM r),
f AS (
  SELECT *, CASE WHEN len(found) > 0 THEN coalesce(list_filter(found, lambda x: x NOT IN ('', '.'))[-1], found[1]) END AS flexible
  FROM e)
"""


@register("R1", _NUM_SQL + "SELECT l_orderkey, l_linenumber, strict FROM f")
def r1_strict(spark, sf):
    r = number_responses(spark, sf)
    return r.select("l_orderkey", "l_linenumber", T.strict_number("response").alias("strict"))


@register("R2", _NUM_SQL + "SELECT l_orderkey, l_linenumber, flexible FROM f")
def r2_flexible(spark, sf):
    r = number_responses(spark, sf)
    return r.select("l_orderkey", "l_linenumber", T.flexible_number("response").alias("flexible"))


@register("R3", _NUM_SQL + """
SELECT l_orderkey, l_linenumber,
       CAST(CASE WHEN strict IS NULL THEN 0.0 WHEN strict = ground_truth THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score_strict,
       CAST(CASE WHEN flexible IS NULL THEN 0.0 WHEN flexible = ground_truth THEN 1.0 ELSE 0.1 END AS DOUBLE) AS score_flexible
FROM f""")
def r3_number_score(spark, sf):
    r = number_responses(spark, sf)
    return r.select("l_orderkey", "l_linenumber",
                    S.number_answer_score("response", "ground_truth")["score"].alias("score_strict"),
                    S.number_answer_score("response", "ground_truth", "flexible", 0.1)["score"].alias("score_flexible"))


# --- T7 / R4: boxed answers built from part ---------------------------------------------


def boxed_responses(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size"))
    a = F.col("p_size").cast("string")
    b = (F.col("p_partkey") % 9 + 1).cast("string")
    v = F.col("p_partkey") % 6
    tail = (F.when(v == 0, F.concat(F.lit("finally \\boxed{"), a, F.lit("/"), b, F.lit("}")))
             .when(v == 1, F.concat(F.lit("so \\fbox{"), a, F.lit("}")))
             .when(v == 2, F.concat(F.lit("the answer is \\boxed{\\dfrac{"), a, F.lit("}{"), b, F.lit("}}.")))
             .when(v == 3, F.lit("unbalanced \\boxed{\\frac{1}{2}"))
             .when(v == 4, F.concat(F.lit("we get $\\boxed "), a, F.lit("$ here")))
             .otherwise(F.lit("done")))
    text = F.concat(F.lit("We compute \\boxed{\\frac{"), a, F.lit("}{"), b, F.lit("}} then "), tail)
    gt = F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))
    return p.select("p_partkey", text.alias("response"), gt.alias("ground_truth"))


_BOXED_SQL = r"""
WITH r AS (
  SELECT p_partkey, '\frac{' || p_size || '}{' || (p_partkey % 9 + 1) || '}' AS ground_truth,
         'We compute \boxed{\frac{' || p_size || '}{' || (p_partkey % 9 + 1) || '}} then ' ||
         CASE p_partkey % 6
           WHEN 0 THEN 'finally \boxed{' || p_size || '/' || (p_partkey % 9 + 1) || '}'
           WHEN 1 THEN 'so \fbox{' || p_size || '}'
           WHEN 2 THEN 'the answer is \boxed{\dfrac{' || p_size || '}{' || (p_partkey % 9 + 1) || '}}.'
           WHEN 3 THEN 'unbalanced \boxed{\frac{1}{2}'
           WHEN 4 THEN 'we get $\boxed ' || p_size || '$ here'
           ELSE 'done' END AS response
  FROM part),
t AS (
  SELECT *, CASE WHEN contains(response, '\boxed') THEN '\boxed' || string_split(response, '\boxed')[-1]
                 WHEN contains(response, '\fbox') THEN '\fbox' || string_split(response, '\fbox')[-1] END AS tail
  FROM r),
ch AS (SELECT p_partkey, unnest(string_split(tail, '')) AS c, generate_subscripts(string_split(tail, ''), 1) AS i
       FROM t WHERE tail IS NOT NULL),
d AS (SELECT *, sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS depth
      FROM ch),
e AS (SELECT p_partkey, min(i) AS endpos FROM d WHERE c = '}' AND depth = 0 GROUP BY p_partkey),
b AS (
  SELECT t.*, CASE WHEN contains(response, '\boxed ') THEN '\boxed ' || split_part(string_split(response, '\boxed ')[-1], '$', 1)
                   WHEN endpos IS NOT NULL THEN substr(tail, 1, endpos) END AS boxed
  FROM t LEFT JOIN e USING (p_partkey))
"""


def _strip_latex_sql(x: str) -> str:
    for a, b in [("chr(10)", "''"), (r"'\!'", "''"), (r"'\\'", r"'\'"), ("'tfrac'", "'frac'"), ("'dfrac'", "'frac'"),
                 (r"'\left'", "''"), (r"'\right'", "''"), (r"'^{\circ}'", "''"), (r"'^\circ'", "''"), (r"'\$'", "''")]:
        x = f"replace({x}, {a}, {b})"
    x = (f"(CASE WHEN (length({x}) - length(replace({x}, '\\text{{ ', ''))) / 7 = 1 "
         f"THEN split_part({x}, '\\text{{ ', 1) ELSE {x} END)")
    x = f"replace({x}, '\\%', '')"
    x = f"replace(replace({x}, ' .', ' 0.'), '{{.', '{{0.')"
    x = f"(CASE WHEN starts_with({x}, '.') THEN '0' || {x} ELSE {x} END)"
    x = (f"(CASE WHEN (length({x}) - length(replace({x}, '=', ''))) = 1 AND length(split_part({x}, '=', 1)) <= 2 "
         f"THEN split_part({x}, '=', 2) ELSE {x} END)")
    x = f"regexp_replace({x}, '\\\\sqrt([^{{])', '\\\\sqrt{{\\1}}', 'g')"
    x = f"replace({x}, ' ', '')"
    x = f"regexp_replace({x}, '\\\\frac([^{{])([^{{])', '\\\\frac{{\\1}}{{\\2}}', 'g')"
    x = f"regexp_replace({x}, '\\\\frac([^{{])\\{{', '\\\\frac{{\\1}}{{', 'g')"
    x = f"(CASE WHEN {x} = '0.5' THEN '\\frac{{1}}{{2}}' ELSE {x} END)"
    x = f"regexp_replace({x}, '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$', '\\\\frac{{\\1}}{{\\2}}')"
    return x


@register("T7", _BOXED_SQL + "SELECT p_partkey, boxed FROM b")
def t7_last_boxed(spark, sf):
    r = boxed_responses(spark, sf)
    return r.select("p_partkey", T.last_boxed("response").alias("boxed"))


@register("R4", _BOXED_SQL + f""",
u AS (SELECT p_partkey, ground_truth,
             CASE WHEN starts_with(boxed, '\\boxed ') THEN substr(boxed, 8)
                  WHEN starts_with(boxed, '\\boxed{{') AND ends_with(boxed, '}}') THEN substr(boxed, 8, length(boxed) - 8) END AS ans
      FROM b)
SELECT p_partkey, CAST(CASE WHEN ans IS NOT NULL AND {_strip_latex_sql('ans')} = {_strip_latex_sql('ground_truth')}
                       THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM u""")
def r4_boxed_score(spark, sf):
    r = boxed_responses(spark, sf)
    return r.select("p_partkey", S.boxed_score("response", "ground_truth")["score"].alias("score"))


# --- R5-R14: puzzle responses built from orders -----------------------------------------

# Fixed values of this fixture: the people's names.
NAMES = ["Zoey", "Oliver", "Mia", "Lucas", "Emma", "Noah", "Ava", "Liam"]
MAX_RESPONSE_TOKENS = 120
MAX_VERIFY_TOKENS = 1200


def puzzle_responses(spark, sf, verify: bool = False):
    """One templated response per order (``verify`` puts a verify block of 0 to 1,600 words
    after the thinking, at once, after one character or after several): variant ``o_orderkey % 7`` is correct,
    one role flipped, a name missing, an extra role word, no answer tags, two
    answer blocks, or answer before thinking."""
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), rows=ROWS_A_TASK)
    names_arr = F.array(*[F.lit(x) for x in NAMES])
    o = o.withColumn("n", (F.col("o_orderkey") % 5 + 2).cast("int")).withColumn("v", F.col("o_orderkey") % 7)
    people = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
        F.element_at(names_arr, (F.pmod(F.expr("o_orderkey div 5") + 3 * i, F.lit(8)) + 1).cast("int")).alias("name"),
        F.when(F.call_function("shiftright", F.col("o_custkey"), i).bitwiseAND(F.lit(1)) == 1, F.lit("knight"))
         .otherwise(F.lit("knave")).alias("role"),
        i.alias("i")))
    o = o.withColumn("people", people)

    def lines(arr, flip_first=False):
        def one(p):
            role = p["role"]
            if flip_first:
                role = F.when(p["i"] == 0, F.when(role == "knight", "knave").otherwise("knight")).otherwise(role)
            return F.concat(p["name"], F.lit(" is a "), role)
        return F.array_join(F.transform(arr, one), ", ")
    truth = F.array_join(F.transform("people", lambda p: F.concat(
        F.lit("("), (p["i"] + 1).cast("string"), F.lit(") "), p["name"], F.lit(" is a "), p["role"])), "\n")
    good, flipped = lines(F.col("people")), lines(F.col("people"), True)
    partial = lines(F.slice("people", 1, F.col("n") - 1))
    mentioned = F.when(F.col("o_orderkey") % 4 == 1, F.col("people")[0]["name"]).otherwise(
        F.array_join(F.transform("people", lambda p: p["name"]), ", "))
    think = F.concat(F.lit("Let me reason about "), mentioned, F.lit(". "),
                     F.repeat(F.lit("step "), (F.col("o_custkey") % 250).cast("int")),
                     F.when(F.col("o_orderkey") % 3 == 0, F.lit("Wait, let me verify with ∨ and ∧."))
                      .otherwise(F.lit("Done.")))
    gap = F.when(F.col("o_custkey") % 3 == 0, "").when(F.col("o_custkey") % 3 == 1, "\n").otherwise(" so ")
    checked = F.concat(gap, F.lit("<verify>"), F.repeat(F.lit("check "), (F.col("o_orderkey") % 5 * 400).cast("int")),
                       F.lit("</verify>"), F.when(F.col("o_custkey") % 5 == 0, "\n\n").otherwise("\n"))
    th = F.concat(F.lit("<think>"), think, F.lit("</think>"), checked if verify else F.lit("\n"))
    ans = lambda x: F.concat(F.lit("<answer>"), x, F.lit("</answer>"))
    v = F.col("v")
    body = (F.when(v == 1, F.concat(th, ans(flipped)))
             .when(v == 2, F.concat(th, ans(partial)))
             .when(v == 3, F.concat(th, ans(F.concat(good, F.lit(" and maybe a knave")))))
             .when(v == 4, F.concat(th, good))
             .when(v == 5, F.concat(th, ans(flipped), F.lit("\n"), ans(good)))
             .when(v == 6, F.concat(ans(good), F.lit("\n<think>"), think, F.lit("</think>")))
             .otherwise(F.concat(th, ans(good))))
    prefix = F.when(F.col("o_custkey") % 2 == 0, F.lit("<|im_start|>assistant\n")).otherwise(F.lit("Assistant: "))
    resp = F.concat(prefix, body)
    return o.select("o_orderkey", resp.alias("response"), truth.alias("solution_text"))


def _py_slice_sql(s: str, a: str, b: str) -> str:
    n = f"length({s})"
    aa = f"(CASE WHEN ({a}) < 0 THEN greatest({n} + ({a}), 0) ELSE least({a}, {n}) END)"
    bb = f"(CASE WHEN ({b}) < 0 THEN greatest({n} + ({b}), 0) ELSE least({b}, {n}) END)"
    return f"(CASE WHEN {bb} > {aa} THEN substr({s}, {aa} + 1, {bb} - {aa}) ELSE '' END)"


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_PUZZLE_SQL = f"""
WITH base AS (
  SELECT o_orderkey, o_custkey, o_orderkey % 5 + 2 AS n, o_orderkey % 7 AS v, {_NAMES_SQL} AS nm FROM orders),
ppl AS (
  SELECT *, list_transform(range(n), lambda i: {{'name': nm[((o_orderkey // 5) + 3 * i) % 8 + 1],
             'role': CASE WHEN (o_custkey >> i) & 1 = 1 THEN 'knight' ELSE 'knave' END, 'i': i}}) AS people
  FROM base),
txt AS (
  SELECT o_orderkey, o_custkey, n, v,
    array_to_string(list_transform(people, lambda p: '(' || (p.i + 1) || ') ' || p.name || ' is a ' || p.role), chr(10)) AS solution_text,
    array_to_string(list_transform(people, lambda p: p.name || ' is a ' || p.role), ', ') AS good,
    array_to_string(list_transform(people, lambda p: p.name || ' is a ' ||
        CASE WHEN p.i = 0 THEN (CASE p.role WHEN 'knight' THEN 'knave' ELSE 'knight' END) ELSE p.role END), ', ') AS flipped,
    array_to_string(list_transform(people[1:n - 1], lambda p: p.name || ' is a ' || p.role), ', ') AS partial,
    'Let me reason about ' || CASE WHEN o_orderkey % 4 = 1 THEN people[1].name
                                   ELSE array_to_string(list_transform(people, lambda p: p.name), ', ') END || '. ' ||
      repeat('step ', CAST(o_custkey % 250 AS INTEGER)) ||
      CASE WHEN o_orderkey % 3 = 0 THEN 'Wait, let me verify with ∨ and ∧.' ELSE 'Done.' END AS think
  FROM ppl),
resp AS (
  SELECT o_orderkey, solution_text,
    (CASE WHEN o_custkey % 2 = 0 THEN '<|im_start|>assistant' || chr(10) ELSE 'Assistant: ' END) ||
    CASE v
      WHEN 1 THEN '<think>' || think || '</think>' || chr(10) || '<answer>' || flipped || '</answer>'
      WHEN 2 THEN '<think>' || think || '</think>' || chr(10) || '<answer>' || partial || '</answer>'
      WHEN 3 THEN '<think>' || think || '</think>' || chr(10) || '<answer>' || good || ' and maybe a knave' || '</answer>'
      WHEN 4 THEN '<think>' || think || '</think>' || chr(10) || good
      WHEN 5 THEN '<think>' || think || '</think>' || chr(10) || '<answer>' || flipped || '</answer>' || chr(10) || '<answer>' || good || '</answer>'
      WHEN 6 THEN '<answer>' || good || '</answer>' || chr(10) || '<think>' || think || '</think>'
      ELSE '<think>' || think || '</think>' || chr(10) || '<answer>' || good || '</answer>' END AS response
  FROM txt),
proc AS (
  SELECT *, CASE WHEN contains(response, 'Assistant:') THEN substr(response, instr(response, 'Assistant:') + 10)
                 WHEN contains(response, '<|im_start|>assistant') THEN substr(response, instr(response, '<|im_start|>assistant') + 21)
                 ELSE response END AS processed
  FROM resp),
ans AS (
  SELECT *, regexp_extract_all(processed, '(?s)<answer>(.*?)</answer>', 1) AS blocks,
         list_filter(list_transform(string_split(solution_text, chr(10)), lambda l: {{
             'name': regexp_extract(trim(l), '(?i)\\b([A-Za-z]+)\\b.*?\\b(knight|knave)\\b', 1),
             'role': lower(regexp_extract(trim(l), '(?i)\\b([A-Za-z]+)\\b.*?\\b(knight|knave)\\b', 2))}}),
           lambda t: t.name <> '') AS truth
  FROM proc),
a2 AS (
  SELECT *, CASE WHEN len(blocks) > 0 THEN regexp_replace(blocks[-1], '^\\s+|\\s+$', '', 'g') END AS answer,
         list_transform(truth, lambda t: t.name) AS names, list_transform(truth, lambda t: t.role) AS roles
  FROM ans),
a3 AS (
  SELECT *, list_transform(names, lambda nm: lower(regexp_extract(answer, '(?i)\\b' || nm || '\\b\\s+is\\s+a\\s+\\b(knight|knave)\\b', 1))) AS pred_roles,
         (length(lower(answer)) - length(replace(lower(answer), 'knight', ''))) // 6
           + (length(lower(answer)) - length(replace(lower(answer), 'knave', ''))) // 5 AS n_roles
  FROM a2),
a4 AS (
  SELECT *, coalesce(answer IS NOT NULL AND n_roles = len(names) AND len(names) > 0
                     AND list_bool_and(list_transform(pred_roles, lambda r: r <> '')), false) AS parsed,
         coalesce(answer <> '', false) AS has_answer
  FROM a3),
a5 AS (
  SELECT *, parsed AND pred_roles = roles AS match,
    (length(processed) - length(replace(processed, '<think>', ''))) // 7 = 1
      AND (length(processed) - length(replace(processed, '</think>', ''))) // 8 = 1
      AND (length(processed) - length(replace(processed, '<answer>', ''))) // 8 = 1
      AND (length(processed) - length(replace(processed, '</answer>', ''))) // 9 = 1
      AND instr(processed, '<think>') <= instr(processed, '</think>')
      AND instr(processed, '</think>') <= instr(processed, '<answer>')
      AND instr(processed, '<answer>') <= instr(processed, '</answer>') AS format_ok,
    {_py_slice_sql('processed', "instr(processed, '<think>') - 1 + 7", "instr(processed, '</think>') - 1")} AS think
  FROM a4),
a6 AS (
  SELECT *, (1.0 + floor(len(regexp_extract_all(think, '\\b\\w+\\b')) / 100.0) * 1e-5)
            * power(0.5, len(list_filter(names, lambda nm: NOT contains(think, nm)))) AS f0,
         len(string_split_regex(regexp_replace(response, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS vlen
  FROM a5),
a7 AS (
  SELECT *, CASE WHEN f0 >= 1.0 THEN f0 + 1e-5 * (
      CAST(contains(lower(think), 'wait') AS INT) + CAST(contains(lower(think), 'verify') AS INT)
      + CAST(contains(lower(think), 'yet') AS INT) + CAST(contains(lower(think), 're-evaluate') AS INT)
      + CAST(contains(lower(think), 'review') AS INT) + CAST(contains(lower(think), '∨') AS INT)
      + CAST(contains(lower(think), '\\u2228') AS INT) + CAST(contains(lower(think), '∧') AS INT)
      + CAST(contains(lower(think), '\\u2227') AS INT) + CAST(contains(lower(think), '¬') AS INT)
      + CAST(contains(lower(think), '\\u00AC') AS INT)) ELSE f0 END AS factor
  FROM a6)
"""


def _puzzle_cols(spark, sf):
    r = S.with_puzzle_parse(puzzle_responses(spark, sf))
    return r, F.col("_pz_processed"), F.col("_pz_answer"), F.col("_pz_truth"), F.col("_pz_names")


@register("R5", _PUZZLE_SQL + "SELECT o_orderkey, answer FROM a7")
def r5_answer(spark, sf):
    r, processed, answer, *_ = _puzzle_cols(spark, sf)
    return r.select("o_orderkey", answer.alias("answer"))


@register("R6", _PUZZLE_SQL + "SELECT o_orderkey, array_to_string(names, ',') AS names, array_to_string(roles, ',') AS roles FROM a7")
def r6_truth(spark, sf):
    r, _p, _a, truth, names = _puzzle_cols(spark, sf)
    return r.select("o_orderkey", F.array_join(names, ",").alias("names"),
                    F.array_join(F.transform(truth, lambda t: t["role"]), ",").alias("roles"))


@register("R7", _PUZZLE_SQL + "SELECT o_orderkey, CASE WHEN parsed THEN array_to_string(pred_roles, ',') END AS predicted FROM a7")
def r7_predicted(spark, sf):
    r, _p, answer, truth, names = _puzzle_cols(spark, sf)
    return r.select("o_orderkey", F.when(F.col("_pz_parsed"), F.array_join(
        F.transform("_pz_pred", lambda p: p["role"]), ",")).alias("predicted"))


@register("R8", _PUZZLE_SQL + "SELECT o_orderkey, format_ok FROM a7")
def r8_structure(spark, sf):
    r, processed, *_ = _puzzle_cols(spark, sf)
    return r.select("o_orderkey", T.tags_in_order(processed, T.THINK_ANSWER_TAGS).alias("format_ok"))


@register("R9", _PUZZLE_SQL + """
SELECT o_orderkey,
  CAST((CASE WHEN format_ok THEN 1.0 ELSE -1.0 END) +
  (CASE WHEN format_ok AND has_answer AND match THEN 2.0 WHEN format_ok AND has_answer AND parsed THEN -1.5 ELSE -2.0 END) AS DOUBLE) AS score,
  CAST(CASE WHEN format_ok AND has_answer AND match THEN 1.0 ELSE 0.0 END AS DOUBLE) AS outcome_score,
  CAST(CASE WHEN format_ok THEN 1.0 ELSE 0.0 END AS DOUBLE) AS format_score
FROM a7""")
def r9_puzzle_v1(spark, sf):
    r = S.puzzle_scores(puzzle_responses(spark, sf), "v1")
    return r.select("o_orderkey", "score", "outcome_score", "format_score")


@register("R10", _PUZZLE_SQL + "SELECT o_orderkey, CAST(CASE WHEN has_answer AND match THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM a7")
def r10_puzzle_pure(spark, sf):
    r = S.puzzle_scores(puzzle_responses(spark, sf), "pure")
    return r.select("o_orderkey", "score")


# Scores of the "new" rule are exact multiples of 1e-5 / 2^k; they are
# reported as integers in units of 1e-11 so no decimal rounding tie can occur.
@register("R11", _PUZZLE_SQL + f"""
SELECT o_orderkey, CAST(round(1e11 * (
  (CASE WHEN NOT has_answer THEN -2.0 WHEN NOT parsed THEN -1.0 WHEN match THEN 2.0 * factor ELSE -0.5 END)
  + (CASE WHEN vlen <= 100 OR vlen >= {MAX_RESPONSE_TOKENS} THEN -1.0 ELSE 0.0 END))) AS BIGINT) AS score_e11
FROM a7""")
def r11_puzzle_new(spark, sf):
    r = puzzle_responses(spark, sf).withColumn("vlen", T.approx_tokens("response"))
    r = S.puzzle_scores(r, "new", valid_response_length="vlen", max_response_length=MAX_RESPONSE_TOKENS)
    return r.select("o_orderkey", F.round(F.col("score") * 1e11).cast("bigint").alias("score_e11"))


@register("R13", _PUZZLE_SQL + "SELECT o_orderkey, CAST(round(1e11 * factor) AS BIGINT) AS thinking_factor_e11 FROM a7")
def r13_thinking_factor(spark, sf):
    r = S.with_puzzle_parse(puzzle_responses(spark, sf))
    f = T.thinking_factor("_pz_processed", "_pz_names")
    return r.select("o_orderkey", F.round(f * 1e11).cast("bigint").alias("thinking_factor_e11"))


@register("R14", _PUZZLE_SQL + """
SELECT o_orderkey, CAST(CASE WHEN contains(processed, '∨') OR contains(processed, '\\u2228') OR contains(processed, '∧')
                          OR contains(processed, '\\u2227') OR contains(processed, '¬') OR contains(processed, '\\u00AC')
                        THEN 0.5 ELSE -0.1 END AS DOUBLE) AS logic_reward
FROM a7""")
def r14_logic(spark, sf):
    r = S.with_puzzle_parse(puzzle_responses(spark, sf))
    return r.select("o_orderkey", T.logic_symbol_reward("_pz_processed").alias("logic_reward"))


@register("R32", "SELECT o_orderkey, vlen AS n_tokens FROM (" + _PUZZLE_SQL + "SELECT * FROM a7)")
def r32_approx_tokens(spark, sf):
    r = puzzle_responses(spark, sf)
    return r.select("o_orderkey", T.approx_tokens("response").cast("bigint").alias("n_tokens"))


def _verify_sql() -> str:
    """The rules of the variant over responses with a verify block."""
    block = ("(CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) ELSE ' so ' END) || '<verify>' || "
             "repeat('check ', CAST(o_orderkey % 5 * 400 AS INTEGER)) || '</verify>' || "
             "(CASE WHEN o_custkey % 5 = 0 THEN chr(10) || chr(10) ELSE chr(10) END)")
    puzzle = _PUZZLE_SQL.replace("'</think>' || chr(10)", f"'</think>' || {block}")
    think = _py_slice_sql("processed", "instr(processed, '<think>') - 1 + 7", "instr(processed, '</verify>') - 1")
    toks = ["wait", "yet", "re-evaluate", "review", "∨", "\\u2228", "∧", "\\u2227", "¬", "\\u00AC"]
    bonus = " + ".join(f"CAST(contains(lower(tv), '{t}') AS INT)" for t in toks)
    tags = ["<think>", "</think>", "<verify>", "</verify>", "<answer>", "</answer>"]
    once = " AND ".join(f"len(string_split(processed, '{t}')) = 2" for t in tags)
    return puzzle + f""",
v1 AS (SELECT *, {think} AS tv, {once} AS once,
              {", ".join(f"strpos(processed, '{t}') - 1 AS at{i}" for i, t in enumerate(tags))} FROM a7),
v2 AS (SELECT *, power(0.5, len(list_filter(names, lambda nm: NOT contains(tv, nm)))) AS g0,
              once AND NOT (at0 > at1 OR at2 - (at1 + 8) > 1 OR at2 > at3 OR at4 - (at3 + 9) > 1 OR at4 > at5) AS fmt6,
              regexp_matches(response, '{_NON_LATIN_SQL_R}') AS non_latin,
              CASE WHEN vlen <= 500 OR vlen >= {MAX_VERIFY_TOKENS} THEN -1.0 ELSE 0.0 END AS len_score FROM v1),
v3 AS (SELECT *, CASE WHEN g0 = 1.0 THEN g0 + 1e-5 * ({bonus}) ELSE g0 END AS fv FROM v2)
"""


@register("R12", _verify_sql() + """
SELECT o_orderkey, CAST(round(1e11 * (
    (CASE WHEN NOT (fmt6 AND has_answer AND vlen > 500) THEN -2.0 WHEN NOT parsed THEN -1.0 WHEN match THEN 2.0 * fv ELSE -0.5 END)
    + (CASE WHEN fmt6 THEN 0.0 ELSE -1.0 END) + (CASE WHEN non_latin THEN -5.0 ELSE 0.0 END) + len_score)) AS BIGINT) AS score_e11,
  CAST(CASE WHEN fmt6 THEN 0.0 ELSE -1.0 END AS DOUBLE) AS format_score,
  CAST(CASE WHEN non_latin THEN -5.0 ELSE 0.0 END AS DOUBLE) AS language_mix_score,
  CAST(len_score AS DOUBLE) AS length_score,
  CAST(CASE WHEN fmt6 AND has_answer AND vlen > 500 AND match THEN 1.0 ELSE 0.0 END AS DOUBLE) AS outcome_score
FROM v3""")
def r12_puzzle_verify(spark, sf):
    """Verify-variant scores (structure of six tags, language rule, length window)."""
    r = puzzle_responses(spark, sf, verify=True).withColumn("vlen", T.approx_tokens("response"))
    r = S.puzzle_scores(r, "verify", valid_response_length="vlen", max_response_length=MAX_VERIFY_TOKENS)
    return r.select("o_orderkey", F.round(F.col("score") * 1e11).cast("bigint").alias("score_e11"),
                    "format_score", "language_mix_score", "length_score", "outcome_score")


# --- R15-R20: open / contest math answers built from part ------------------------------


def math_answers(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"))
    x = F.col("p_size").cast("string")
    y = (F.col("p_partkey") % 9 + 1).cast("string")
    price = F.floor("p_retailprice")
    v = F.col("p_partkey") % 16
    cases = {  # response, ground truth
        0: (F.concat(F.lit("Step 1: add. Step 2: so The answer is \\boxed{"), x, F.lit("}")), x),
        1: (F.concat(F.lit("The final answer is "), F.format_number(price, 0), F.lit(" dollars.")), price.cast("string")),
        2: (F.concat(F.lit("Answer: "), x, F.lit("\\%")), F.concat(x, F.lit("%"))),
        3: (F.concat(F.lit("Answer: ("), x, F.lit(", "), y, F.lit(")")), F.concat(F.lit("("), x, F.lit(","), y, F.lit(")"))),
        4: (F.concat(F.lit("<answer>so \\boxed{\\frac{"), x, F.lit("}{"), y, F.lit("}}</answer>")),
            F.concat(F.lit("\\frac{"), x, F.lit("}{"), y, F.lit("}"))),
        5: (F.concat(F.lit("The answer is "), x, F.lit(".0")), x),
        6: (F.concat(F.lit("user: hi Assistant: \\boxed{"), x, F.lit(" cm}")), x),
        7: (F.lit("no idea"), x),
        8: (F.concat(F.lit("so x = "), x), x),
        9: (F.concat(F.lit("Therefore we get "), x, F.lit(". So done. The ANSWER IS "), x, F.lit(" hours. bye")), x),
        10: (F.concat(F.lit("answer: ("), F.format_number(price, 0), F.lit(", "), y, F.lit(")")),
             F.concat(F.lit("("), price.cast("string"), F.lit(", "), y, F.lit(")"))),
        11: (F.concat(F.lit("Answer: \\boxed{"), x, F.lit(" "), y, F.lit("/7}")), F.concat(x, F.lit("+"), y, F.lit("/7"))),
        12: (F.concat(F.lit("\\boxed{"), x, F.lit("} and "), y, F.lit(" is the answer")), y),
        13: (F.concat(F.lit("the answers are ["), x, F.lit(", "), y, F.lit(") or more")), F.concat(F.lit("("), x, F.lit(","), y, F.lit(")"))),
        14: (F.concat(F.lit("<answer>\\boxed{"), (F.col("p_size") * 100).cast("string"), F.lit("}</answer>")), x),
        15: (F.concat(F.lit("answer is {"), x, F.lit(" million}")), F.concat(x, F.lit("*10^6"))),
    }
    resp = truth = None
    for k, (r, t) in cases.items():
        resp = F.when(v == k, r) if resp is None else resp.when(v == k, r)
        truth = F.when(v == k, t) if truth is None else truth.when(v == k, t)
    return p.select("p_partkey", resp.alias("response"), truth.alias("ground_truth"))


def _normalize_answer_sql(x: str) -> str:
    def q(v: str) -> str:
        return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for a, b in S.ANSWER_SUBSTITUTIONS:
        x = f"replace({x}, {q(a)}, {q(b)})"
    for w in S.REMOVED_WORDS:
        x = f"replace({x}, {q(w)}, '')"
    x = f"regexp_replace({x}, '(.*?)(\\$)(.*?)(\\$)(.*)', '$\\3$')"
    x = f"regexp_replace({x}, '(\\\\text\\{{)(.*?)(\\}})', '\\2')"
    x = f"regexp_replace({x}, '(\\\\textbf\\{{)(.*?)(\\}})', '\\2')"
    x = f"regexp_replace({x}, '(\\\\overline\\{{)(.*?)(\\}})', '\\2')"
    x = f"regexp_replace({x}, '(\\\\boxed\\{{)(.*)(\\}})', '\\2')"
    x = f"regexp_replace({x}, '(frac)([^{{])(.)', 'frac{{\\2}}{{\\3}}', 'g')"
    x = f"regexp_replace({x}, '(sqrt)([^{{])', 'sqrt{{\\2}}', 'g')"
    x = f"replace({x}, '$', '')"
    return f"(CASE WHEN regexp_matches({x}, '^[0-9,]*[0-9][0-9,]*$') THEN replace({x}, ',', '') ELSE {x} END)"


_MATH_SQL = r"""
WITH r AS (
  SELECT p_partkey, p_partkey % 16 AS v, CAST(p_size AS VARCHAR) AS x, CAST(p_partkey % 9 + 1 AS VARCHAR) AS y,
         CAST(p_size * 100 AS VARCHAR) AS x100,
         CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS price, format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) AS price_c
  FROM part),
m AS (
  SELECT p_partkey,
    CASE v WHEN 0 THEN 'Step 1: add. Step 2: so The answer is \boxed{' || x || '}'
           WHEN 1 THEN 'The final answer is ' || price_c || ' dollars.'
           WHEN 2 THEN 'Answer: ' || x || '\%'
           WHEN 3 THEN 'Answer: (' || x || ', ' || y || ')'
           WHEN 4 THEN '<answer>so \boxed{\frac{' || x || '}{' || y || '}}</answer>'
           WHEN 5 THEN 'The answer is ' || x || '.0'
           WHEN 6 THEN 'user: hi Assistant: \boxed{' || x || ' cm}'
           WHEN 7 THEN 'no idea'
           WHEN 8 THEN 'so x = ' || x
           WHEN 9 THEN 'Therefore we get ' || x || '. So done. The ANSWER IS ' || x || ' hours. bye'
           WHEN 10 THEN 'answer: (' || price_c || ', ' || y || ')'
           WHEN 11 THEN 'Answer: \boxed{' || x || ' ' || y || '/7}'
           WHEN 12 THEN '\boxed{' || x || '} and ' || y || ' is the answer'
           WHEN 13 THEN 'the answers are [' || x || ', ' || y || ') or more'
           WHEN 14 THEN '<answer>\boxed{' || x100 || '}</answer>'
           ELSE 'answer is {' || x || ' million}' END AS response,
    CASE v WHEN 1 THEN price WHEN 2 THEN x || '%' WHEN 3 THEN '(' || x || ',' || y || ')'
           WHEN 4 THEN '\frac{' || x || '}{' || y || '}' WHEN 10 THEN '(' || price || ', ' || y || ')'
           WHEN 11 THEN x || '+' || y || '/7' WHEN 12 THEN y WHEN 13 THEN '(' || x || ',' || y || ')'
           WHEN 15 THEN x || '*10^6' ELSE x END AS ground_truth
  FROM r)
"""


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number_sql(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{_NUMBER_RE}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


@register("R16", _MATH_SQL + f""",
n1 AS (SELECT p_partkey, {_normalize_answer_sql('response')} AS normalized, {_normalize_answer_sql('ground_truth')} AS truth FROM m),
n2 AS (SELECT *, replace(normalized, ',', '') AS u0, replace(truth, ',', '') AS v0 FROM n1),
n3 AS (SELECT *, {_strip_latex_sql('u0')} AS u, {_strip_latex_sql('v0')} AS v FROM n2),
n4 AS (SELECT *, {_number_sql('u')} AS x, {_number_sql('v')} AS y FROM n3)
SELECT p_partkey, normalized, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x = y ELSE u = v END AS same FROM n4""")
def r16_normalize(spark, sf):
    """Normalised answers, and their equality after the second pass."""
    r = math_answers(spark, sf).withColumn("normalized", S.normalize_answer("response"))
    return r.select("p_partkey", "normalized", S.stripped_equal("normalized", S.normalize_answer("ground_truth")).alias("same"))


def _last_boxed_sql(src: str, key: str, text: str, tag: str) -> str:
    """CTEs computing the inner text of the last balanced \\boxed{} (or \\fbox{}) of ``text``."""
    return rf"""
{tag}t AS (
  SELECT {key}, {text} AS s, CASE WHEN contains({text}, '\boxed') THEN '\boxed' || string_split({text}, '\boxed')[-1]
                   WHEN contains({text}, '\fbox') THEN '\fbox' || string_split({text}, '\fbox')[-1] END AS tail
  FROM {src}),
{tag}c AS (SELECT {key}, unnest(string_split(tail, '')) AS c, generate_subscripts(string_split(tail, ''), 1) AS i
           FROM {tag}t WHERE tail IS NOT NULL),
{tag}d AS (SELECT *, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS depth FROM {tag}c),
{tag}e AS (SELECT {key}, min(i) AS endpos FROM {tag}d WHERE c = '}}' AND depth = 0 GROUP BY {key}),
{tag}b AS (
  SELECT {tag}t.{key}, {tag}t.s,
    CASE WHEN contains(s, '\boxed ') THEN '\boxed ' || split_part(string_split(s, '\boxed ')[-1], '$', 1)
         WHEN endpos IS NOT NULL THEN substr(tail, 1, endpos) END AS boxed
  FROM {tag}t LEFT JOIN {tag}e USING ({key})),
{tag}u AS (
  SELECT {key}, s, CASE WHEN starts_with(boxed, '\boxed ') THEN substr(boxed, 8)
                        WHEN starts_with(boxed, '\boxed{{') AND ends_with(boxed, '}}') THEN substr(boxed, 8, length(boxed) - 8) END AS inner_box
  FROM {tag}b)
"""


def _located_sql() -> str:
    """The located answer: one CTE per marker, in order; ends in ``cn`` (answer)."""
    steps, at = ["c0 AS (SELECT p_partkey, response AS s, response AS text, false AS matched FROM m)"], 0

    def add(found, text, counts=True):
        nonlocal at
        steps.append(f"c{at + 1} AS (SELECT p_partkey, s, CASE WHEN {found} THEN {text} ELSE text END AS text, "
                     f"matched{f' OR {found}' if counts else ''} AS matched FROM c{at})")
        at += 1

    def after(marker):
        q = marker.replace("\n", "\\n")
        add(f"regexp_matches(text, '(?is){q}')", _strip_sql(f"regexp_extract(text, '(?is)^.*{q}(.*)$', 1)"))
    for m in ["answer:", "answer is", "answers are"]:
        after(m)
    for m in ["is answer", "is the answer", "are answers", "are the answers"]:
        add(f"regexp_matches(text, '(?is){m}')", _strip_sql(f"regexp_extract(text, '(?is)^(.*){m}', 1)"))
    boxes = _last_boxed_sql(f"c{at}", "p_partkey", "text", "cb")
    box = _strip_sql(r"regexp_extract(coalesce(boxed, ''), '(?s)^\\(?:boxed|fbox)[^{]*\{(.*)\}$', 1)")
    steps.append(boxes + f", c{at + 1} AS (SELECT c.p_partkey, c.s, CASE WHEN {box} <> '' THEN {box} ELSE text END AS text, "
                 f"matched OR {box} <> '' AS matched FROM c{at} c JOIN cbb USING (p_partkey))")
    at += 1
    add("contains(text, '. ')", _strip_sql(r"regexp_extract(text, '(?s)^(.*)\. ', 1)"), counts=False)
    for m in ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]:
        after(m)
    steps.append(f"cn AS (SELECT p_partkey, s, CASE WHEN matched AND regexp_matches(text, '\\p{{Nd}}') THEN text END AS answer FROM c{at})")
    return ",\n" + ",\n".join(steps)


_CONTEST_SQL = _MATH_SQL + _located_sql()


def _contest_norm_sql(src: str, column: str, tag: str) -> str:
    """CTEs over ``src`` ending in ``{tag}n`` with the normalised ``column`` as ``{tag}_norm``."""
    y = rf"regexp_replace({column}, '^\\text\{{(.+?)\}}$', '\1')"
    for a, b in [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "),
                 ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]:
        y = f"replace({y}, '{a}', '{b}')"
    for unit in ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month",
                 "year", "foot", "feet", "inch", "yard", "liter"]:
        y = rf"regexp_replace({y}, '{unit}(es)?(s)? *(\^[0-9]+)?', '', 'g')"
    y = rf"regexp_replace({y}, '\^ *\\circ', '', 'g')"
    y = rf"regexp_replace({y}, '(?s)^\{{(.*)\}}$', '\1')"
    y = rf"regexp_replace({y}, ',\\! *', '', 'g')"
    z = r"replace(replace(y2, '\tfrac', '\frac'), '\dfrac', '\frac')"
    z = rf"regexp_replace({z}, '\\frac\{{([^{{}}]*)\}}\{{([^{{}}]*)\}}', ' \1/\2', 'g')"
    z = rf"regexp_replace({z}, '\\sqrt\{{([^{{}}]*)\}}', 'sqrt(\1)', 'g')"
    for a, b in [("\\infty", "inf"), ("\\pi", "pi"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*")]:
        z = f"replace({z}, '{a}', '{b}')"
    z = rf"lower(regexp_replace(regexp_replace({_strip_sql(z)}, '- *', '-', 'g'), '([0-9]) +([0-9])', '\1+\2', 'g'))"

    def whole(x):
        return f"{x} IS NOT NULL AND abs({x} - round({x})) <= 1e-7 AND abs({x}) < 1e15"
    return f"""
{tag}1 AS (SELECT *, {y} AS y1 FROM {src}),
{tag}2 AS (SELECT * EXCLUDE (y1), CASE WHEN {whole(_number_sql('y1'))} THEN CAST(CAST(round({_number_sql('y1')}) AS BIGINT) AS VARCHAR) ELSE y1 END AS y2 FROM {tag}1),
{tag}3 AS (SELECT * EXCLUDE (y2), {z} AS y3 FROM {tag}2),
{tag}4 AS (SELECT *, {_number_sql(_thousands_sql('y3'))} AS y4 FROM {tag}3),
{tag}n AS (SELECT * EXCLUDE (y3, y4), CASE WHEN {whole('y4')} THEN CAST(CAST(y4 AS BIGINT) AS VARCHAR) ELSE y3 END AS {tag}_norm FROM {tag}4)"""


def _thousands_sql(x: str) -> str:
    for _ in range(4):
        x = rf"regexp_replace({x}, '([0-9]),([0-9][0-9][0-9])($|[^0-9])', '\1\2\3', 'g')"
    return x


def _plain_sql(x: str) -> str:
    x = rf"(CASE WHEN regexp_matches({x}, '^\$[0-9]+(\.[0-9]+)?') THEN substr({x}, 2) ELSE {x} END)"
    return rf"(CASE WHEN regexp_matches({x}, '^[0-9]+(\.[0-9]+)?\\?%$') THEN regexp_replace({x}, '\\?%$', '') ELSE {x} END)"


def _equal_sql(u: str, v: str) -> str:
    """Equality of two plain answers (columns)."""
    x, y = (_number_sql(f"replace(replace({c}, '{{,}}', ''), ',', '')") for c in (u, v))

    def close(b):
        return f"(abs({x} - {b}) <= 1e-4 * greatest(abs({x}), abs({b})))"
    return (f"(lower({_strip_sql(u)}) = lower({_strip_sql(v)}) OR replace({u}, ' ', '') = replace({v}, ' ', '') "
            f"OR coalesce({close(y)} OR {close(y + ' * 100')} OR {close(y + ' / 100')}, false))")


@register("R17", _CONTEST_SQL + """
SELECT p_partkey, answer, contains(s, 'Step 2:') AND contains(s, '\\box') AS format_ok FROM cn""")
def r17_contest_answer(spark, sf):
    """Contest-math answer location and format flag."""
    r = math_answers(spark, sf)
    return r.select("p_partkey", S.contest_math_answer("response").alias("answer"),
                    S.contest_math_format_ok("response").alias("format_ok"))


@register("R18", _CONTEST_SQL + "," + _contest_norm_sql("cn", "answer", "na") + """
SELECT p_partkey, na_norm AS normalized FROM nan""")
def r18_contest_normalize(spark, sf):
    """Contest-math normalisation of the located answer."""
    r = math_answers(spark, sf).withColumn("answer", S.contest_math_answer("response"))
    return r.select("p_partkey", S.contest_math_normalize("answer").alias("normalized"))


_PARTS_SQL = r"""CASE WHEN regexp_matches({x}, '^[()\[\]][^()\[\]]+[()\[\]]$')
  THEN list_transform(string_split(substr({x}, 2, length({x}) - 2), ','), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')) ELSE [{x}] END"""
_FRACTION_RE = r"^(?:(-?[0-9.]+)\+)?(-?[0-9.]+)/([0-9.]+)$"


def _value_sql(x: str) -> str:
    part = [_number_sql(f"regexp_extract({x}, '{_FRACTION_RE}', {g})") for g in (1, 2, 3)]
    return (f"coalesce({_number_sql(x)}, CASE WHEN regexp_matches({x}, '{_FRACTION_RE}') "
            f"THEN coalesce({part[0]}, 0.0) + {part[1]} / nullif({part[2]}, 0) END)")


def _item_equal_sql(t: str, g: str) -> str:
    frac = r"'^-?[0-9]+.?/0*[1-9][0-9]*.?$'"

    def whole(x):
        n = _number_sql(_thousands_sql(x))
        return f"coalesce(abs({n} - round({n})) <= 1e-7 AND abs({n}) < 1e15, false)"
    return (f"(CASE WHEN regexp_matches({t}, {frac}) AND regexp_matches({g}, {frac}) THEN {t} = {g} "
            f"WHEN {whole(t)} <> {whole(g)} THEN false "
            f"ELSE {t} = {g} OR coalesce(abs({_value_sql(t)} - {_value_sql(g)}) <= 1e-9 * greatest(abs({_value_sql(t)}), 1.0), false) END)")


_SCORE_SQL = (_CONTEST_SQL + ",\ng0 AS (SELECT cn.p_partkey, cn.answer, m.ground_truth AS gt FROM cn JOIN m USING (p_partkey)),"
              + _contest_norm_sql("g0", "answer", "ga") + "," + _contest_norm_sql("gan", "gt", "gg") + f""",
g1 AS (SELECT *, {_thousands_sql('ga_norm')} AS gv, {_thousands_sql('gg_norm')} AS tv, {_strip_sql('answer')} AS l0, {_strip_sql('gt')} AS l1,
              {_plain_sql('answer')} AS pa, {_plain_sql('gt')} AS pb FROM ggn),
g2 AS (SELECT *, {_PARTS_SQL.replace('{x}', 'gv')} AS gp, {_PARTS_SQL.replace('{x}', 'tv')} AS tp,
              list_transform(string_split(regexp_replace(answer, '^[(\\[]|[)\\]]$', '', 'g'), ','), lambda p: {_strip_sql('p')}) AS ia,
              list_transform(string_split(regexp_replace(gt, '^[(\\[]|[)\\]]$', '', 'g'), ','), lambda p: {_strip_sql('p')}) AS ib FROM g1),
itm AS (SELECT p_partkey, bool_and({_item_equal_sql('t', 'g')}) AS items FROM (
          SELECT p_partkey, unnest(gp) AS g, unnest(tp) AS t FROM g2 WHERE len(gp) = len(tp)) GROUP BY p_partkey),
itp AS (SELECT p_partkey, bool_and({_equal_sql(_plain_sql('t'), _plain_sql('g'))}) AS items FROM (
          SELECT p_partkey, unnest(ia) AS t, unnest(ib) AS g FROM g2 WHERE len(ia) = len(ib)
            AND regexp_matches(answer, '^[(\\[].+[)\\]]$') AND regexp_matches(gt, '^[(\\[].+[)\\]]$')) GROUP BY p_partkey),
g3 AS (SELECT g2.*, coalesce(itm.items, false) AS same_items, coalesce(itp.items, false) AS same_plain
       FROM g2 LEFT JOIN itm USING (p_partkey) LEFT JOIN itp USING (p_partkey))
""")


@register("R19", _SCORE_SQL + f"""
SELECT p_partkey, CAST(CASE WHEN answer IS NULL THEN 0.0
  WHEN {_strip_latex_sql('l0')} = {_strip_latex_sql('l1')} THEN 1.0
  WHEN ga_norm = gg_norm THEN 1.0
  WHEN length(ga_norm) > 0 AND same_items AND (len(tp) <= 1 OR (substr(ga_norm, 1, 1) = substr(gg_norm, 1, 1) AND right(ga_norm, 1) = right(gg_norm, 1))) THEN 1.0
  WHEN {_equal_sql('pa', 'pb')} OR same_plain THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM g3""")
def r19_tuples(spark, sf):
    """Tuple / interval comparison inside the contest-math scorer."""
    r = math_answers(spark, sf)
    return r.select("p_partkey", S.contest_math_score("response", "ground_truth")["score"].alias("score"))


_OPEN_SQL = _MATH_SQL + rf""",
op AS (
  SELECT p_partkey, ground_truth,
    CASE WHEN contains(response, 'Assistant:') THEN substr(response, instr(response, 'Assistant:') + 10)
         WHEN contains(response, '<|im_start|>assistant') THEN substr(response, instr(response, '<|im_start|>assistant') + 21)
         ELSE response END AS processed
  FROM m),
op2 AS (
  SELECT *, regexp_extract_all(processed, '(?s)<answer>.*?(\\boxed\{{.*\}}).*?</answer>', 1) AS in_tags,
            regexp_extract_all(processed, '(?s)(\\boxed\{{.*\}})', 1) AS anywhere FROM op),
op3 AS (
  SELECT *, {_strip_sql("CASE WHEN len(in_tags) > 0 THEN in_tags[-1] WHEN len(anywhere) > 0 THEN anywhere[-1] END")} AS answer
  FROM op2),
""" + _last_boxed_sql("op3", "p_partkey", "answer", "oa") + "," + _last_boxed_sql("op3", "p_partkey", "ground_truth", "og") + f""",
op4 AS (
  SELECT op3.p_partkey, op3.answer, op3.processed, {_normalize_answer_sql('oau.inner_box')} AS pred,
         {_normalize_answer_sql('coalesce(ogu.inner_box, op3.ground_truth)')} AS truth
  FROM op3 JOIN oau USING (p_partkey) JOIN ogu USING (p_partkey)),
op5 AS (SELECT *, replace(pred, ',', '') AS u0, replace(truth, ',', '') AS v0 FROM op4),
op6 AS (SELECT *, {_strip_latex_sql('u0')} AS u, {_strip_latex_sql('v0')} AS v FROM op5),
op7 AS (SELECT *, CASE WHEN {_number_sql('u')} IS NOT NULL AND {_number_sql('v')} IS NOT NULL
                       THEN {_number_sql('u')} = {_number_sql('v')} ELSE u = v END AS same FROM op6)
"""


@register("R15", _OPEN_SQL + f"""
SELECT p_partkey, CAST(
  (CASE WHEN answer IS NULL OR answer = '' THEN -2.0 WHEN pred IS NULL OR pred = '' THEN -1.0
        WHEN same THEN 1.0 ELSE -0.5 END)
  + (CASE WHEN regexp_matches(processed, '(?i)(assistant:|user:|human:)') THEN -5.0 ELSE 0.0 END) AS DOUBLE) AS score,
  CAST(CASE WHEN regexp_matches(processed, '(?i)(assistant:|user:|human:)') THEN -5.0 ELSE 0.0 END AS DOUBLE) AS chat_score
FROM op7""")
def r15_open_math(spark, sf):
    """Open-math scorer (boxed answer in tags, role-marker leak)."""
    r = math_answers(spark, sf)
    res = S.open_math_score("response", "ground_truth")
    return r.select("p_partkey", res["score"].alias("score"), res["extra"]["chat_score"].alias("chat_score"))


_AMOUNT_SQL = """
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem),
e AS (SELECT *, CASE l_orderkey % 4 WHEN 0 THEN a WHEN 1 THEN a * 100 WHEN 2 THEN a + a * d // 100000 ELSE a + a * d // 100 END AS b FROM c),
f AS (SELECT *, format('{:,}', a // 100) || '.' || lpad(CAST(a % 100 AS VARCHAR), 2, '0') AS u,
             (CASE WHEN l_linenumber % 2 = 0 THEN '$' ELSE '' END) || (b // 100) || '.' || lpad(CAST(b % 100 AS VARCHAR), 2, '0') AS v FROM e)
SELECT l_orderkey, l_linenumber,
       abs(a - b) <= 1e-4 * greatest(a, b) OR abs(a - b * 100) <= 1e-4 * greatest(a, b * 100)
       OR abs(a - b / 100) <= 1e-4 * greatest(a, b / 100) AS equal
FROM f
"""


@register("R20", _AMOUNT_SQL)
def r20_numeric_equal(spark, sf):
    """Amounts as text, one with thousands commas, the other with a money sign at times."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("a"),
                                             F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    k = F.col("l_orderkey") % 4
    li = li.withColumn("b", F.when(k == 0, F.col("a")).when(k == 1, F.col("a") * 100)
                       .when(k == 2, F.expr("a + a * d div 100000")).otherwise(F.expr("a + a * d div 100")))

    def cents(c):
        return F.lpad(F.expr(f"{c} % 100").cast("string"), 2, "0")
    u = F.concat(F.format_number(F.expr("a div 100"), 0), F.lit("."), cents("a"))
    v = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "$").otherwise(""), F.expr("b div 100").cast("string"), F.lit("."), cents("b"))
    return li.select("l_orderkey", "l_linenumber", S.answers_equal(u, v).alias("equal"))


# --- R21 / R22: code tasks from recorded outcomes ----------------------------------------

@register("R21", """
WITH t AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id, event_type <> 'error' AS passed FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY event_id) AS rk FROM t)
SELECT user_id, CAST(d AS VARCHAR) AS day, count(*) AS n_tests,
       CASE WHEN bool_and(passed) THEN 1.0
            ELSE avg(CASE WHEN rk <= 10 THEN (CASE WHEN passed THEN 1.0 ELSE 0.0 END) END) END AS score
FROM f GROUP BY 1, 2
""")
def r21_code_scores(spark, sf):
    ev = table(spark, sf, "events").select(
        F.struct("user_id", F.to_date("ts").cast("string").alias("day")).alias("task"),
        F.col("event_id").alias("test_id"), (F.col("event_type") != "error").alias("passed"))
    out = S.code_task_scores(ev)
    return out.select("task.user_id", "task.day", "n_tests", "score")


@register("R22", r"""
SELECT conv_id, turn,
  text = regexp_replace(text, ' +' || chr(10), chr(10), 'g')
  OR array_to_string(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10))
   = array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, ' +' || chr(10), chr(10), 'g'), '^\s+|\s+$', '', 'g'), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10))
  AS same_output
FROM conversations
""")
def r22_output_compare(spark, sf):
    c = table(spark, sf, "conversations")
    expected = F.regexp_replace("text", " +\n", "\n")
    return c.select("conv_id", "turn", T.outputs_equal("text", expected).alias("same_output"))


# --- R23-R26: routing, reward manager, failures, samples -----------------------------------

CODE_SOURCES = ["codecontests", "apps", "codeforces", "taco"]


def mixed_responses(spark, sf):
    n = number_responses(spark, sf).select(
        F.lit("openai/gsm8k").alias("data_source"),
        F.concat_ws("-", F.lit("li"), "l_orderkey", "l_linenumber").alias("id"), "response", "ground_truth")
    b = boxed_responses(spark, sf).select(
        F.lit("lighteval/MATH").alias("data_source"), F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("id"),
        "response", "ground_truth")
    k = puzzle_responses(spark, sf).select(
        F.lit("kk_logic").alias("data_source"), F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id"),
        "response", F.col("solution_text").alias("ground_truth"))
    outcomes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(F.call_function(
        "shiftright", F.col("p_partkey") * 7 + F.col("p_partkey") % 13 * 4095, i).bitwiseAND(F.lit(1)) == 1, "1").otherwise("0")), ",")
    c = table(spark, sf, "part").select(
        F.element_at(F.array(*[F.lit(x) for x in CODE_SOURCES]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("data_source"),
        F.concat(F.lit("c-"), F.col("p_partkey").cast("string")).alias("id"), F.lit("def main(): pass").alias("response"),
        outcomes.alias("ground_truth"))
    return n.unionByName(b).unionByName(k).unionByName(c)


_MIXED_SQL = ("WITH num AS (" + _NUM_SQL + "SELECT 'openai/gsm8k' AS data_source, 'li-' || l_orderkey || '-' || l_linenumber AS id, "
              "CASE WHEN strict IS NULL THEN 0.0 WHEN strict = ground_truth THEN 1.0 ELSE 0.0 END AS score, response FROM f), "
              "box AS (" + _BOXED_SQL + f""",
u AS (SELECT p_partkey, ground_truth, response,
             CASE WHEN starts_with(boxed, '\\boxed ') THEN substr(boxed, 8)
                  WHEN starts_with(boxed, '\\boxed{{') AND ends_with(boxed, '}}') THEN substr(boxed, 8, length(boxed) - 8) END AS ans
      FROM b)
SELECT 'lighteval/MATH' AS data_source, 'p-' || p_partkey AS id,
       CASE WHEN ans IS NOT NULL AND {_strip_latex_sql('ans')} = {_strip_latex_sql('ground_truth')} THEN 1.0 ELSE 0.0 END AS score,
       response FROM u), """
              "kk AS (" + _PUZZLE_SQL + "SELECT 'kk_logic' AS data_source, 'o-' || o_orderkey AS id, "
              "CASE WHEN has_answer AND match THEN 1.0 ELSE 0.0 END AS score, response FROM a7), "
              f"code AS (SELECT {CODE_SOURCES}[p_partkey % 4 + 1] AS data_source, 'c-' || p_partkey AS id, "
              "CASE WHEN list_min(o) = 1 THEN 1.0 ELSE list_sum(o[1:10]) / 10.0 END AS score, 'def main(): pass' AS response FROM ("
              "SELECT p_partkey, list_transform(range(12), lambda i: ((p_partkey * 7 + p_partkey % 13 * 4095) >> i) & 1) AS o FROM part)), "
              "mixed AS (SELECT * FROM num UNION ALL SELECT * FROM box UNION ALL SELECT * FROM kk UNION ALL SELECT * FROM code) ")


@register("R23", _MIXED_SQL + "SELECT data_source, id, CAST(score AS DOUBLE) AS score FROM mixed")
def r23_routing(spark, sf):
    reg = S.default_registry("pure")
    m = mixed_responses(spark, sf)
    return m.select("data_source", "id", reg.score_column("data_source", "response", "ground_truth")["score"].alias("score"))


@register("R24", _MIXED_SQL + r"""
SELECT data_source, id, CAST(score AS DOUBLE) AS score,
       len(string_split_regex(regexp_replace(response, '^\s+|\s+$', '', 'g'), '\s+')) AS n_tokens,
       CAST(score AS DOUBLE) AS last_token_score, CAST(0.0 AS DOUBLE) AS outcome_score
FROM mixed
""")
def r24_reward_manager(spark, sf):
    m = mixed_responses(spark, sf).withColumn(
        "response_mask", F.array_repeat(F.lit(1), T.approx_tokens("response")))
    out = S.reward_manager(m, S.default_registry("pure"), extra_keys=["outcome_score"])
    return out.select("data_source", "id", "score", F.size("response_mask").cast("bigint").alias("n_tokens"),
                      F.element_at("token_level_scores", -1).alias("last_token_score"),
                      F.when(F.col("data_source") == "kk_logic", 0.0).otherwise(F.col("outcome_score")).alias("outcome_score"))


@register("R25", _MIXED_SQL + """
SELECT data_source, count(*) AS n, CAST(sum(score) AS DOUBLE) AS total_score FROM mixed GROUP BY 1
""")
def r25_failures_zero(spark, sf):
    """Scores that fail to parse count as 0; totals per source."""
    m = mixed_responses(spark, sf).withColumn("response_mask", F.array(F.lit(1)))
    out = S.reward_manager(m, S.default_registry("pure"))
    return out.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total_score"))


@register("R26", """
SELECT event_type, event_id FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rk FROM events)
WHERE rk <= 3
""")
def r26_first_per_source(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "event_id")
    return S.first_rows_per_key(ev, "event_type", "event_id", 3)


# --- R27 / R28: evaluation-time parsers -------------------------------------------------

def legacy_responses(spark, sf):
    """CONCLUSION-style answers: correct, an extra item, an 'if', one wrong role."""
    r = puzzle_responses(spark, sf).select("o_orderkey", "solution_text")
    lines = F.split("solution_text", "\n")
    facts = F.transform(lines, lambda l: F.regexp_replace(l, r"^\(\d+\) ", ""))
    n = F.size(lines)
    gold = F.when(n == 1, facts[0]).otherwise(F.concat(
        F.array_join(F.slice(facts, 1, n - 1), ", "), F.lit(", and "), F.element_at(facts, -1), F.lit(".")))
    v = F.col("o_orderkey") % 4
    concl = (F.when(v == 1, F.concat(F.col("solution_text"), F.lit("\n("), (n + 1).cast("string"), F.lit(") nobody else")))
              .when(v == 2, F.concat(F.col("solution_text"), F.lit("\nonly if we trust them")))
              .when(v == 3, F.regexp_replace("solution_text", "knight", "knave"))
              .otherwise(F.col("solution_text")))
    resp = F.concat(F.lit("Reasoning here. CONCLUSION: "), concl, F.lit("\n### Reason: done\n### Question next"))
    return r.select("o_orderkey", resp.alias("response"), gold.alias("answer_text"))


def _legacy_sql() -> str:
    judged = "pred_answer"
    for fp in S.FINISH_PATTERNS:
        judged = f"split_part({judged}, '{fp.replace(chr(39), chr(39) * 2)}', 1)"
    return _PUZZLE_SQL + f""",
lg AS (SELECT o_orderkey, solution_text, string_split(solution_text, chr(10)) AS lines FROM resp),
lg2 AS (SELECT *, list_transform(lines, lambda l: regexp_replace(l, '^\\(\\d+\\) ', '')) AS facts, len(lines) AS n FROM lg),
lg3 AS (
  SELECT o_orderkey, n,
    CASE WHEN n = 1 THEN facts[1] ELSE array_to_string(facts[1:n - 1], ', ') || ', and ' || facts[n] || '.' END AS answer_text,
    'Reasoning here. CONCLUSION: ' || CASE o_orderkey % 4
        WHEN 1 THEN solution_text || chr(10) || '(' || (n + 1) || ') nobody else'
        WHEN 2 THEN solution_text || chr(10) || 'only if we trust them'
        WHEN 3 THEN replace(solution_text, 'knight', 'knave')
        ELSE solution_text END || chr(10) || '### Reason: done' || chr(10) || '### Question next' AS response
  FROM lg2),
lg4 AS (
  SELECT *, split_part(response, '### Question', 1) AS pred,
         list_transform(string_split(replace(replace(answer_text, ' and ', ''), '.', ''), ','),
                        lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')) AS gold
  FROM lg3),
lg5 AS (SELECT *, CASE WHEN contains(pred, 'CONCLUSION:') AND length(split_part(pred, 'CONCLUSION:', 2)) > 0
                       THEN split_part(pred, 'CONCLUSION:', 2) ELSE pred END AS pred_answer FROM lg4),
lg6 AS (SELECT *, {judged} AS j FROM lg5),
lg7 AS (SELECT *, contains(j, '(' || (len(gold) + 1) || ')') AS beyond, contains(j, 'if') AS has_if,
               len(list_filter(gold, lambda g: contains(j, g))) AS found FROM lg6)
"""


@register("R27", _legacy_sql() + """
SELECT o_orderkey, NOT beyond AND NOT has_if AND found = len(gold) AS is_correct,
       CASE WHEN beyond THEN 'beyond_list' WHEN has_if THEN 'contain_if' WHEN found < len(gold) THEN 'wrong_identity'
            ELSE 'no_conclusion_matched' END AS wrong_reason,
       round(CASE WHEN beyond OR has_if THEN 0.0 ELSE found * 1.0 / len(gold) END, 6) AS correct_ratio
FROM lg7""")
def r27_legacy_parse(spark, sf):
    """Legacy CONCLUSION parser."""
    r = S.legacy_parse(legacy_responses(spark, sf), "response", "answer_text")
    return r.select("o_orderkey", "is_correct", "wrong_reason", F.round("correct_ratio", 6).alias("correct_ratio"))


@register("R28", _PUZZLE_SQL + """
SELECT o_orderkey, CASE WHEN has_answer AND match THEN 1 ELSE 0 END AS score FROM a7
""")
def r28_alt_parse(spark, sf):
    r = S.alt_puzzle_parse(puzzle_responses(spark, sf))
    return r.select("o_orderkey", "score")


# --- R29-R31 / K12: digit completion prompts from orders ---------------------------------

def digit_prompts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    prompt = F.concat_ws(",", (F.col("o_orderkey") % 10).cast("string"), (F.col("o_custkey") % 10).cast("string"))
    info = F.concat_ws(",", (F.col("o_orderkey") % 11 + 10).cast("string"), (F.col("o_custkey") % 6 + 1).cast("string"))
    return o.select("o_orderkey", "o_custkey", F.concat(prompt, F.lit(":"), info).alias("prompt"))


_DIGIT_SQL = """
WITH p AS (SELECT o_orderkey, o_custkey, o_orderkey % 10 AS a, o_custkey % 10 AS b, o_orderkey % 11 + 10 AS m,
                  o_custkey % 6 + 1 AS n FROM orders),
g AS (SELECT *, ((b - a) % m + m) % m AS d FROM p),
t AS (SELECT *, array_to_string(list_transform(range(1, n + 1), lambda k: CAST((b + d * k) % m AS VARCHAR)), ',') AS truth FROM g),
r AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN truth WHEN 1 THEN substr(truth, 1, length(truth) - 1) || 'x'
                     WHEN 2 THEN truth || ',7' ELSE '' END AS response FROM t),
c AS (SELECT *, coalesce((SELECT min(i) FROM range(1, least(length(response), length(truth)) + 1) s(i)
                          WHERE substr(response, i, 1) <> substr(truth, i, 1)) - 1, least(length(response), length(truth))) AS lcp
      FROM r)
"""


@register("R30", _DIGIT_SQL + "SELECT o_orderkey, truth FROM t")
def r30_digit_truth(spark, sf):
    p = digit_prompts(spark, sf)
    return p.select("o_orderkey", S.digit_ground_truth("prompt").alias("truth"))


def _digit_responses(spark, sf):
    p = digit_prompts(spark, sf).withColumn("truth", S.digit_ground_truth("prompt"))
    v = F.col("o_orderkey") % 4
    resp = (F.when(v == 0, F.col("truth"))
             .when(v == 1, F.concat(F.expr("substr(truth, 1, length(truth) - 1)"), F.lit("x")))
             .when(v == 2, F.concat(F.col("truth"), F.lit(",7"))).otherwise(F.lit("")))
    return p.withColumn("response", resp)


@register("R29", _DIGIT_SQL + """
SELECT o_orderkey, length(response) AS n_chars, lcp AS n_rewarded,
       round(lcp * 1.0 / (length(truth) + 1), 9) AS total_reward FROM c
""")
def r29_dense_reward(spark, sf):
    r = _digit_responses(spark, sf).withColumn("reward", S.dense_prefix_reward("response", "truth"))
    return r.select("o_orderkey", F.length("response").cast("bigint").alias("n_chars"),
                    F.size(F.filter("reward", lambda x: x > 0)).cast("bigint").alias("n_rewarded"),
                    F.round(F.aggregate("reward", F.lit(0.0), lambda a, x: a + x), 9).alias("total_reward"))


@register("R31", _DIGIT_SQL + """
SELECT o_orderkey,
  round(CASE WHEN length(response) = 0 THEN (CASE WHEN length(truth) = 0 THEN 1.0 ELSE 0.0 END) * 24
             ELSE lcp * 1.0 / (length(truth) + 1)
                  + (24 - length(response)) * (CASE WHEN lcp >= length(response) THEN 1.0 / (length(truth) + 1) ELSE 0.0 END) END, 9)
  AS padded_reward
FROM c
""")
def r31_pad_dense(spark, sf):
    """Dense reward padded with its last value to 24 positions (longer than any response), times an all-ones mask."""
    r = _digit_responses(spark, sf).withColumn("reward", S.dense_prefix_reward("response", "truth"))
    padded = S.pad_dense_reward("reward", "truth", F.array_repeat(F.lit(1), 24))
    return r.select("o_orderkey", F.round(F.aggregate(padded, F.lit(0.0), lambda a, x: a + x), 9).alias("padded_reward"))


DIGIT_TASK = (16, 5, 8)  # largest number, largest difference, most numbers to complete


@register("K12", f"""
WITH d AS (SELECT o_orderkey, {seeded_sql('o_orderkey', 17)} % {S.digit_prompt_count(*DIGIT_TASK)} AS i FROM orders),
e AS (SELECT *, i // 54 AS a, (i // 9) % 6 AS diff, i % 9 AS n FROM d)
SELECT o_orderkey, a || ',' || (a + diff) % 16 || ':16,' || n AS prompt FROM e""")
def k12_digit_prompts(spark, sf):
    """One of all enumerated prompts drawn for each order."""
    o = table(spark, sf, "orders").select("o_orderkey")
    index = F.pmod(seeded_draw("o_orderkey", 17), F.lit(S.digit_prompt_count(*DIGIT_TASK)))
    return o.select("o_orderkey", S.digit_prompt_at(index, *DIGIT_TASK).alias("prompt"))


@register("K12_all", f"""
WITH i AS (SELECT unnest(range({S.digit_prompt_count(*DIGIT_TASK)})) AS i),
d AS (SELECT {seeded_sql('o_orderkey', 17)} % {S.digit_prompt_count(*DIGIT_TASK)} AS i, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(i.i AS BIGINT) AS prompt_index, i.i // 54 || ',' || (i.i // 54 + (i.i // 9) % 6) % 16 || ':16,' || i.i % 9 AS prompt,
       CAST(coalesce(d.n, 0) AS BIGINT) AS n_orders
FROM i LEFT JOIN d ON i.i = d.i""")
def k12_all_digit_prompts(spark, sf):
    """Every prompt with the number of orders that drew it."""
    index = F.pmod(seeded_draw("o_orderkey", 17), F.lit(S.digit_prompt_count(*DIGIT_TASK))).cast("long")
    drawn = table(spark, sf, "orders").select(index.alias("prompt_index")).groupBy("prompt_index").agg(F.count(F.lit(1)).alias("n"))
    return S.all_digit_prompts(spark, *DIGIT_TASK).join(drawn, "prompt_index", "left").select(
        "prompt_index", "prompt", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders"))


# --- R16, R19, R20 as expressions, intervals and matrices ----------------------------------

def _number_parts(spark, sf):
    """Small whole numbers from parts; ``d`` is 0 where the two sides are the same."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", (F.col("p_size") % 9 + 2).alias("a"), (F.col("p_partkey") % 7 + 1).alias("b"),
                    (F.col("p_partkey") % 5 + 1).alias("c"), (F.floor(F.col("p_retailprice")).cast("long") % 3).alias("d"))


def _written(template: str, **numbers) -> F.Column:
    """``template`` with <name> replaced by numbers."""
    out = F.lit(template)
    for name, value in numbers.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


def _pairs_of(parts, templates: list[tuple[str, str]]):
    """Both sides of each part's pair, the templates in turn."""
    a, b, c, d = (F.col(x) for x in "abcd")
    numbers = {"a": a, "b": b, "c": c, "d": d, "ab": a * b, "ac": a * c, "abd": a * b + d, "acd": a * c + d, "bc": b + c, "bcd": b + c + d,
               "b*c+d": b * c + d, "bb": b * b, "aab": a * a * b, "ad": a + d, "bd": b + d, "cd": c + d}
    kind = F.col("p_partkey") % len(templates)
    left = right = F.lit(None).cast("string")
    for k, (x, y) in enumerate(templates):
        used = {n: v for n, v in numbers.items() if f"<{n}>" in x + y}
        left = F.when(kind == k, _written(x, **used)).otherwise(left)
        right = F.when(kind == k, _written(y, **used)).otherwise(right)
    return parts.select("p_partkey", left.alias("given"), right.alias("truth"))


_SAME_SQL = "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) % 3 = 0 AS same FROM part"

EXPRESSION_PAIRS = [
    ("<a>(<b>x+<c>)", "<ab>x+<acd>"), ("(x+<b>)(x+<c>)", "x^2+<bc>x+<b*c+d>"), ("\\frac{x^2-<bb>}{x-<b>}", "x+<bd>"),
    ("\\sqrt{<aab>}", "<ad>\\sqrt{<b>}"), ("<b>\\pi+<c>", "\\pi \\cdot <b> + <cd>"), ("\\frac{<a>x}{<ab>}", "x/<bd>"),
    ("x^{<b>}x^{<c>}", "x^{<bcd>}"), ("no answer <b>", "no answer  <bd>"), ("-(y-<b>)^2+<c>", "2*<b>y-y**2-<bb>+<cd>"),
]
FORM_PAIRS = [
    ("Interval.open(<a>, <ab>)", "(<a>,<abd>)"), ("Interval.Ropen(-<a>, <b>)", "[-<a>, <bd>)"),
    ("Matrix([[<a>, <b>], [<c>, <ab>]])", "\\begin{pmatrix}<a>&<b>\\\\<c>&<abd>\\end{pmatrix}"), ("((<a>,<b>),<c>)", "((<a>, <b>), <cd>)"),
    ("(<a>(t+<b>), <c>)", "(<a>t+<abd>, <c>)"), ("[<a>, <b>), [<c>, 9]", "[<a>,<bd>),[<c>,9]"), ("\\left(\\frac12, <b>\\right)", "(1/2, <bd>)"),
]


@register("R16_symbolic", _SAME_SQL)
def r16_symbolic(spark, sf):
    """Answers as expressions; the two sides are written so that they agree where d is 0 only."""
    pairs = _pairs_of(_number_parts(spark, sf), EXPRESSION_PAIRS)
    return pairs.select("p_partkey", X.expressions_equal("given", "truth").alias("same"))


@register("R19_nested", _SAME_SQL)
def r19_nested(spark, sf):
    """Tuples with inner brackets, intervals and matrices."""
    pairs = _pairs_of(_number_parts(spark, sf), FORM_PAIRS)
    return X.with_forms_equal(pairs, "given", "truth", "same").select("p_partkey", "same")


# --- R25 with a deadline, scorers by name, functions over chunks ---------------------------

def patient_score(response: str, truth: str) -> float:
    """1 where the text after the marker is the truth; waits for a marker for ever."""
    at = 0
    while not response.startswith("####", at):
        at = (at + 1) % (len(response) + 1)
    return float(int(response[at + 4:]) == int(truth))


@register("R25_deadline", """
SELECT o_orderkey, CASE WHEN o_orderkey % 997 IN (0, 1) THEN 0.0 WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
       CASE o_orderkey % 997 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error: ValueError' END AS reason
FROM orders
""")
def r25_deadline(spark, sf):
    """Responses of which some have no marker (the scorer never ends) or no number (it fails)."""
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    o = o.select("o_orderkey", F.when(k % 997 == 0, F.lit("no marker")).when(k % 997 == 1, F.lit("so #### none"))
                 .otherwise(F.concat(F.lit("so #### "), k.cast("string"))).alias("response"),
                 (k + F.when(k % 5 == 0, 1).otherwise(0)).cast("string").alias("truth"))
    scorer = U.named_scorer("gradewise.plans.scoring", "patient_score")
    return U.score_with_deadline(spread(o), scorer, ["response", "truth"], 0.25).select("o_orderkey", "score", "reason")


def running_share(chunk):
    """Each order's place and its price's rank among the prices of its chunk."""
    import pyarrow.compute as pc
    return pa.table({"o_orderkey": chunk["o_orderkey"], "place": pa.array(range(chunk.num_rows), pa.int64()),
                     "price_rank": pc.rank(chunk["o_totalprice"], tiebreaker="first").cast(pa.int64())})


@register("D1_chunks", """
WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, i % 256 AS place, row_number() OVER (PARTITION BY i // 256 ORDER BY o_totalprice, i) AS price_rank FROM o
""")
def d1_chunks(spark, sf):
    """A user function over chunks of 256 orders in the order of their keys."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    schema = StructType().add("o_orderkey", "long").add("place", "long").add("price_rank", "long")
    return U.map_chunks(o, running_share, schema, 256, "o_orderkey")
