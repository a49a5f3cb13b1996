"""Puzzle corpus queries (K1-K6, K9, K10, K13), seeded by the keys of ``orders``.

Every order key seeds one candidate puzzle (2 + key % 7 people), so the
corpus grows with the table.  The DuckDB twins re-implement the integer-hash
generator, the solver (as a join with the assignment space) and the renderer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import puzzle_text as PT
from ..operators import puzzles as K
from ..functions.common import seeded_sql
from ..operators.index import row_count, with_global_index
from ..session import ROWS_A_TASK, spread, table, tasks_for
from .registry import register


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"

SEED = 0


def _dealt_keys(spark, sf):
    """The puzzle keys and the number of tasks they are dealt to."""
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    tasks = tasks_for(keys, ROWS_A_TASK)
    return spread(keys, tasks), tasks


def puzzle_keys(spark, sf):
    return _dealt_keys(spark, sf)[0]


def candidates(spark, sf):
    return K.sample_puzzles(puzzle_keys(spark, sf))


def generated(spark, sf):
    """Generated, solved and de-duplicated puzzles."""
    keys, tasks = _dealt_keys(spark, sf)
    return K.generate(keys, seed=SEED, tasks=tasks)


def unique(spark, sf):
    """The puzzles of ``generated`` as narrow rows, for numbering and splitting."""
    return K.unique_puzzles(puzzle_keys(spark, sf), seed=SEED)


def restored(puzzles):
    return K.restored(puzzles)


def rendered(puzzles):
    return K.render(puzzles, seed=SEED)


def corpus(spark, sf):
    """Generated, solved, de-duplicated and rendered puzzles."""
    return rendered(generated(spark, sf))


def _draw(k: str, salt: str, seed: int = SEED) -> str:
    return seeded_sql(k, seed, salt)


def _leaf_sql(j: str) -> tuple[str, str]:
    lie = f"({j} >= n)"
    who = f"(CASE WHEN {j} < n THEN {j} ELSE ({j} - n) + CASE WHEN {j} - n >= p THEN 1 ELSE 0 END END)"
    return lie, who


_L1, _W1 = _leaf_sql("j1")
_L2, _W2 = _leaf_sql("j2")
_OPS_SQL = "[" + ", ".join(f"'{o}'" for o in K.OPS) + "]"

_GEN_SQL = f"""
c AS (SELECT o_orderkey AS k, CAST(o_orderkey % 7 + 2 AS BIGINT) AS n FROM orders),
pp AS (SELECT k, n, unnest(range(n)) AS p FROM c),
d0 AS (SELECT k, n, p, {_draw('k', 'p * 16')} % 6 AS d, {_draw('k', 'p * 16 + 1')} % (2 * n - 1) AS j1,
              {_draw('k', 'p * 16 + 2')} % (2 * n - 2) AS r2 FROM pp),
st AS (SELECT k, n, p, {_OPS_SQL}[d + 1] AS op, d, {_L1} AS lie1, {_W1} AS who1,
              {_L2} AS lie2, {_W2} AS who2
       FROM (SELECT *, (j1 + 1 + r2) % (2 * n - 1) AS j2 FROM d0)),
asg AS (SELECT k, n, unnest(range(CAST(1 AS BIGINT) << n)) AS a FROM c),
ev AS (
  SELECT asg.k, asg.a, st.p,
    (CASE st.op WHEN 'leaf' THEN v1 WHEN 'not' THEN NOT v1 WHEN 'and' THEN v1 AND v2 WHEN 'or' THEN v1 OR v2
                WHEN '->' THEN (NOT v1) OR v2 ELSE v1 = v2 END) = (((asg.a >> st.p) & 1) = 1) AS ok
  FROM asg JOIN (SELECT *, 0 AS dummy FROM st) st ON st.k = asg.k,
       LATERAL (SELECT (((asg.a >> st.who1) & 1) = 1) <> st.lie1 AS v1,
                       (((asg.a >> st.who2) & 1) = 1) <> st.lie2 AS v2)),
sol AS (SELECT k, a FROM ev GROUP BY k, a HAVING bool_and(ok)),
res AS (SELECT c.k, c.n, count(sol.a) AS n_solutions,
               CASE WHEN count(sol.a) = 1 THEN min(sol.a) ELSE -1 END AS solution_bits
        FROM c LEFT JOIN sol USING (k) GROUP BY c.k, c.n),
rp AS (
  SELECT k, '(' || string_agg(CASE op WHEN 'leaf' THEN l1 WHEN 'not' THEN '(''not'', ' || l1 || ')'
                                      ELSE '(''' || op || ''', ' || l1 || ', ' || l2 || ')' END, ', ' ORDER BY p) || ')' AS statements_repr
  FROM (SELECT *, '(''' || CASE WHEN lie1 THEN 'lying' ELSE 'telling-truth' END || ''', ' || who1 || ')' AS l1,
                  '(''' || CASE WHEN lie2 THEN 'lying' ELSE 'telling-truth' END || ''', ' || who2 || ')' AS l2 FROM st)
  GROUP BY k),
gen AS (
  SELECT min(k) AS k, statements_repr FROM res JOIN rp USING (k) WHERE n_solutions = 1 GROUP BY statements_repr)
"""


@register("K1", "WITH " + _GEN_SQL + "SELECT k, CAST(n AS INT) AS n, CAST(n_solutions AS INT) AS n_solutions, CAST(solution_bits AS INT) AS solution_bits FROM res")
def k1_solve(spark, sf):
    s = K.solve(candidates(spark, sf))
    return s.select("k", "n", "n_solutions", F.col("solution_bits").cast("int").alias("solution_bits"))


@register("K2", "WITH " + _GEN_SQL + """
SELECT gen.k, CAST(res.n AS INT) AS n, gen.statements_repr, CAST(res.solution_bits AS INT) AS solution_bits
FROM gen JOIN res USING (k)
""")
def k2_generate(spark, sf):
    g = generated(spark, sf)
    return g.select("k", "n", "statements_repr", F.col("solution_bits").cast("int").alias("solution_bits"))


# --- K6: render (oracle re-implements names, templates and sentences) ------------------

_NAMES_SQL = "[" + ", ".join(f"'{x}'" for x in PT.COMMON_NAMES) + "]"
_TEMPLATES_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in PT.TEMPLATES) + "]"

_RENDER_SQL = _GEN_SQL + f""",
nm AS (
  SELECT k, list_transform(list_sort(list_transform(range({len(PT.COMMON_NAMES)}),
             lambda i: {{'h': {_draw('k', '5000 + i')}, 'name': {_NAMES_SQL}[i + 1]}})), lambda e: e.name) AS pool
  FROM gen),
nms AS (SELECT gen.k, res.n, pool[1:res.n] AS names, res.solution_bits FROM gen JOIN res USING (k) JOIN nm USING (k)),
sts AS (
  SELECT st.k, st.p, st.op,
    names[who1 + 1] || CASE WHEN op = 'not' THEN ' is not ' ELSE ' is ' END || CASE WHEN lie1 THEN 'a knave' ELSE 'a knight' END AS t1,
    names[who2 + 1] || ' is ' || CASE WHEN lie2 THEN 'a knave' ELSE 'a knight' END AS t2,
    names[st.p + 1] AS speaker,
    {_TEMPLATES_SQL}[{_draw('st.k', '6000 + st.p')} % {len(PT.TEMPLATES)} + 1] AS tmpl
  FROM st JOIN nms USING (k)),
txt AS (
  SELECT k, string_agg(' ' || replace(replace(tmpl, '{{name}}', speaker), '{{content}}',
           CASE op WHEN 'leaf' THEN t1 WHEN 'not' THEN t1 WHEN 'and' THEN t1 || ' and ' || t2 WHEN 'or' THEN t1 || ' or ' || t2
                   WHEN '->' THEN 'If ' || t1 || ' then ' || t2 ELSE t1 || ' if and only if ' || t2 END), '' ORDER BY p) AS body
  FROM sts GROUP BY k),
rend AS (
  SELECT nms.k, nms.names,
    'A very special island is inhabited only by knights and knaves. Knights always tell the truth, and knaves always lie. '
      || 'You meet ' || nms.n || ' inhabitants: ' || array_to_string(names[1:nms.n - 1], ', ') || ', and ' || names[nms.n] || '.'
      || txt.body || ' So who is a knight and who is a knave?' AS quiz,
    list_transform(range(nms.n), lambda i: names[i + 1] || ' is ' || CASE WHEN ((solution_bits >> i) & 1) = 1 THEN 'a knight' ELSE 'a knave' END) AS sol
  FROM nms JOIN txt USING (k)),
fin AS (
  SELECT k, names, quiz, array_to_string(sol[1:len(sol) - 1], ', ') || ', and ' || sol[len(sol)] || '.' AS solution_text,
         array_to_string(list_transform(range(len(sol)), lambda i: '(' || (i + 1) || ') ' || sol[i + 1]), chr(10)) AS solution_text_format
  FROM rend)
"""


@register("K6", "WITH " + _RENDER_SQL + "SELECT k, array_to_string(names, ',') AS names, quiz, solution_text, solution_text_format FROM fin")
def k6_render(spark, sf):
    c = corpus(spark, sf)
    return c.select("k", F.array_join("names", ",").alias("names"), "quiz", "solution_text", "solution_text_format")


@register("P12", "WITH " + _RENDER_SQL + "SELECT k, solution_text_format FROM fin")
def p12_numbered_solution(spark, sf):
    c = corpus(spark, sf)
    return c.select("k", K.format_solution_text("solution_text").alias("solution_text_format"))


@register("K3")
def k3_perturb_statement(spark, sf):
    """One whole statement replaced; unique, different solution (oracle in perturb_checks)."""
    g = generated(spark, sf)
    p = K.perturb(g, leaf=False, batches=True)
    return p.select("k", "cand", "n", K.statements_repr("statements").alias("statements_repr"),
                    F.col("solution_bits").cast("int").alias("solution_bits"))


@register("K4")
def k4_perturb_leaf(spark, sf):
    """One leaf replaced; unique, different solution (oracle in perturb_checks)."""
    g = generated(spark, sf)
    p = K.perturb(g, leaf=True)
    return p.select("k", "cand", "n", K.statements_repr("statements").alias("statements_repr"),
                    F.col("solution_bits").cast("int").alias("solution_bits"))


def _variant_sql(tag: str, uncommon: bool = False, pairs: bool = False, flip: bool = False,
                 reorder: bool = False) -> str:
    """CTEs rendering one K5 variant; output CTE ``{tag}f`` (k, quiz, solution_text)."""
    pool = PT.UNCOMMON_NAMES if uncommon else PT.COMMON_NAMES
    pool_sql = "[" + ", ".join(f"'{x}'" for x in pool) + "]"
    if pairs:
        idx = f"({_draw('k', '9000')} % {len(PT.KNIGHT_KNAVE_PAIRS)} + 1)"
        ak = "[" + ", ".join(f"'{a}'" for a, _ in PT.KNIGHT_KNAVE_PAIRS) + f"][{idx}]"
        av = "[" + ", ".join(f"'{b}'" for _, b in PT.KNIGHT_KNAVE_PAIRS) + f"][{idx}]"
    else:
        ak, av = "'a knight'", "'a knave'"
    if flip:
        ak, av = av, ak
    order = "p"
    if reorder:
        order = "list_position(perm, p)"
    return f"""
{tag}n AS (
  SELECT gen.k, res.n, res.solution_bits,
    list_transform(list_sort(list_transform(range({len(pool)}),
      lambda i: {{'h': {_draw('gen.k', '5000 + i')}, 'name': {pool_sql}[i + 1]}})), lambda e: e.name)[1:res.n] AS names,
    {ak.replace('k,', 'gen.k,').replace('(k)', '(gen.k)')} AS a_knight, {av.replace('k,', 'gen.k,').replace('(k)', '(gen.k)')} AS a_knave
  FROM gen JOIN res USING (k)),
{tag}r AS (
  SELECT *, string_split(a_knight, ' ')[2] AS kw, string_split(a_knave, ' ')[2] AS vw,
    list_transform(list_sort(list_transform(range(n), lambda p: {{'h': {_draw('k', '7000 + p')}, 'p': p}})), lambda e: e.p) AS perm0
  FROM {tag}n),
{tag}q AS (
  SELECT *, CASE WHEN perm0 = list_transform(range(n), lambda p: p) THEN list_transform(range(n), lambda p: (p + 1) % n)
                 ELSE perm0 END AS perm FROM {tag}r),
{tag}s AS (
  SELECT st.k, st.p, st.op, q.perm,
    q.names[who1 + 1] || CASE WHEN op = 'not' THEN ' is not ' ELSE ' is ' END || CASE WHEN lie1 THEN q.a_knave ELSE q.a_knight END AS t1,
    q.names[who2 + 1] || ' is ' || CASE WHEN lie2 THEN q.a_knave ELSE q.a_knight END AS t2,
    q.names[st.p + 1] AS speaker,
    {_TEMPLATES_SQL}[{_draw('st.k', '6000 + st.p')} % {len(PT.TEMPLATES)} + 1] AS tmpl
  FROM st JOIN {tag}q q USING (k)),
{tag}t AS (
  SELECT k, string_agg(' ' || replace(replace(tmpl, '{{name}}', speaker), '{{content}}',
           CASE op WHEN 'leaf' THEN t1 WHEN 'not' THEN t1 WHEN 'and' THEN t1 || ' and ' || t2 WHEN 'or' THEN t1 || ' or ' || t2
                   WHEN '->' THEN 'If ' || t1 || ' then ' || t2 ELSE t1 || ' if and only if ' || t2 END), '' ORDER BY {order}) AS body
  FROM {tag}s GROUP BY k),
{tag}f AS (
  SELECT q.k,
    'A very special island is inhabited only by ' || kw || 's and ' || vw || 's. '
      || upper(substr(kw, 1, 1)) || lower(substr(kw, 2)) || 's always tell the truth, and ' || vw || 's always lie. '
      || 'You meet ' || q.n || ' inhabitants: ' || array_to_string(names[1:q.n - 1], ', ') || ', and ' || names[q.n] || '.'
      || t.body || ' So who is ' || a_knight || ' and who is ' || a_knave || '?' AS quiz,
    array_to_string(list_transform(range(q.n - 1), lambda i: names[i + 1] || ' is '
        || CASE WHEN ((solution_bits >> i) & 1) = 1 THEN a_knight ELSE a_knave END), ', ')
      || ', and ' || names[q.n] || ' is ' || CASE WHEN ((solution_bits >> (q.n - 1)) & 1) = 1 THEN a_knight ELSE a_knave END
      || '.' AS solution_text
  FROM {tag}q q JOIN {tag}t t USING (k))
"""


_K5_SQL = ("WITH " + _GEN_SQL + "," + _variant_sql("vp", pairs=True) + "," + _variant_sql("vf", flip=True) + ","
           + _variant_sql("vu", uncommon=True) + "," + _variant_sql("vr", reorder=True) + """
SELECT k, 'pairs' AS variant, quiz, solution_text FROM vpf
UNION ALL SELECT k, 'flip', quiz, solution_text FROM vff
UNION ALL SELECT k, 'uncommon', quiz, solution_text FROM vuf
UNION ALL SELECT k, 'reorder', quiz, solution_text FROM vrf
""")


@register("K5", _K5_SQL)
def k5_surface_variants(spark, sf):
    """Role-word pairs, flipped roles, uncommon names and reordered statements."""
    g = generated(spark, sf)
    variants = []
    for name, kw in [("pairs", dict(random_pairs=True)), ("flip", dict(flip_roles=True)),
                     ("uncommon", dict(uncommon_names=True)), ("reorder", dict(reorder=True))]:
        r = K.render(g, seed=SEED, **kw).select("k", F.lit(name).alias("variant"), "quiz", "solution_text")
        variants.append(r)
    out = variants[0]
    for v in variants[1:]:
        out = out.unionByName(v)
    return out


@register("K9", "WITH " + _GEN_SQL + f""",
w AS (
  SELECT gen.k, res.n, res.solution_bits,
         {_draw('gen.k', '8000', 2)} % greatest(res.n - 1, 1) + 1 AS m,
         list_transform(list_sort(list_transform(range(res.n), lambda p: {{'h': {_draw('gen.k', '8100 + p', 2)}, 'p': p}})),
                        lambda e: e.p) AS ord
  FROM gen JOIN res USING (k))
SELECT k, array_to_string(list_transform(range(n), lambda i:
         CASE WHEN (((solution_bits >> i) & 1) = 1) <> list_contains(ord[1:m], i) THEN '1' ELSE '0' END), '') AS wrong_solution
FROM w
""")
def k9_wrong_solutions(spark, sf):
    g = generated(spark, sf)
    wrong = K.flipped_solution("k", "n", "solution", seed=2)
    return g.select("k", F.array_join(F.transform(wrong, lambda b: F.when(b, "1").otherwise("0")), "").alias("wrong_solution"))


@register("K13", "WITH " + _GEN_SQL + f""",
r AS (SELECT k, row_number() OVER (ORDER BY {seeded_sql('k', 13)}, k) - 1 AS rk, count(*) OVER () AS total FROM gen)
SELECT k, CASE WHEN rk < floor(0.8 * total) THEN 'train' ELSE 'test' END AS split FROM r
""")
def k13_split(spark, sf):
    from ..functions.common import seeded_draw
    g = unique(spark, sf).select("k")
    ranked = with_global_index(g.withColumn("_h", seeded_draw("k", 13)), ["_h", "k"], "rk")
    n = row_count(ranked)
    return ranked.select("k", F.when(F.col("rk") < F.floor(n * 0.8), "train").otherwise("test").alias("split"))


def corpus_with_steps(spark, sf):
    return K.render_steps(K.reasoning_steps(corpus(spark, sf)))


_STEPS_CTES = """
g AS (SELECT gen.k, res.n, res.solution_bits AS s FROM gen JOIN res USING (k)),
ordr(k, j, o) AS (
  SELECT k, CAST(0 AS BIGINT), list_transform(range(n), lambda x: x) FROM g
  UNION ALL
  SELECT r.k, r.j + 1,
    r.o[1:r.j + 1] || list_filter(mm.m, lambda x: list_contains(r.o[r.j + 2:], x))
      || list_filter(r.o[r.j + 2:], lambda x: NOT list_contains(mm.m, x))
  FROM ordr r JOIN g ON g.k = r.k JOIN st ON st.k = r.k AND st.p = r.o[r.j + 1],
  LATERAL (SELECT CASE WHEN st.op IN ('leaf', 'not') OR st.who1 = st.who2 THEN [st.who1] ELSE [st.who1, st.who2] END AS m) mm
  WHERE r.j + 1 < g.n),
pp2 AS (SELECT ordr.k, g.n, g.s, ordr.j, ordr.o[ordr.j + 1] AS p, ordr.o[1:ordr.j] AS before FROM ordr JOIN g USING (k)),
cand AS (SELECT k, n, s, j, p, before, unnest(list_append(before, p)) AS q FROM pp2 WHERE ((s >> p) & 1) = 0),
cand2 AS (SELECT *, list_sum(list_transform(list_append(before, p), lambda x: CAST(1 AS BIGINT) << x)) AS dm,
                 coalesce(list_sum(list_transform(before, lambda x: CAST(1 AS BIGINT) << x)), 0) AS bm FROM cand),
ev2 AS (
  SELECT cand2.k, cand2.j, cand2.q,
    bool_or((CASE st.op WHEN 'leaf' THEN v1 WHEN 'not' THEN NOT v1 WHEN 'and' THEN v1 AND v2 WHEN 'or' THEN v1 OR v2
                        WHEN '->' THEN (NOT v1) OR v2 ELSE v1 = v2 END)
            = (CASE WHEN cand2.q = cand2.p THEN true ELSE ((cand2.s >> cand2.q) & 1) = 1 END)) AS sat
  FROM cand2
  JOIN st ON st.k = cand2.k AND st.p = cand2.q
  JOIN asg ON asg.k = cand2.k AND (asg.a & cand2.dm) = ((cand2.s & cand2.bm) | (CAST(1 AS BIGINT) << cand2.p)),
  LATERAL (SELECT (((asg.a >> st.who1) & 1) = 1) <> st.lie1 AS v1, (((asg.a >> st.who2) & 1) = 1) <> st.lie2 AS v2)
  GROUP BY cand2.k, cand2.j, cand2.q),
conf AS (SELECT k, j, min(q) AS cq FROM ev2 WHERE NOT sat GROUP BY k, j),
steps AS (
  SELECT pp2.k, pp2.j, pp2.p, 0 AS sub, true AS assignment, 'conflict' AS outcome, conf.cq AS conflict_person,
         CASE WHEN conf.cq = pp2.p THEN true ELSE ((pp2.s >> conf.cq) & 1) = 1 END AS conflict_assignment
  FROM conf JOIN pp2 USING (k, j)
  UNION ALL
  SELECT k, j, p, 1, ((s >> p) & 1) = 1, 'ok', NULL, NULL FROM pp2)
"""

_K7_SQL = "WITH RECURSIVE " + _GEN_SQL + "," + _STEPS_CTES + """
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY j, sub) - 1 AS INT) AS pos, CAST(p AS INT) AS person,
       assignment, outcome, CAST(conflict_person AS INT) AS conflict_person, conflict_assignment
FROM steps
"""


@register("K7", _K7_SQL)
def k7_reasoning_steps(spark, sf):
    """Reasoning steps per puzzle (person order)."""
    c = K.reasoning_steps(generated(spark, sf))
    # every puzzle has a step; the plain form would add a filter that derives the steps twice
    ex = c.select("k", F.posexplode_outer("steps").alias("pos", "s"))
    return ex.select("k", "pos", "s.person", "s.assignment", "s.outcome", "s.conflict_person", "s.conflict_assignment")




_STEP_TEXT_SQL = "WITH RECURSIVE " + _RENDER_SQL + "," + _STEPS_CTES + """,
stp AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY j, sub) - 1 AS pos, p, assignment, outcome, conflict_person,
               conflict_assignment FROM steps),
cl AS (SELECT k, p, CASE op WHEN 'leaf' THEN t1 WHEN 'not' THEN t1 WHEN 'and' THEN t1 || ' and ' || t2
                         WHEN 'or' THEN t1 || ' or ' || t2 WHEN '->' THEN 'If ' || t1 || ' then ' || t2
                         ELSE t1 || ' if and only if ' || t2 END AS claim FROM sts),
sen AS (
  SELECT stp.k, stp.pos,
    CASE WHEN outcome = 'ok' THEN 'Assume ' || nms.names[stp.p + 1] || ' is ' || CASE WHEN assignment THEN 'a knight' ELSE 'a knave' END
              || '. No contradiction is found in their ' || CASE WHEN assignment THEN '' ELSE 'false ' END
              || 'claim that ' || cl.claim || '.'
         ELSE nms.names[stp.p + 1] || ' cannot be ' || CASE WHEN assignment THEN 'a knight' ELSE 'a knave' END
              || ', because this would contradict the ' || CASE WHEN conflict_assignment THEN '' ELSE 'false ' END
              || 'claim of ' || CASE WHEN conflict_person = stp.p THEN 'their own' ELSE nms.names[conflict_person + 1] END || '.'
    END AS sentence
  FROM stp JOIN nms USING (k) JOIN cl ON cl.k = stp.k AND cl.p = stp.p),
txt2 AS (SELECT k, string_agg(sentence, ' ' ORDER BY pos) AS steps_text,
                string_agg(sentence, ' ' ORDER BY """ + _draw('k', '9100 + pos', 3) + """, sentence) AS shuffled_steps
         FROM sen GROUP BY k)
"""


@register("K8", _STEP_TEXT_SQL + f"""
SELECT k, {_q(PT.COT_HEAD)} AS cot_head, steps_text, {_q(PT.STEP_FOOTER_SUCCESS)} AS cot_foot FROM txt2""")
def k8_step_text_checked(spark, sf):
    c = corpus_with_steps(spark, sf)
    return c.select("k", "cot_head", F.array_join("cot_repeat_steps", " ").alias("steps_text"), "cot_foot")


@register("K10", _STEP_TEXT_SQL + "SELECT k, shuffled_steps FROM txt2")
def k10_shuffled_checked(spark, sf):
    c = corpus_with_steps(spark, sf)
    return c.select("k", F.array_join(K.shuffled("cot_repeat_steps", "k"), " ").alias("shuffled_steps"))


@register("P14", _STEP_TEXT_SQL + f"""
SELECT k, {_q(PT.SYSTEM_INSTRUCTION + chr(10) + chr(10) + "### Question: ")} || quiz || {_q(chr(10) + "### Answer: " + PT.COT_HEAD + " ")}
          || steps_text || {_q(" " + PT.STEP_FOOTER_SUCCESS + chr(10) + "CONCLUSION:" + chr(10))} || solution_text_format || '</s>' AS text
FROM txt2 JOIN fin USING (k)""")
def p14_finetune_cot_checked(spark, sf):
    from ..operators import prep as P
    c = corpus_with_steps(spark, sf)
    return c.select("k", P.finetune_text_cot("quiz", "cot_repeat_steps", "cot_foot", "solution_text_format", "</s>").alias("text"))


def mapped_sql(x: str) -> str:
    """SQL twin of the name mapping in ``replace_one_step`` (at most 8 people)."""
    for i in range(8):
        x = (f"CASE WHEN len(p_names) > {i} THEN regexp_replace({x}, '\\b' || p_names[{i + 1}] || '\\b', "
             f"chr(1) || '{i}' || chr(2), 'g') ELSE {x} END")
    for i in range(8):
        x = f"replace({x}, chr(1) || '{i}' || chr(2), coalesce(names[{i + 1}], 'someone'))"
    return x


_K11_SQL = _STEP_TEXT_SQL + """,
sl AS (SELECT k, list(sentence ORDER BY pos) AS steps FROM sen GROUP BY k),
rk AS (SELECT sl.k, sl.steps, nms.names, row_number() OVER (ORDER BY """ + seeded_sql('sl.k', 5) + """, sl.k) - 1 AS i,
              count(*) OVER () AS total FROM sl JOIN nms USING (k)),
pr AS (SELECT a.k, a.steps, a.names, b.steps AS p_steps, b.names AS p_names,
              """ + _draw('a.k', '9300', 5) + """ % len(a.steps) AS at_,
              """ + _draw('a.k', '9400', 5) + """ % len(b.steps) AS start_
       FROM rk a JOIN rk b ON b.i = (a.i + 1) % a.total),
cd AS (SELECT k, steps, at_, list_filter(list_transform(range(len(p_steps)), lambda o: """ + mapped_sql("p_steps[(start_ + o) % len(p_steps) + 1]") + """),
                                     lambda c: c <> steps[at_ + 1])[1] AS new_step FROM pr)
SELECT k, CAST(at_ AS INT) AS replaced_at,
       array_to_string(list_transform(range(len(steps)), lambda j: CASE WHEN j = at_ THEN new_step ELSE steps[j + 1] END), ' ') AS steps_text
FROM cd WHERE new_step IS NOT NULL
"""


@register("K11", _K11_SQL)
def k11_replace_step(spark, sf):
    """One step replaced by a differing step of another puzzle, names mapped."""
    r = K.replace_one_step(corpus_with_steps(spark, sf))
    return r.select("k", "replaced_at", F.array_join("replaced_steps", " ").alias("steps_text"))
