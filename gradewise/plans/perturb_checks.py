"""DuckDB oracles for the perturbation jobs.

The oracle evaluates every candidate of every puzzle with 64-bit words in SQL: "person i is
a knight" is a fixed pattern per word, each statement a few bit operations, and the
consistent assignments the AND with the other speakers' words.
"""

from __future__ import annotations

from ..operators import puzzles as K
from .puzzles import _GEN_SQL, _OPS_SQL, _draw
from .registry import SQL

SEED = 1


def _knight_word(i: str, w: int) -> str:
    pats = ", ".join(str(x) for x in K._LOW_PATTERNS)
    return f"(CASE WHEN {i} < 6 THEN [{pats}][{i} + 1] ELSE (CASE WHEN (({w} >> ({i} - 6)) & 1) = 1 THEN -1 ELSE 0 END) END)"


def _leaf_word(lie: str, who: str, w: int) -> str:
    kw = _knight_word(who, w)
    return f"(CASE WHEN {lie} THEN ~{kw} ELSE {kw} END)"


def _stmt_word(op: str, l1: str, w1: str, l2: str, w2: str, w: int) -> str:
    v1, v2 = _leaf_word(l1, w1, w), _leaf_word(l2, w2, w)
    return (f"(CASE {op} WHEN 'leaf' THEN {v1} WHEN 'not' THEN ~{v1} WHEN 'and' THEN {v1} & {v2} "
            f"WHEN 'or' THEN {v1} | {v2} WHEN '->' THEN ~{v1} | {v2} ELSE ~xor({v1}, {v2}) END)")


def _valid_word(n: str, w: int) -> str:
    low = f"((CAST(1 AS BIGINT) << {n}) - {64 * w})"
    return f"(CASE WHEN {low} >= 64 THEN -1 WHEN {low} <= 0 THEN 0 ELSE (CAST(1 AS BIGINT) << {low}) - 1 END)"


def _leaf_repr(lie: str, who: str) -> str:
    return "('(''' || CASE WHEN " + lie + " THEN 'lying' ELSE 'telling-truth' END || ''', ' || " + who + " || ')')"


def _stmt_repr(op: str, l1: str, w1: str, l2: str, w2: str) -> str:
    a1, a2 = _leaf_repr(l1, w1), _leaf_repr(l2, w2)
    return ("(CASE " + op + " WHEN 'leaf' THEN " + a1 + " WHEN 'not' THEN '(''not'', ' || " + a1 + " || ')' "
            "ELSE '(''' || " + op + " || ''', ' || " + a1 + " || ', ' || " + a2 + " || ')' END)")


def perturb_sql(leaf: bool) -> str:
    """CTE chain ending in ``k3`` (k, cand, n, statements_repr, solution_bits)."""
    def option(j):
        return f"({j} >= n)", f"(CASE WHEN {j} < n THEN {j} ELSE ({j} - n) + CASE WHEN {j} - n >= p THEN 1 ELSE 0 END END)"

    def each(f):
        return ", ".join(f(w) for w in range(4))
    agrees = each(lambda w: f"~xor({_stmt_word('op', 'lie1', 'who1', 'lie2', 'who2', w)}, {_knight_word('p', w)}) AS c{w}")
    others = each(lambda w: f"bit_and(b.c{w}) AS o{w}")
    (l1, w1), (l2, w2) = option("j1"), option("j2")
    if leaf:
        numbered = """
cn AS (SELECT *, p * 2 * m + i AS cand, i // m AS place, i % m AS j1 FROM (
  SELECT *, unnest(range(CASE WHEN op IN ('leaf', 'not') THEN m ELSE 2 * m END)) AS i FROM sp)),"""
        new = (f"op AS nop, CASE WHEN place = 0 THEN {l1} ELSE lie1 END AS nl1, CASE WHEN place = 0 THEN {w1} ELSE who1 END AS nw1, "
               f"CASE WHEN place = 1 THEN {l1} ELSE lie2 END AS nl2, CASE WHEN place = 1 THEN {w1} ELSE who2 END AS nw2")
    else:
        numbered = f"""
ci AS (SELECT *, unnest(range(2 * m + 4 * m * (m - 1))) AS i FROM sp),
cj AS (SELECT *, p * (2 * m + 4 * m * (m - 1)) + i AS cand, CASE WHEN i < 2 * m THEN 0 ELSE (i - 2 * m) % (m * (m - 1)) END AS pair FROM ci),
cn AS (SELECT *, CASE WHEN i < 2 * m THEN i % m ELSE pair // (m - 1) END AS j1,
              CASE WHEN i < 2 * m THEN i % m ELSE (pair // (m - 1) + 1 + pair % (m - 1)) % m END AS j2,
              {_OPS_SQL}[CASE WHEN i < 2 * m THEN i // m ELSE 2 + (i - 2 * m) // (m * (m - 1)) END + 1] AS iop FROM cj),"""
        new = f"iop AS nop, {l1} AS nl1, {w1} AS nw1, {l2} AS nl2, {w2} AS nw2"
    left = each(lambda w: f"~xor({_stmt_word('nop', 'nl1', 'nw1', 'nl2', 'nw2', w)}, {_knight_word('p', w)}) & o{w} & {_valid_word('n', w)} AS w{w}")
    sol_pos = " ".join(
        f"WHEN w{w} <> 0 THEN {64 * w} + (CASE WHEN w{w} < 0 THEN 63 ELSE CAST(round(log2(w{w})) AS INT) END)" for w in range(4))
    return "WITH " + _GEN_SQL + f""",
g AS (SELECT gen.k, res.n, res.solution_bits AS s0 FROM gen JOIN res USING (k)),
cons AS (SELECT st.k, st.p, {agrees} FROM st JOIN g USING (k)),
oth AS (SELECT a.k, a.p, {others} FROM cons a JOIN cons b ON b.k = a.k AND b.p <> a.p GROUP BY a.k, a.p),
sp AS (SELECT g.k, g.n, g.s0, 2 * g.n - 1 AS m, st.p, st.op, st.lie1, st.who1, st.lie2, st.who2, o0, o1, o2, o3
       FROM g JOIN st ON st.k = g.k JOIN oth ON oth.k = st.k AND oth.p = st.p),{numbered}
nw AS (SELECT *, {new} FROM cn),
nv AS (SELECT *, {left} FROM nw),
nu AS (SELECT *, CASE {sol_pos} END AS sol, {_stmt_repr('op', 'lie1', 'who1', 'lie2', 'who2')} AS orepr,
              {_stmt_repr('nop', 'nl1', 'nw1', 'nl2', 'nw2')} AS nrepr
       FROM nv WHERE bit_count(w0) + bit_count(w1) + bit_count(w2) + bit_count(w3) = 1),
win AS (SELECT k, arg_min({{'cand': cand, 'p': p, 'nrepr': nrepr, 'sol': sol}}, {{'d': {_draw('k', 'cand', SEED)}, 'c': cand}}) AS b
        FROM nu WHERE sol <> s0 AND nrepr <> orepr GROUP BY k),
wrep AS (
  SELECT st.k, '(' || string_agg(CASE WHEN st.p = win.b.p THEN win.b.nrepr
                                      ELSE {_stmt_repr('st.op', 'st.lie1', 'st.who1', 'st.lie2', 'st.who2')} END, ', ' ORDER BY st.p) || ')' AS statements_repr
  FROM st JOIN win USING (k) GROUP BY st.k),
k3 AS (SELECT win.k, win.b.cand AS cand, res.n, wrep.statements_repr, win.b.sol AS solution_bits
       FROM win JOIN wrep USING (k) JOIN res USING (k))
"""


_OUT = "SELECT k, CAST(cand AS INT) AS cand, CAST(n AS INT) AS n, statements_repr, CAST(solution_bits AS INT) AS solution_bits FROM k3"
SQL["K3"] = perturb_sql(leaf=False) + _OUT
SQL["K4"] = perturb_sql(leaf=True) + _OUT
SQL["J5"] = perturb_sql(leaf=False) + """
SELECT g.k, CAST(g.n AS INT) AS n, CAST(g.s0 AS INT) AS solution_bits, CAST(k3.solution_bits AS INT) AS perturbed_bits
FROM g JOIN k3 USING (k)"""
