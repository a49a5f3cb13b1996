"""Balanced-partition queries (L1-L8): documents in batches of 128 by id,
``n_chars`` as the token count, 8 parts per batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as L
from ..session import table
from .registry import register

K_PARTS = 8


def batches(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.expr("doc_id div 128").alias("batch"), "doc_id", "n_chars")


_SNAKE_SQL = f"""
WITH r AS (SELECT doc_id // 128 AS batch, doc_id, n_chars,
                  row_number() OVER (PARTITION BY doc_id // 128 ORDER BY n_chars DESC, doc_id) - 1 AS rk FROM documents),
s AS (SELECT batch, doc_id, n_chars,
             CAST(CASE WHEN (rk // {K_PARTS}) % 2 = 0 THEN rk % {K_PARTS} ELSE {K_PARTS} - 1 - rk % {K_PARTS} END AS INT) AS part FROM r)
"""


def _kk_sql(k_expr: str = str(K_PARTS), equal_size: bool = False, budget: int | None = None) -> str:
    """DuckDB twin of the largest-differencing partition (recursive CTE).

    A state is a list of k subsets struct(neg_sum, pos, items) sorted so the
    largest sum comes first (ties keep their position); the heap is a list
    of struct(neg_spread, seq, subs) and each step merges its two smallest
    entries (largest spread, then oldest), pairing subset i with subset k-1-i.
    Output CTE ``kk_out`` (batch, doc_id, part)."""
    k = f"(GREATEST(1, CAST(ceil(tot / {budget}.0) AS BIGINT)))" if budget else k_expr
    start_group = "rn // kk" if equal_size else "rn"
    return f"""
WITH RECURSIVE it AS (
  SELECT doc_id // 128 AS batch, doc_id, n_chars,
         row_number() OVER (PARTITION BY doc_id // 128 ORDER BY n_chars, doc_id) - 1 AS rn,
         sum(n_chars) OVER (PARTITION BY doc_id // 128) AS tot
  FROM documents),
it2 AS (SELECT *, {k} AS kk FROM it),
starts AS (
  SELECT batch, any_value(kk) AS kk, {start_group} AS seq,
         list({{'s': n_chars, 'doc': doc_id, 'r': rn}} ORDER BY rn) AS members
  FROM it2 GROUP BY batch, {start_group}),
st0 AS (
  SELECT batch, kk, seq,
    list_sort(list_transform(range(kk), lambda i: CASE WHEN i < len(members)
        THEN {{'neg_sum': -members[i + 1].s, 'pos': i, 'items': [members[i + 1].doc]}}
        ELSE {{'neg_sum': CAST(0 AS BIGINT), 'pos': i, 'items': CAST([] AS BIGINT[])}} END)) AS subs
  FROM starts),
st1 AS (SELECT batch, kk, {{'neg_spread': subs[1].neg_sum - subs[len(subs)].neg_sum, 'seq': seq, 'subs': subs}} AS state FROM st0),
h0 AS (SELECT batch, any_value(kk) AS kk, list(state) AS heap, count(*) AS nseq FROM st1 GROUP BY batch),
kk_run(batch, kk, heap, nseq) AS (
  SELECT batch, kk, heap, nseq FROM h0
  UNION ALL
  SELECT batch, kk,
    srt[3:] || [{{'neg_spread': merged[1].neg_sum - merged[len(merged)].neg_sum, 'seq': nseq, 'subs': merged}}],
    nseq + 1
  FROM (
    SELECT batch, kk, nseq, srt,
      list_sort(list_transform(range(kk), lambda i: {{
        'neg_sum': srt[1].subs[i + 1].neg_sum + srt[2].subs[kk - i].neg_sum, 'pos': i,
        'items': srt[1].subs[i + 1].items || srt[2].subs[kk - i].items}})) AS merged
    FROM (SELECT batch, kk, nseq, list_sort(heap) AS srt FROM kk_run WHERE len(heap) > 1))),
fin AS (SELECT batch, heap[1].subs AS subs FROM kk_run WHERE len(heap) = 1),
kk_out AS (
  SELECT batch, unnest(subs[p + 1].items) AS doc_id, CAST(p AS INT) AS part
  FROM (SELECT batch, subs, unnest(range(len(subs))) AS p FROM fin))
"""


@register("L8", _SNAKE_SQL + "SELECT batch, doc_id, part FROM s")
def l8_snake(spark, sf):
    return L.snake_partition(batches(spark, sf), "batch", "doc_id", "n_chars", K_PARTS).select("batch", "doc_id", "part")


_REPORT_SQL = f""",
pp AS (SELECT o.batch, o.part, sum(d.n_chars) AS tok, count(*) AS cnt FROM kk_out o JOIN documents d USING (doc_id) GROUP BY 1, 2),
pos AS (SELECT doc_id // 128 AS batch, n_chars, row_number() OVER (PARTITION BY doc_id // 128 ORDER BY doc_id) - 1 AS at_,
               count(*) OVER (PARTITION BY doc_id // 128) AS n FROM documents),
runs AS (SELECT batch, at_ // greatest(n // {K_PARTS}, 1) AS run, sum(n_chars) AS tok FROM pos GROUP BY 1, 2),
bef AS (SELECT batch, min(tok) AS lo, max(tok) AS hi FROM runs GROUP BY 1),
aft AS (SELECT batch, count(*) AS n_parts, min(tok) AS min_tokens, max(tok) AS max_tokens, sum(tok) / {K_PARTS}.0 AS mean_tokens,
               min(cnt) AS min_items, max(cnt) AS max_items, CAST(sum(cnt) AS BIGINT) AS n_assigned FROM pp GROUP BY 1)
"""


@register("L4", _kk_sql() + _REPORT_SQL + """
SELECT batch, n_parts, min_tokens, max_tokens, round(mean_tokens, 6) AS mean_tokens, min_items, max_items,
       lo AS unbalanced_min, hi AS unbalanced_max, hi - lo AS minmax_diff FROM aft JOIN bef USING (batch)""")
def l4_imbalance(spark, sf):
    """Token sums of the batch as it stood and of its balanced parts."""
    b = batches(spark, sf)
    r = L.partition_report(L.balance(b, "batch", "doc_id", "n_chars", K_PARTS, "kk"), b, "batch", "doc_id", "n_chars", K_PARTS)
    return r.select("batch", "n_parts", "min_tokens", "max_tokens", F.round("mean_tokens", 6).alias("mean_tokens"),
                    "min_items", "max_items", "unbalanced_min", "unbalanced_max", "minmax_diff")


@register("L6", _SNAKE_SQL + """
SELECT batch, doc_id, row_number() OVER (PARTITION BY batch ORDER BY part, doc_id) - 1 AS new_pos FROM s""")
def l6_reverse_map(spark, sf):
    b = batches(spark, sf)
    a = L.snake_partition(b, "batch", "doc_id", "n_chars", K_PARTS).select("batch", "doc_id", "part")
    return L.reorder_by_parts(a, "batch", "doc_id").select("batch", "doc_id", "new_pos")


@register("L1", _kk_sql() + "SELECT batch, doc_id, part FROM kk_out")
def l1_karmarkar_karp(spark, sf):
    """Largest-differencing partition per batch."""
    return L.balance(batches(spark, sf), "batch", "doc_id", "n_chars", K_PARTS, "kk")


@register("L1_equal", _kk_sql(equal_size=True) + "SELECT batch, doc_id, part FROM kk_out")
def l1_karmarkar_karp_equal(spark, sf):
    """Equal-size variant (16 items per part)."""
    return L.balance(batches(spark, sf), "batch", "doc_id", "n_chars", K_PARTS, "kk", equal_size=True)


@register("L1_tree", f"""
SELECT lang, count(*) AS n_items, CAST(sum(n_chars) AS BIGINT) AS n_tokens, CAST(least(count(*), {K_PARTS}) AS BIGINT) AS n_parts, true AS balanced
FROM documents GROUP BY lang""")
def l1_merge_tree(spark, sf):
    """All documents of a language as one batch, divided in chunks and merged as a tree: items, tokens and
    parts, and whether the parts differ by no more than the longest document."""
    d = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    a = L.merge_tree_partition(d, "lang", "doc_id", "n_chars", K_PARTS, chunk=64, fan=8)
    j = a.join(d.select("doc_id", "n_chars"), "doc_id")
    per_part = j.groupBy("lang", "part").agg(F.sum("n_chars").alias("t"), F.count(F.lit(1)).alias("c"), F.max("n_chars").alias("longest"))
    n_parts = F.count(F.lit(1))
    spread = F.max("t") - F.when(n_parts < K_PARTS, 0).otherwise(F.min("t"))
    return per_part.groupBy("lang").agg(F.sum("c").alias("n_items"), F.sum("t").alias("n_tokens"), n_parts.alias("n_parts"),
                                        (spread <= F.max("longest")).alias("balanced"))


@register("L2", """
WITH RECURSIVE items AS (
  SELECT doc_id // 128 AS batch, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 128 ORDER BY doc_id) AS rn
  FROM documents),
g(batch, rn, loads, part) AS (
  SELECT batch, CAST(0 AS BIGINT), list_transform(range({K_PARTS}), lambda j: CAST(0 AS BIGINT)), -1
  FROM (SELECT DISTINCT batch FROM items)
  UNION ALL
  SELECT g.batch, g.rn + 1,
         list_transform(range({K_PARTS}), lambda j: g.loads[j + 1] + CASE WHEN j = sel.s THEN it.n_chars ELSE 0 END),
         sel.s
  FROM g JOIN items it ON it.batch = g.batch AND it.rn = g.rn + 1,
       LATERAL (SELECT list_position(g.loads, list_min(g.loads)) - 1 AS s) sel)
SELECT items.batch, items.doc_id, CAST(g.part AS INT) AS part FROM g JOIN items ON items.batch = g.batch AND items.rn = g.rn
""".replace("{K_PARTS}", str(K_PARTS)))
def l2_greedy(spark, sf):
    """Greedy least-loaded partition in input (id) order."""
    return L.balance(batches(spark, sf), "batch", "doc_id", "n_chars", K_PARTS, "greedy")


@register("L3", _kk_sql() + _REPORT_SQL + f""",
items AS (SELECT doc_id // 128 AS batch, count(DISTINCT doc_id) AS n_items FROM documents GROUP BY 1)
SELECT batch, n_parts, n_assigned, n_items, n_parts = {K_PARTS} AND n_assigned = n_items AS valid FROM aft JOIN items USING (batch)""")
def l3_validate(spark, sf):
    """Balanced parts, checked: an empty part or a lost item raises."""
    b = batches(spark, sf)
    a = L.balance(b, "batch", "doc_id", "n_chars", K_PARTS, "kk")
    r = L.validated(L.partition_report(a, b, "batch", "doc_id", "n_chars", K_PARTS), "batch", K_PARTS)
    return r.select("batch", "n_parts", "n_assigned", "n_items", "valid")


@register("L5", _kk_sql(budget=40000) + "SELECT batch, doc_id, part FROM kk_out")
def l5_token_budget(spark, sf):
    """Micro-batches: ceil(tokens / 40000) parts per batch, balanced by largest differencing."""
    return L.balance(batches(spark, sf), "batch", "doc_id", "n_chars", K_PARTS, "kk", budget=40000)


@register("L5_whole", """
SELECT lang, count(*) AS n_items, CAST(sum(n_chars) AS BIGINT) AS n_tokens,
       greatest(CAST(1 AS BIGINT), CAST((sum(n_chars) + 39999) // 40000 AS BIGINT)) AS n_parts, true AS balanced
FROM documents GROUP BY lang""")
def l5_budget_of_whole_tables(spark, sf):
    """All documents of a language as one batch under a budget of 40000 tokens a part: items, tokens,
    parts, and whether the parts differ by three times the longest document at most."""
    d = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    a = L.budget_partition(d, "lang", "doc_id", "n_chars", 40000)
    j = a.join(d.select("doc_id", "n_chars"), "doc_id")
    per_part = j.groupBy("lang", "part").agg(F.sum("n_chars").alias("t"), F.count(F.lit(1)).alias("c"), F.max("n_chars").alias("longest"))
    parts = F.max("part") + 1
    spread = F.max("t") - F.when(F.count(F.lit(1)) < parts, 0).otherwise(F.min("t"))
    return per_part.groupBy("lang").agg(F.sum("c").alias("n_items"), F.sum("t").alias("n_tokens"), parts.alias("n_parts"),
                                        (spread <= 3 * F.max("longest")).alias("balanced"))


@register("L7", _kk_sql(equal_size=True) + """
SELECT batch, doc_id, part, row_number() OVER (PARTITION BY batch ORDER BY part, doc_id) - 1 AS new_pos FROM kk_out""")
def l7_balanced_reorder(spark, sf):
    """Whole-batch reorder so each of the 8 workers gets a similar token count."""
    b = batches(spark, sf)
    a = L.balance(b, "batch", "doc_id", "n_chars", K_PARTS, "kk", equal_size=True)
    return L.reorder_by_parts(a, "batch", "doc_id").select("batch", "doc_id", "part", "new_pos")
