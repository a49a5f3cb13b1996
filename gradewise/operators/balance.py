"""Token-balanced partitioning.

L1/L2 are the per-batch algorithms (largest differencing and greedy).  Both decide item
by item, so they run as grouped pandas functions, one batch (the trainer's batch) a group.
For batches that are too large for one task the caller chooses largest differencing as a tree
(``merge_tree_partition``), micro-batches under a token budget (``budget_partition``) or the
native snake rule (L8), which needs only positions.  Everything else is aggregates on the
assignment table and positions from the global index.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .index import with_global_index


# --- per-batch algorithms (small helpers on one batch's lengths) -----------------

def largest_differencing(lengths: list[int], k: int, equal_size: bool = False, uneven: bool = False) -> list[int]:
    """L1: k-way Karmarkar-Karp.  Returns the part of every item.

    Each state is k subsets kept in descending sum order; the two states with
    the largest spread are merged by pairing the largest subset of one with
    the smallest of the other.  With ``equal_size`` the starting states are
    runs of k consecutive items in length order, so every part gets n/k items.
    Other numbers of items raise, or with ``uneven`` the last run is short and
    parts differ by one item at most.
    """
    n = len(lengths)
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    if equal_size:
        if n % k and not uneven:
            raise ValueError(f"{n} items cannot be split into {k} equal parts")
        starts = [order[o:o + k] for o in range(0, n, k)]
    else:
        starts = [[i] for i in order]
    states = []
    for items in starts:
        subsets = [([i], lengths[i]) for i in items] + [([], 0)] * (k - len(items))
        states.append(sorted(subsets, key=lambda s: -s[1]))
    parts = [0] * n
    for p, (items, _) in enumerate(_merged(states, k)):
        for i in items:
            parts[i] = p
    return parts


def _merged(states: list[list[tuple[list, int]]], k: int) -> list[tuple[list, int]]:
    """One state from states of k (members, sum) in descending order: the two with the largest
    spread (then the oldest) merge first.  The spread of two merged is at most the larger one."""
    heap = [(subsets[-1][1] - subsets[0][1], seq, subsets) for seq, subsets in enumerate(states)]
    heapq.heapify(heap)
    seq = len(states)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = [(a[i][0] + b[k - 1 - i][0], a[i][1] + b[k - 1 - i][1]) for i in range(k)]
        merged.sort(key=lambda s: -s[1])
        heapq.heappush(heap, (merged[-1][1] - merged[0][1], seq, merged))
        seq += 1
    return heap[0][2] if heap else []


def greedy(lengths: list[int], k: int, equal_size: bool = False, uneven: bool = False) -> list[int]:
    """L2: items in input order to the least-loaded part (Q16: no sorting);
    ``equal_size`` adds a bias larger than the total so counts stay equal (with
    ``uneven`` they may differ by one)."""
    bias = (sum(lengths) + 1) if equal_size else 0
    loads = [0] * k
    parts = []
    for x in lengths:
        j = min(range(k), key=lambda p: (loads[p], p))
        parts.append(j)
        loads[j] += x + bias
    if equal_size and not uneven and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items cannot be split into {k} equal parts")
    return parts


# --- DataFrame operators -----------------------------------------------------------------

def _snake(rank, k):
    r = F.col(rank)
    return F.when(F.pmod(F.floor(r / k), F.lit(2)) == 0, F.pmod(r, F.lit(k))).otherwise(k - 1 - F.pmod(r, F.lit(k)))


def position_in_group(df: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """0-based position of each row inside its group, from the global index: a group of any
    size is spread over range partitions instead of being sorted by one task."""
    ranked = with_global_index(df, [F.col(group), *order], "_pos")
    first = ranked.groupBy(F.col(group).alias("_grp")).agg(F.min("_pos").alias("_first"))
    return (ranked.join(first, F.col(group).eqNullSafe(F.col("_grp")))
            .withColumn(name, (F.col("_pos") - F.col("_first")).cast("long")).drop("_pos", "_first", "_grp"))


def snake_partition(df: DataFrame, group: str, item: str, length: str, k: int) -> DataFrame:
    """Rank items by length (descending, then id) inside each batch and deal
    them to parts in snake order 0..k-1, k-1..0, ...  Native; equal counts."""
    ranked = position_in_group(df, group, [F.col(length).desc(), F.col(item)], "_rank")
    return ranked.withColumn("part", _snake("_rank", k).cast("int")).drop("_rank")


def balance(df: DataFrame, group: str, item: str, length: str, k: int, method: str = "kk",
            equal_size: bool = False, budget: int | None = None) -> DataFrame:
    """Part per item, computed per batch.

    With ``budget`` (L5) the part count of a batch is ceil(total / budget), so
    a part may still exceed the budget (as in the reference).  With
    ``equal_size`` the parts of a batch differ by one item at most: a table's
    last batch need not be a multiple of ``k``.
    """
    algo = {"kk": largest_differencing, "greedy": greedy}[method]
    gtype = dict(df.dtypes)[group]
    itype = dict(df.dtypes)[item]
    schema = f"{group} {gtype}, {item} {itype}, part int"

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, kind="stable").reset_index(drop=True)
        lens = [int(x) for x in pdf[length].to_numpy()]
        kk = k if budget is None else max(1, -(-sum(lens) // budget))
        parts = algo(lens, kk, equal_size, uneven=True)
        return pd.DataFrame({group: pdf[group], item: pdf[item], "part": np.asarray(parts, dtype=np.int32)})

    return df.select(group, item, length).groupBy(group).applyInPandas(per_batch, schema)


def merge_tree_partition(df: DataFrame, group: str, item: str, length: str, k: int, equal_size: bool = False,
                         chunk: int = 4096, fan: int = 64) -> DataFrame:
    """L1 for batches of any size: (group, item, part), by largest differencing as a tree.

    The items of a batch are dealt by their rank of length into chunks of about ``chunk`` items, each
    divided as in ``balance``; then ``fan`` divisions at a time, of which only the k sums count, merge
    by the same rule until one is left.  What became of every part is kept as a table for each
    level, and the items are joined with these once.  A task has one chunk or ``fan`` * k sums.

    Merging never raises the spread, so the largest and the smallest part differ by at most the longest
    item, as for one heap over all items; a batch of one chunk has the parts of ``balance``.  Items
    must be unique in their batch; null lengths count 0; a null batch is a batch; with ``equal_size`` the
    number of items must be a multiple of k.  The table of parts is bounded by items * k / chunk."""
    if chunk < k or fan < 2:
        raise ValueError("a chunk needs k items or more, and two or more divisions must merge")
    kinds = dict(df.dtypes)
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("n"))
    ranked = position_in_group(rows, "g", ["n", "item"], "rank")
    sizes = ranked.groupBy(F.col("g").alias("g_")).agg(F.count(F.lit(1)).alias("size"))
    nodes = F.ceil(F.col("size") / F.lit(chunk // k * k if equal_size else chunk))
    run = F.floor(F.col("rank") / k) if equal_size else F.col("rank")
    dealt = (ranked.join(sizes, F.col("g").eqNullSafe(F.col("g_")))
             .select("g", "item", "n", F.pmod(run, nodes).cast("long").alias("node"), nodes.cast("long").alias("nodes")))
    key = f"g {kinds[group]}, node long"

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        parts = largest_differencing([int(x) for x in pdf["n"]], k, equal_size)
        return pdf[["g", "node", "nodes", "item", "n"]].assign(part=np.asarray(parts, np.int32))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "total", "part"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
        states = []
        for _, rows in pdf.groupby("node", sort=True):
            state = [([at], int(t)) for at, t in zip(rows.index, rows["total"])]
            states.append(state + [([], 0)] * (k - len(state)))
        into = np.zeros(len(pdf), np.int32)
        for p, (members, _) in enumerate(_merged(states, k)):
            into[members] = p
        return pdf[["g", "node", "part", "total", "parent"]].assign(new_part=into)

    items = _kept(dealt.groupBy("g", "node").applyInPandas(divide, f"{key}, nodes long, item {kinds[item]}, n long, part int"))
    sums = items.groupBy("g", "node", "part").agg(F.sum("n").alias("total"))
    left = items.agg(F.max("nodes")).first()[0] or 1
    levels = []
    while left > 1:
        sums = sums.withColumn("parent", F.floor(F.col("node") / fan))
        levels.append(_kept(sums.groupBy("g", "parent").applyInPandas(merge, f"{key}, part int, total long, parent long, new_part int")))
        sums = levels[-1].groupBy("g", F.col("parent").alias("node"), F.col("new_part").alias("part")).agg(F.sum("total").alias("total"))
        left = -(-left // fan)
    place = None
    for level in reversed(levels):  # where each part of a level ends up
        if place is None:
            place = level.select("g", "node", "part", F.col("new_part").alias("final"))
        else:
            above = place.select(F.col("g").alias("g_"), F.col("node").alias("node_"), F.col("part").alias("part_"), "final")
            place = level.join(above, F.col("g").eqNullSafe(F.col("g_")) & (F.col("parent") == F.col("node_"))
                               & (F.col("new_part") == F.col("part_"))).select("g", "node", "part", "final")
    if place is None:
        found = items.withColumn("final", F.col("part"))
    else:
        place = place.select(F.col("g").alias("g_"), F.col("node").alias("node_"), F.col("part").alias("part_"), "final")
        found = items.join(place, F.col("g").eqNullSafe(F.col("g_")) & (F.col("node") == F.col("node_")) & (F.col("part") == F.col("part_")))
    return found.select(F.col("g").alias(group), F.col("item").alias(item), F.col("final").alias("part"))


def budget_partition(df: DataFrame, group: str, item: str, length: str, budget: int,
                     chunk: int = 4096, width: int = 64) -> DataFrame:
    """L5 for batches of any size: (group, item, part) with ceil(total / budget) parts a batch.

    The number of parts grows with the batch, so their sums cannot be a state.  The items are dealt
    to all parts by the snake rule over their lengths, which needs positions only; then up to
    ``width`` neighbouring parts with about ``chunk`` items in all are divided anew by largest
    differencing, one such run of parts a task.  Parts that have more than half of ``chunk`` items
    each stay as the snake rule dealt them.

    The snake rule's parts differ by at most the longest item, and so do those of a run; the largest
    and the smallest part of a batch differ by three times the longest item at most.  A batch of one
    run has the parts of ``balance``.  As there, a part may exceed the budget, and there may be more
    parts than items.  Items must be unique in their batch; null lengths count 0; a null batch is a
    batch; one without tokens has one part."""
    if budget < 1 or chunk < 1 or width < 1:
        raise ValueError("a budget, a chunk and a width are positive")
    kinds = dict(df.dtypes)
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("n"))
    ranked = position_in_group(rows, "g", [F.col("n").desc(), "item"], "rank")
    whole = (ranked.groupBy(F.col("g").alias("g_")).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
             .withColumn("k", F.greatest(F.lit(1), F.expr(f"(total + {budget - 1}) div {budget}")))
             .withColumn("run", F.least(F.lit(width), F.greatest(F.lit(1), F.floor(F.col("k") / F.col("size") * chunk)))))
    dealt = (ranked.join(whole, F.col("g").eqNullSafe(F.col("g_"))).withColumn("slot", _snake("rank", F.col("k")))
             .withColumn("node", F.expr("slot div run")))
    dealt = _kept(dealt.select("g", "item", "n", "slot", "node", "run", F.least("run", F.expr("k - node * run")).alias("parts")))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        parts = largest_differencing([int(x) for x in pdf["n"]], int(pdf["parts"].iloc[0]))
        return pdf[["g", "item"]].assign(part=(pdf["node"] * pdf["run"] + np.asarray(parts, np.int64)).astype(np.int64))

    runs = dealt.filter("run > 1").groupBy("g", "node").applyInPandas(divide, f"g {kinds[group]}, item {kinds[item]}, part long")
    single = dealt.filter("run = 1").select("g", "item", F.col("slot").cast("long").alias("part"))
    return runs.unionByName(single).select(F.col("g").alias(group), F.col("item").alias(item), "part")


def _kept(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder: later levels read it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partition_report(assign: DataFrame, lengths: DataFrame, group: str, item: str, length: str, k: int) -> DataFrame:
    """L3 + L4: per batch the parts used, items assigned, and token sums before and after.

    ``min_tokens`` / ``max_tokens`` are over the parts; ``unbalanced_min`` / ``unbalanced_max``
    over runs of floor(n / k) items in item order, as the batch stood before, and
    ``minmax_diff`` is their distance; ``mean_tokens`` is the batch's tokens by k.
    """
    j = assign.join(lengths.select(group, item, length), [group, item])
    per_part = j.groupBy(group, "part").agg(F.sum(length).alias("_tok"), F.count(F.lit(1)).alias("_cnt"))
    after = per_part.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_parts"), F.min("_tok").alias("min_tokens"), F.max("_tok").alias("max_tokens"),
        (F.sum("_tok") / k).alias("mean_tokens"), F.min("_cnt").alias("min_items"), F.max("_cnt").alias("max_items"))
    cover = j.groupBy(group).agg(F.count(F.lit(1)).alias("n_assigned"), F.countDistinct(item).alias("n_items"))
    placed = position_in_group(lengths.select(group, item, length), group, [F.col(item)], "_at")
    run = F.floor(F.col("_at") / F.greatest(F.floor(F.col("n_items") / k), F.lit(1)))
    runs = placed.join(cover.select(group, "n_items"), group).groupBy(group, run.alias("_run")).agg(F.sum(length).alias("_tok"))
    before = runs.groupBy(group).agg(F.min("_tok").alias("unbalanced_min"), F.max("_tok").alias("unbalanced_max"))
    return (after.join(cover, group).join(before, group)
            .withColumn("minmax_diff", F.col("unbalanced_max") - F.col("unbalanced_min")))


def validated(report: DataFrame, group: str, k: int) -> DataFrame:
    """L3: the report with ``valid``; a batch with an empty part or an item that is not
    assigned exactly once raises."""
    fault = F.concat(F.lit("batch "), F.col(group).cast("string"), F.lit(f": not {k} non-empty parts with every item once"))
    ok = (F.col("n_parts") == k) & (F.col("n_assigned") == F.col("n_items"))
    return report.withColumn("valid", F.when(ok, True).otherwise(F.raise_error(fault).cast("boolean")))


def reorder_by_parts(assign: DataFrame, group: str, item: str) -> DataFrame:
    """New position of each item when parts are laid out one after the
    other (items in id order inside a part); the inverse map restores order."""
    return position_in_group(assign, group, ["part", item], "new_pos")
