"""Batch-algebra queries (B1-B23, J1, J3) over ``orders`` positioned by o_orderkey."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import seeded_sql
from ..operators import batch as B
from ..operators.index import row_count, with_global_index
from ..session import table
from .registry import register

_IDX_SQL = "(row_number() OVER (ORDER BY o_orderkey) - 1)"


def _orders(spark, sf, *cols):
    """Orders with their position: only the key and the columns asked for are read and indexed."""
    return B.Batch.from_frame(table(spark, sf, "orders").select("o_orderkey", *cols), "o_orderkey").df

@register("B1", f"SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders")
def b1_build(spark, sf):
    return _orders(spark, sf).select("idx", "o_orderkey")


@register("B2", """
SELECT count(*) AS n_rows,
       CAST(sum(CASE WHEN o_custkey IS NULL OR o_totalprice IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_rows,
       CAST(0 AS BIGINT) AS n_bad_length_rows
FROM orders
""")
def b2_check(spark, sf):
    return B.consistency_report(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"])


@register("B3", f"SELECT {_IDX_SQL} AS idx, o_orderkey, o_totalprice FROM orders")
def b3_select(spark, sf):
    return B.select_keys(_orders(spark, sf, "o_totalprice"), ["o_orderkey", "o_totalprice"])


@register("B4", f"SELECT {_IDX_SQL} AS idx, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def b4_pop(spark, sf):
    popped, rest = B.pop(_orders(spark, sf, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
                         ["o_totalprice"])
    return rest


@register("B5", f"SELECT {_IDX_SQL} AS idx, o_orderkey, o_totalprice AS price FROM orders")
def b5_rename(spark, sf):
    return B.rename(_orders(spark, sf, "o_totalprice"), "o_totalprice", "price")


@register("B6", f"SELECT {_IDX_SQL} AS idx, o_orderkey, o_totalprice, o_custkey FROM orders")
def b6_union(spark, sf):
    o = _orders(spark, sf, "o_totalprice", "o_custkey")  # one index for both sides
    left, right = o.drop("o_custkey"), o.drop("o_totalprice")
    return B.union(left, right, "idx", {"temperature": 1.0}, {"temperature": 1.0})


@register("J1", f"SELECT {_IDX_SQL} AS idx, o_orderkey, o_orderstatus, o_orderdate IS NOT NULL AS has_date FROM orders")
def j1_positional_union(spark, sf):
    o = _orders(spark, sf, "o_orderstatus", "o_orderdate")
    left = o.select("idx", "o_orderkey", "o_orderstatus")
    right = o.select("idx", "o_orderkey", F.col("o_orderdate").isNotNull().alias("has_date"))
    return B.union(left, right, "idx")


@register("B7", """
SELECT row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) - 1 AS idx,
       o_orderkey FROM orders
""")
def b7_concat(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).when(
        F.col("o_orderstatus") == "O", 1).otherwise(2).alias("part"))
    ranked = with_global_index(o, ["part", "o_orderkey"], "idx")  # one index; each part starts at 0 again
    parts = []
    for k in range(3):
        part = ranked.filter(F.col("part") == k)
        first = part.select(F.coalesce(F.min("idx"), F.lit(0))).scalar()
        parts.append(part.select((F.col("idx") - first).alias("idx"), "o_orderkey"))
    return B.concat(parts).select("idx", "o_orderkey")


@register("B8", f"""
SELECT idx // (count(*) OVER () // 4) AS chunk_id, o_orderkey FROM (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders)
""")
def b8_chunk(spark, sf):
    return B.chunk(_orders(spark, sf), 4).select("chunk_id", "o_orderkey")


@register("B9", f"""
SELECT idx * 3 + r AS idx, o_orderkey FROM (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders), range(3) t(r)
""")
def b9_repeat_interleave(spark, sf):
    return B.repeat(_orders(spark, sf), 3, interleave=True).select("idx", "o_orderkey")


@register("B9_tile", f"""
SELECT r * count(*) OVER (PARTITION BY r) + idx AS idx, o_orderkey
FROM (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders), range(3) t(r)
""")
def b9_repeat_tile(spark, sf):
    return B.repeat(_orders(spark, sf), 3, interleave=False).select("idx", "o_orderkey")


@register("B10", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS idx, o_orderkey FROM orders")
def b10_reorder(spark, sf):
    o = _orders(spark, sf, "o_totalprice")
    order = with_global_index(o.select("idx", "o_totalprice", "o_orderkey"),
                              [F.col("o_totalprice").desc(), F.col("o_orderkey")], "new_idx")
    return B.reorder(o, order.select("new_idx", "idx")).select("idx", "o_orderkey")


@register("B11", f"""
SELECT idx - n // 3 AS idx, o_orderkey
FROM (SELECT {_IDX_SQL} AS idx, count(*) OVER () AS n, o_orderkey FROM orders)
WHERE idx >= n // 3 AND idx < 2 * n // 3
""")
def b11_slice(spark, sf):
    o = _orders(spark, sf)
    n = row_count(o)
    return B.slice_rows(o, (n / 3).cast("long"), (2 * n / 3).cast("long")).select("idx", "o_orderkey")


_B12_SQL = f"""
WITH o AS (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders),
n AS (SELECT count(*) AS n, (7 - count(*) % 7) % 7 AS pad FROM orders)
SELECT idx, o_orderkey, false AS is_pad FROM o
UNION ALL
SELECT n.n + j AS idx, o.o_orderkey, true AS is_pad FROM n, range(n.pad) t(j) JOIN o ON o.idx = j % n.n
"""


@register("B12", _B12_SQL)
def b12_pad(spark, sf):
    padded, _pad = B.pad_to_divisor(_orders(spark, sf), 7)
    return padded.select("idx", "o_orderkey", "is_pad")


@register("B13", f"SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders")
def b13_unpad(spark, sf):
    o = _orders(spark, sf)
    padded, pad = B.pad_to_divisor(o, 7)
    return B.unpad(padded, pad).select("idx", "o_orderkey")


@register("B14", f"SELECT idx // 3 AS idx, idx % 3 AS sub_idx, o_orderkey FROM (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders)")
def b14_fold(spark, sf):
    return B.fold(_orders(spark, sf), 3).select("idx", "sub_idx", "o_orderkey")


@register("B15", f"""
SELECT ((count(*) OVER () // 3) - 1 - idx // 3) * 3 + idx % 3 AS idx, o_orderkey
FROM (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders)
""")
def b15_fold_reorder_unfold(spark, sf):
    """Fold by 3, reverse the group order, unfold (the reference's fold/reorder/unfold test)."""
    folded = B.fold(_orders(spark, sf), 3)
    groups = row_count(folded) / 3
    reordered = folded.withColumn("idx", (groups - 1 - F.col("idx")).cast("long"))
    return B.unfold(reordered, 3).select("idx", "o_orderkey")


@register("B16", f"""
SELECT idx // 64 AS batch, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY idx) AS o_orderkey
FROM (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders) GROUP BY 1
""")
def b16_collate(spark, sf):
    o = _orders(spark, sf).withColumn("batch", (F.col("idx") / 64).cast("long"))
    c = B.collate(o, "batch", ["o_orderkey"])
    return c.select("batch", F.size("o_orderkey").cast("long").alias("n"),
                    F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), ",").alias("o_orderkey"))


# mini-batches of 20 rows: 20 divides the orders count at every scale factor
@register("B17", f"""
SELECT e AS epoch, idx // 20 AS batch_id, idx % 20 AS pos_in_batch, o_orderkey
FROM (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders), range(2) t(e)
""")
def b17_minibatches(spark, sf):
    return B.minibatch_plan(_orders(spark, sf), "o_orderkey", 20, 2).select(
        "epoch", "batch_id", "pos_in_batch", "o_orderkey")


@register("B17_shuffled", f"""
WITH x AS (SELECT e AS epoch, o_orderkey, {seeded_sql("e", 7, "o_orderkey")} AS h
           FROM orders, range(2) t(e)),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY h, o_orderkey) - 1 AS rk FROM x)
SELECT epoch, rk // 20 AS batch_id, rk % 20 AS pos_in_batch, o_orderkey FROM r
""")
def b17_minibatches_shuffled(spark, sf):
    return B.minibatch_plan(_orders(spark, sf), "o_orderkey", 20, 2, shuffle_seed=7).select(
        "epoch", "batch_id", "pos_in_batch", "o_orderkey")


@register("B18", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {seeded_sql("o_orderkey", 11)}, o_orderkey) - 1 AS rk,
                  count(*) OVER () AS n FROM orders)
SELECT rk // 64 AS batch_id, o_orderkey FROM r WHERE rk // 64 < n // 64
""")
def b18_sampler(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return B.shuffled_batches(o, "o_orderkey", 64, seed=11).select("batch_id", "o_orderkey")


@register("B19", f"""
SELECT idx % 8 AS rank, idx, o_orderkey
FROM (SELECT {_IDX_SQL} AS idx, count(*) OVER () AS n, o_orderkey FROM orders) WHERE idx < (n // 8) * 8
""")
def b19_shards(spark, sf):
    return B.shard_for_ranks(_orders(spark, sf), 8).select("rank", "idx", "o_orderkey")


@register("B20", "SELECT count(*) AS n FROM orders")
def b20_len(spark, sf):
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))


@register("B21", """
SELECT o_orderstatus, CAST(sum(8 + 8 + coalesce(strlen(o_orderstatus), 0) + 8 + 8 + coalesce(strlen(o_orderpriority), 0)) AS BIGINT) AS n_bytes
FROM orders GROUP BY 1
""")
def b21_bytes(spark, sf):
    return B.byte_size(table(spark, sf, "orders"), ["o_orderstatus"])


@register("B22", f"""
SELECT idx * 2 + r AS idx, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS uid
FROM (SELECT {_IDX_SQL} AS idx, o_orderkey FROM orders), range(2) t(r)
""")
def b22_uid(spark, sf):
    o = _orders(spark, sf).withColumn("uid", B.prompt_uid("o_orderkey"))
    return B.repeat(o, 2).select("idx", "o_orderkey", "uid")


@register("B23", """
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders
""")
def b23_append(spark, sf):
    o = table(spark, sf, "orders")
    return B.append_per_key(o, "o_custkey", "o_orderkey", "o_orderkey")


@register("J3", "SELECT o_orderkey, o_totalprice FROM orders")
def j3_restore_order(spark, sf):
    """Reorder by price, then restore the original positions by joining on the saved index."""
    o = _orders(spark, sf, "o_totalprice")
    moved = with_global_index(o.withColumnRenamed("idx", "orig_idx"), [F.col("o_totalprice").desc(), "o_orderkey"])
    restored = moved.select(F.col("orig_idx").alias("idx"), "o_orderkey", "o_totalprice")
    return restored.join(o.select("idx"), "idx").select("o_orderkey", "o_totalprice")
