"""Golden values of the reference's batch-algebra unit tests, on small frames."""

import pytest
from pyspark.sql import functions as F

from gradewise.operators import batch as B
from gradewise.operators.index import with_global_index


def _frame(spark, n=6):
    rows = [(i, i + 1, "abcdef"[i]) for i in range(n)]
    return spark.createDataFrame(rows, "idx long, obs long, labels string")


def _col(df, c, order="idx"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_global_index_is_dense(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    out = with_global_index(df, ["k"], num_partitions=7)
    got = sorted((r.k, r.idx) for r in out.collect())
    assert got == [(k, k) for k in range(1000)]


def test_reorder(spark):
    df = _frame(spark)
    order = spark.createDataFrame([(i, j) for i, j in enumerate([3, 4, 2, 0, 1, 5])], "new_idx long, idx long")
    out = B.reorder(df, order)
    assert _col(out, "obs") == [4, 5, 3, 1, 2, 6]
    assert _col(out, "labels") == list("decabf")


def test_chunk_and_concat(spark):
    df = _frame(spark)
    ch = B.chunk(df, 2)
    parts = [ch.filter(F.col("chunk_id") == i).drop("chunk_id") for i in range(2)]
    assert _col(parts[0], "obs") == [1, 2, 3] and _col(parts[1], "obs") == [4, 5, 6]
    back = B.concat(parts)
    assert _col(back, "obs") == [1, 2, 3, 4, 5, 6]


def test_chunk_not_divisible_raises(spark):
    with pytest.raises(Exception):
        B.chunk(_frame(spark), 5).collect()


def test_pop(spark):
    df = _frame(spark)
    popped, rest = B.pop(df, ["obs"])
    assert set(popped.columns) == {"idx", "obs"} and "obs" not in rest.columns
    with pytest.raises(KeyError):
        B.pop(df, ["missing"])


def test_repeat_interleave_and_tile(spark):
    df = _frame(spark, 3)
    assert _col(B.repeat(df, 2, True), "labels") == list("aabbcc")
    assert _col(B.repeat(df, 2, False), "labels") == list("abcabc")


@pytest.mark.parametrize("divisor,pad,last", [(2, 1, list("abca")), (3, 0, list("abc")), (7, 4, list("abcabca"))])
def test_pad_and_unpad(spark, divisor, pad, last):
    df = _frame(spark, 3)
    padded, pad_size = B.pad_to_divisor(df, divisor)
    assert padded.select(pad_size.alias("p")).first().p == pad
    assert _col(padded, "labels") == last
    assert _col(B.unpad(padded, pad_size), "labels") == list("abc")


def test_fold_reorder_unfold(spark):
    df = B.repeat(_frame(spark, 3), 2, True)   # a a b b c c
    folded = B.fold(df, 2)
    order = {1: 0, 2: 1, 0: 2}                  # groups (b, c, a)
    mapping = spark.createDataFrame(list(order.items()), "old long, new long")
    moved = folded.join(mapping, folded.idx == mapping.old).drop("idx", "old").withColumnRenamed("new", "idx")
    out = B.unfold(moved, 2)
    assert _col(out, "labels") == list("bbccaa")


def test_union_conflict_raises(spark):
    a = _frame(spark)
    b = a.withColumn("obs", F.col("obs") + 1)
    with pytest.raises(Exception):
        B.union(a, b).collect()
    same = B.union(a, a.select("idx", "obs"))
    assert same.count() == 6


def test_minibatch_seeded_repeatable(spark):
    df = with_global_index(spark.range(64).withColumnRenamed("id", "k"), "k")
    a = [tuple(r) for r in B.minibatch_plan(df, "k", 8, 2, shuffle_seed=1).orderBy("epoch", "batch_id", "pos_in_batch").collect()]
    b = [tuple(r) for r in B.minibatch_plan(df, "k", 8, 2, shuffle_seed=1).orderBy("epoch", "batch_id", "pos_in_batch").collect()]
    assert a == b
    keys = [r[1] for r in a[:64]]
    assert sorted(keys) == list(range(64)) and keys != list(range(64))
