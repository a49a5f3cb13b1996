"""Largest differencing as a tree of bounded tasks."""

import random

import pytest

from gradewise.operators import balance as L


def _parts(spark, lengths, k, **options):
    df = spark.createDataFrame([("b", i, n) for i, n in enumerate(lengths)], "g string, i int, n long")
    rows = L.merge_tree_partition(df, "g", "i", "n", k, **options).collect()
    assert sorted(r.i for r in rows) == list(range(len(lengths)))
    return [r.part for r in sorted(rows, key=lambda r: r.i)]


def _sums(lengths, parts, k):
    sums = [0] * k
    for n, p in zip(lengths, parts):
        sums[p] += n
    return sums


def test_one_chunk_is_one_heap(spark):
    rng = random.Random(1)
    lengths = [rng.randint(1, 500) for _ in range(60)]
    assert _parts(spark, lengths, 4) == L.largest_differencing(lengths, 4)
    assert _parts(spark, lengths, 4, equal_size=True) == L.largest_differencing(lengths, 4, True)


@pytest.mark.parametrize("equal", [False, True])
def test_a_tree_stays_within_the_longest_item(spark, equal):
    rng = random.Random(2)
    lengths = [int(rng.paretovariate(1.1) * 10) for _ in range(600)]
    parts = _parts(spark, lengths, 4, equal_size=equal, chunk=16, fan=3)  # 38 chunks, four levels
    sums = _sums(lengths, parts, 4)
    assert max(sums) - min(sums) <= max(lengths)
    if equal:
        assert [parts.count(p) for p in range(4)] == [150] * 4
    whole = _sums(lengths, L.largest_differencing(lengths, 4, equal), 4)
    assert max(whole) - min(whole) <= max(lengths)


def test_cases_of_the_tree(spark):
    none = spark.createDataFrame([], "g string, i int, n long")
    assert L.merge_tree_partition(none, "g", "i", "n", 3).collect() == []
    rows = [(None, i, 5) for i in range(9)] + [("x", 1, None), ("x", 2, 7)] + [("y", i, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, n long")
    got = L.merge_tree_partition(df, "g", "i", "n", 3, chunk=4, fan=2).collect()
    assert sorted((str(r.g), r.i) for r in got) == sorted((str(g), i) for g, i, _ in rows)
    assert sorted(sum(r.part == p and r.g is None for r in got) for p in range(3)) == [3, 3, 3]
    assert sorted(sum(r.part == p and r.g == "y" for r in got) for p in range(3)) == [13, 13, 14]
    with pytest.raises(Exception, match="equal parts"):
        L.merge_tree_partition(df.filter("g = 'y'"), "g", "i", "n", 3, equal_size=True).collect()
    with pytest.raises(ValueError, match="a chunk needs"):
        L.merge_tree_partition(df, "g", "i", "n", 8, chunk=4)
