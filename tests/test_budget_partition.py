"""Micro-batches under a token budget, for batches that no task could hold."""

import random

import pytest

from gradewise.operators import balance as L


def _divided(spark, lengths, budget, **options):
    df = spark.createDataFrame([("b", i, n) for i, n in enumerate(lengths)], "g string, i int, n long")
    rows = sorted(L.budget_partition(df, "g", "i", "n", budget, **options).collect(), key=lambda r: r.i)
    assert [r.i for r in rows] == list(range(len(lengths)))
    return [r.part for r in rows]


def test_a_batch_of_one_run_is_one_heap(spark):
    rng = random.Random(3)
    lengths = [rng.randint(1, 500) for _ in range(80)]
    k = -(-sum(lengths) // 2000)
    assert _divided(spark, lengths, 2000) == L.largest_differencing(lengths, k)


@pytest.mark.parametrize("chunk,width", [(64, 4), (40, 64), (8, 4)])  # the last: every part alone
def test_runs_of_parts_stay_balanced(spark, chunk, width):
    rng = random.Random(4)
    lengths = [int(rng.paretovariate(1.3) * 10) for _ in range(900)]
    budget = sum(lengths) // 57
    k = -(-sum(lengths) // budget)
    parts = _divided(spark, lengths, budget, chunk=chunk, width=width)
    sums = [0] * k
    for n, p in zip(lengths, parts):
        sums[p] += n
    assert max(sums) - min(sums) <= 3 * max(lengths)
    # no task has more items than its chunk and the rounding of the snake rule
    run = min(width, max(1, k * chunk // 900))
    assert run == 1 or max(sum(p // run == node for p in parts) for node in range(-(-k // run))) <= chunk + run


def test_cases_of_the_budget(spark):
    none = spark.createDataFrame([], "g string, i int, n long")
    assert L.budget_partition(none, "g", "i", "n", 10).collect() == []
    rows = ([(None, i, 5) for i in range(9)] + [("x", 1, None), ("x", 2, 0)] + [("one", 1, 1000)]
            + [("y", i, 1) for i in range(40)])
    df = spark.createDataFrame(rows, "g string, i int, n long")
    got = L.budget_partition(df, "g", "i", "n", 15).collect()
    assert sorted((str(r.g), r.i) for r in got) == sorted((str(g), i) for g, i, _ in rows)
    assert sorted(sum(r.part == p and r.g is None for r in got) for p in range(3)) == [3, 3, 3]
    assert {r.part for r in got if r.g == "x"} == {0}
    assert [0 <= r.part < 67 for r in got if r.g == "one"] == [True]
    assert sorted(sum(r.part == p and r.g == "y" for r in got) for p in range(3)) == [13, 13, 14]
    with pytest.raises(ValueError, match="positive"):
        L.budget_partition(df, "g", "i", "n", 0)
