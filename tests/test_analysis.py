"""Classifier metrics against SQL over the written predictions; balancing without switches."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SMALL_SF
from gradewise.operators import analysis as M
from gradewise.operators import balance as L
from gradewise.plans.analysis import _features, labelled_docs


def test_reported_metrics_follow_from_the_predictions(spark, duck, tmp_path):
    f = _features(labelled_docs(spark, SMALL_SF), "tfidf")
    sp = M.stratified_split(f.select("doc_id", "label"), "label", "doc_id")
    sp = f.select("doc_id", "features").join(sp, "doc_id")
    path = str(tmp_path / "predictions")
    M.predictions(sp.filter("split = 'train'"), sp.filter("split = 'test'")).write.parquet(path)
    found = spark.read.parquet(path)
    got = {(r.split, r.cls, r.metric): r.value for r in M.report(found).collect()}
    view = f"read_parquet('{path}/*.parquet')"
    for split in ("train", "test"):
        where = f"FROM {view} WHERE split = '{split}'"
        for cls in (0, 1):
            tp, fp, fn = duck.sql(f"SELECT count(*) FILTER (y = {cls} AND prediction = {cls}), count(*) FILTER (y <> {cls} AND prediction = {cls}), "
                                  f"count(*) FILTER (y = {cls} AND prediction <> {cls}) {where}").fetchall()[0]
            want = {"precision": tp / (tp + fp) if tp + fp else None, "recall": tp / (tp + fn) if tp + fn else None,
                    "f1": 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else None, "support": tp + fn}
            for metric, v in want.items():
                assert got[split, str(cls), metric] == (None if v is None else pytest.approx(v))
        assert got[split, "all", "accuracy"] == pytest.approx(duck.sql(f"SELECT avg((y = prediction)::INT) {where}").fetchall()[0][0])
        pairs = duck.sql(f"SELECT avg(CASE WHEN a.probability > b.probability THEN 1 WHEN a.probability = b.probability THEN 0.5 ELSE 0 END) "
                         f"FROM {view} a JOIN {view} b ON a.split = '{split}' AND b.split = '{split}' AND a.y = 1 AND b.y = 0").fetchall()[0][0]
        assert got[split, "all", "auc"] == (None if pairs is None else pytest.approx(pairs))


def test_whole_vocabularies_have_no_cap(spark, monkeypatch):
    """M2 and M3 count every term without gathering a vocabulary."""
    from gradewise.plans import analysis as plans
    from pyspark.ml.feature import CountVectorizer
    monkeypatch.setattr(CountVectorizer, "fit", lambda *a: pytest.fail("a vocabulary on the driver"))
    texts = [" ".join(f"t{k}" for k in range(i, i + 4)) for i in range(0, 24, 3)] + ["t1 t1 t2", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(plans, "all_docs", lambda *a: docs)
    words = [(t or "").split() for t in texts]
    bow = {r.doc_id: (r.n_terms, r.n_counted) for r in plans.m3_bag_of_words(spark, SMALL_SF).collect()}
    assert bow == {i: (len(set(w)), len(w)) for i, w in enumerate(words)}
    idf = {t: math.log((len(texts) + 1) / (sum(t in w for w in words) + 1)) for w in words for t in w}
    for r in plans.m2_tfidf(spark, SMALL_SF).collect():
        w = words[r.doc_id]
        assert r.n_terms == len(set(w))
        assert r.norm == pytest.approx(math.sqrt(sum((w.count(t) * idf[t]) ** 2 for t in set(w))), abs=1e-6)


def test_budget_parts_do_not_depend_on_the_number_of_items(spark):
    items = spark.range(70_000).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.lit(10).alias("n"))
    parts = L.balance(items, "g", "i", "n", 8, "greedy", budget=100_000).groupBy("part").agg((F.count("*") * 10).alias("n")).collect()
    assert len(parts) == 7 and all(r.n == 100_000 for r in parts)


def test_empty_parts_raise(spark):
    items = spark.createDataFrame([(1, i, 5) for i in range(3)], "g int, i int, n int")
    report = L.partition_report(L.balance(items, "g", "i", "n", 5), items, "g", "i", "n", 5)
    with pytest.raises(Exception, match="non-empty parts"):
        L.validated(report, "g", 5).collect()


def test_snake_positions_are_those_of_a_window(spark):
    items = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), (F.col("id") * 7 % 11).alias("n"))
    rows = L.snake_partition(items, "g", "i", "n", 4).collect()
    for g in range(3):
        order = sorted(((r.n, r.i, r.part) for r in rows if r.g == g), key=lambda r: (-r[0], r[1]))
        assert [p for _, _, p in order] == [k % 4 if k // 4 % 2 == 0 else 3 - k % 4 for k in range(len(order))]
