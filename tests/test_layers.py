"""All layers in one fit against separate fits; features of several fields."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gradewise.operators import analysis as M
from gradewise.operators import layers as N

SCHEMA = "i int, features array<array<double>>, y double"


def _rows(spark, n=240, dims=(3, 5), seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = [rng.normal(size=d) * (10.0 ** rng.integers(-1, 2)) for d in dims]
        y = float(x[0][0] - x[1][1] + rng.normal() > 0.3)
        rows.append((i, [v.tolist() for v in x], y))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def test_one_fit_equals_separate_fits(spark):
    df, rows = _rows(spark)
    models = {r.layer: r for r in N.fit_layers(df, [3, 5], label="y").collect()}
    for layer in (0, 1):
        alone = df.select("y", array_to_vector(F.col("features")[layer]).alias("features"))
        want = LogisticRegression(labelCol="y", regParam=1 / len(rows), standardization=False, tol=1e-14, maxIter=1000).fit(alone)
        assert models[layer].converged
        assert models[layer].weights == pytest.approx(list(want.coefficients), abs=1e-6)
        assert models[layer].intercept == pytest.approx(want.intercept, abs=1e-6)


def test_a_step_is_one_job_for_any_number_of_layers(spark, monkeypatch):
    df, _ = _rows(spark, 60, (2, 2, 2, 2))
    jobs, one = [], N._evaluate
    monkeypatch.setattr(N, "_evaluate", lambda rows, dims, points, penalty: jobs.append(len(points)) or one(rows, dims, points, penalty))
    steps = [r.steps for r in N.fit_layers(df, [2] * 4, label="y").collect()]
    assert len(jobs) == 1 + max(steps) and sum(jobs) == 4 + sum(steps)


def test_predictions_are_those_of_the_models(spark):
    df, rows = _rows(spark, 50)
    models = N.fit_layers(df, [3, 5], label="y")
    by_layer = {r.layer: r for r in models.collect()}
    got = {(r.i, r.layer): r for r in N.layer_predictions(df, models, label="y", keep=("i",)).collect()}
    assert len(got) == 100
    for i, x, y in rows:
        for layer, m in by_layer.items():
            p = 1 / (1 + math.exp(-(np.dot(x[layer], m.weights) + m.intercept)))
            assert got[i, layer].probability == pytest.approx(p, abs=1e-6)
            assert got[i, layer].y == y and got[i, layer].prediction == float(p > 0.5)
    report = M.report(N.layer_predictions(df, models, label="y", keep=("i",)).withColumn("split", F.lit("all")), by=("split", "layer"))
    right = {layer: np.mean([got[i, layer].prediction == y for i, _, y in rows]) for layer in by_layer}
    assert {r.layer: r.value for r in report.filter("metric = 'accuracy'").collect()} == pytest.approx(right)


def test_cases_of_layers(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [(r.weights, r.intercept) for r in N.fit_layers(none, [2], label="y").collect()] == [([0.0, 0.0], 0.0)]
    same = spark.createDataFrame([(i, [[1.0, 0.0]], 1.0) for i in range(4)] + [(9, [[1.0, 0.0]], 0.0)], SCHEMA)
    fitted = N.fit_layers(same, [2], label="y").first()  # constant features: the intercept takes the odds
    assert fitted.converged and fitted.weights == pytest.approx([0, 0], abs=1e-6) and fitted.intercept == pytest.approx(math.log(4), abs=1e-6)
    for bad in ([(0, [[1.0]], 1.0)], [(0, [[1.0, None]], 1.0)], [(0, None, 1.0)], [(0, [[1.0, 2.0]], None)]):
        with pytest.raises(Exception, match="one vector per layer|must not be null"):
            N.fit_layers(spark.createDataFrame(bad, SCHEMA), [2], label="y").collect()


def test_combined_features_by_hand(spark):
    rows = [(0, "Red red fox!", "the dog"), (1, "blue fox", None), (2, "", "cat dog dog")]
    df = M.field_columns(spark.createDataFrame(rows, "i int, a string, b string"), ["a", "b"])
    model = M.combined_features(["a", "b"]).fit(df.filter("i < 2"))  # the last row is not trained on
    vocab = [s.vocabulary for s in model.stages if hasattr(s, "vocabulary")]
    assert [sorted(v) for v in vocab] == [["blue", "fox", "red"], ["dog"]]
    got = {r.i: r.v for r in model.transform(df).select("i", vector_to_array("features").alias("v")).collect()}
    tokens = {0: (["red", "red", "fox"], ["dog"]), 1: (["blue", "fox"], []), 2: ([], ["cat", "dog", "dog"])}
    for i, texts in ((r[0], [t or "" for t in r[1:]]) for r in rows):
        want = []
        for terms, trained, found, text in zip(vocab, zip(*[tokens[k] for k in (0, 1)]), tokens[i], texts):
            bow = [found.count(t) for t in terms]
            weights = [c * math.log(3 / (sum(t in d for d in trained) + 1)) for c, t in zip(bow, terms)]
            length = math.sqrt(sum(w * w for w in weights)) or 1.0
            want += [w / length for w in weights] + bow + [len(text.split()), len(text)]
        assert got[i] == pytest.approx(want)
    one = M.combined_features(["b"], ("wordlength",)).fit(df).transform(df).select("i", vector_to_array("features").alias("v"))
    assert {r.i: r.v for r in one.collect()} == {0: [2.0], 1: [0.0], 2: [3.0]}
    with pytest.raises(ValueError, match="methods are some of"):
        M.combined_features(["a"], ("pictures",))
