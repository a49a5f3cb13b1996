"""Logistic regressions of all layers of a model in one fit.

A row holds a vector per layer.  The regressions are independent, but they share the rows, so
every step evaluates the loss and the gradient of all layers that are still moving in one pass:
numpy inside tasks, then a sum by (layer, coefficient).  The driver keeps the coefficients and
the last ``MEMORY`` steps of each layer (limited-memory BFGS with backtracking); what it gets is
as large as the models, whatever the number of rows.

The objective of a layer is the sum of log-losses + ``penalty`` / 2 * |weights|^2, the intercept
left free; with a penalty the optimum is unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps remembered per layer.
MEMORY = 10


def _matrix(batch: pa.RecordBatch, dims: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of the rows side by side, and the labels."""
    layers = batch.column(0)
    flat = layers.flatten()
    if layers.null_count or flat.null_count or flat.flatten().null_count or batch.column(1).null_count:
        raise ValueError("features and labels must not be null")
    if flat.value_lengths().to_pylist() != dims * len(layers):
        raise ValueError(f"every row needs one vector per layer, of lengths {dims}")
    return flat.flatten().to_numpy().reshape(len(layers), sum(dims)), batch.column(1).to_numpy()


def _evaluate(rows: DataFrame, dims: list[int], points: dict[int, np.ndarray], penalty: float) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient of each layer in ``points`` at its coefficients (intercept last): one job."""
    starts = np.cumsum([0, *dims])

    def partial(batches):
        sums = {layer: np.zeros(w.size + 1) for layer, w in points.items()}
        for batch in batches:
            if not len(batch):
                continue
            x, y = _matrix(batch, dims)
            for layer, w in points.items():
                part = x[:, starts[layer]:starts[layer + 1]]
                z = part @ w[:-1] + w[-1]
                error = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
                sums[layer][:-2] += error @ part
                sums[layer][-2] += error.sum()
                sums[layer][-1] += (np.logaddexp(0, z) - y * z).sum()
        for layer, s in sums.items():
            yield pa.RecordBatch.from_pydict({"layer": np.full(s.size, layer, np.int32), "place": np.arange(s.size, dtype=np.int32), "value": s})

    found = rows.mapInArrow(partial, "layer int, place int, value double").groupBy("layer", "place").agg(F.sum("value").alias("value"))
    totals = {layer: np.zeros(w.size + 1) for layer, w in points.items()}
    for layer, place, value in found.collect():  # as many rows as coefficients
        totals[layer][place] = value
    out = {}
    for layer, w in points.items():
        shrink = np.append(penalty * w[:-1], 0.0)
        out[layer] = (totals[layer][-1] + shrink[:-1] @ w[:-1] / 2, totals[layer][:-1] + shrink)
    return out


class _Descent:
    """Coefficients of one layer on their way to the optimum."""

    def __init__(self, loss: float, gradient: np.ndarray):
        self.w, self.loss, self.gradient = np.zeros_like(gradient), loss, gradient
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.aim()

    def aim(self) -> None:
        d, factors = -self.gradient, []
        for s, y in reversed(self.steps):
            a = (s @ d) / (s @ y)
            d = d - a * y
            factors.append(a)
        if self.steps:
            s, y = self.steps[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, float(np.linalg.norm(d)))
        for (s, y), a in zip(self.steps, reversed(factors)):
            d = d + (a - (y @ d) / (s @ y)) * s
        self.direction, self.length = d, 1.0

    def trial(self) -> np.ndarray:
        return self.w + self.length * self.direction

    def take(self, loss: float, gradient: np.ndarray) -> None:
        """Go to the trial point if it is lower enough, else try a shorter step next."""
        slope = float(self.gradient @ self.direction)
        lower = loss <= self.loss + 1e-4 * self.length * slope
        # near the optimum losses differ by less than their rounding: the gradient decides
        level = abs(loss - self.loss) <= 1e-12 * abs(self.loss) and np.abs(gradient).max() < np.abs(self.gradient).max()
        if not (lower or level):
            self.length /= 2
            return
        s, y = self.trial() - self.w, gradient - self.gradient
        if s @ y > 1e-14 * (y @ y):
            self.steps = [*self.steps, (s, y)][-MEMORY:]
        self.w, self.loss, self.gradient = self.trial(), loss, gradient
        self.aim()


def fit_layers(train: DataFrame, dims: list[int], features: str = "features", label: str = "label",
               penalty: float = 1.0, tolerance: float = 1e-8, max_steps: int = 500) -> DataFrame:
    """(layer int, weights array<double>, intercept double, steps int, converged boolean), one row per layer.

    ``features`` is array<array<double>> with vectors of lengths ``dims``; ``label`` is 0 or 1.  A
    layer has converged when no part of its gradient exceeds ``tolerance`` * sqrt(rows).  Each step
    is one job over ``train``, which is read again each time: hand in a written table.  Null vectors or
    labels, and vectors of other lengths, raise; no rows at all give zero coefficients.
    """
    rows = train.select(features, F.col(label).cast("double").alias(label))
    limit = tolerance * max(1.0, float(rows.count())) ** 0.5
    first = _evaluate(rows, dims, {k: np.zeros(d + 1) for k, d in enumerate(dims)}, penalty)
    layers = {k: _Descent(*v) for k, v in first.items()}
    taken = dict.fromkeys(layers, 0)
    for _ in range(max_steps):
        moving = {k: v for k, v in layers.items() if np.abs(v.gradient).max() > limit and v.length > 1e-12}
        if not moving:
            break
        for k, found in _evaluate(rows, dims, {k: v.trial() for k, v in moving.items()}, penalty).items():
            layers[k].take(*found)
            taken[k] += 1
    models = [(k, [float(x) for x in v.w[:-1]], float(v.w[-1]), taken[k], bool(np.abs(v.gradient).max() <= limit))
              for k, v in layers.items()]
    return train.sparkSession.createDataFrame(models, "layer int, weights array<double>, intercept double, steps int, converged boolean")


def layer_predictions(df: DataFrame, models: DataFrame, features: str = "features", label: str = "label",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, layer, y, prediction, probability to 6 places) of every row and layer."""
    long = df.select(*keep, F.col(label).cast("double").alias("y"), F.posexplode(features).alias("layer", "_vector"))
    products = F.zip_with("_vector", "weights", lambda x, w: x * w)
    score = F.aggregate(products, F.lit(0.0), lambda total, x: total + x) + F.col("intercept")
    scored = long.join(models.select("layer", "weights", "intercept"), "layer").withColumn("_p", 1 / (1 + F.exp(-score)))
    return scored.select(*keep, "layer", "y", (F.col("_p") > 0.5).cast("double").alias("prediction"),
                         F.round("_p", 6).alias("probability"))
