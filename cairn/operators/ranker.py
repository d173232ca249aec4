"""The small ranking network: seeded initialisation, synthetic targets and per-sample gradient descent (17 parameters, so it
is trained on the driver)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def initial(seed: int = 42) -> dict:
    """He scale for the first layer, Xavier scale for the second, no bias."""
    rng = np.random.default_rng(seed)
    return {"w1": rng.standard_normal((3, 4)) * np.sqrt(2 / 3), "b1": np.zeros(4), "w2": rng.standard_normal((4, 1)) * np.sqrt(2 / 5), "b2": np.zeros(1)}


def forward(weights: dict, x: np.ndarray) -> np.ndarray:
    """Predictions for rows of three features; 0 for another number of features."""
    x = np.atleast_2d(x)
    if x.shape[1] != 3:
        return np.zeros(len(x))
    h = np.maximum(0, x @ np.asarray(weights["w1"]) + weights["b1"])
    return 1 / (1 + np.exp(-(h @ np.asarray(weights["w2"]) + weights["b2"])))[:, 0]


def train(inputs: np.ndarray, targets: np.ndarray, epochs: int = 100, rate: float = 0.1, seed: int = 42, start: dict | None = None) -> tuple[dict, list[float]]:
    """Weights and the mean squared error of each epoch. One step per sample, its gradient divided by their number. Begins
    with the weights ``start`` or, without them, with seeded ones."""
    w = start or initial(seed)
    w1, b1, w2, b2 = (np.array(w[n], dtype=float) for n in ("w1", "b1", "w2", "b2"))
    w2 = w2[:, 0].copy()
    n, losses = max(1, len(inputs)), []
    for _ in range(epochs):
        loss = 0.0
        for x, t in zip(inputs, targets):
            z = x @ w1 + b1
            h = np.maximum(0, z)
            y = 1 / (1 + np.exp(-(h @ w2 + b2[0])))
            loss += (y - t) ** 2
            g = 2 * (y - t) / n * y * (1 - y)
            back = g * w2 * (z > 0)
            w2 -= rate * g * h
            b2 -= rate * g
            w1 -= rate * np.outer(x, back)
            b1 -= rate * back
        losses.append(loss / n)
    return {"w1": w1, "b1": b1, "w2": w2[:, None], "b2": b2}, losses


def training_set(spark: SparkSession, rows: int = 1000) -> DataFrame:
    """(i, bm25, embed, rrf, target): hashed uniform features; target min(1, 0.5 b + 0.3 e + 0.2 r + 0.5 b e)."""
    u = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}:"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    x = spark.range(rows).select(F.col("id").alias("i")).select("i", u("b").alias("bm25"), u("e").alias("embed"), u("r").alias("rrf"))
    b, e, r = F.col("bm25"), F.col("embed"), F.col("rrf")
    return x.withColumn("target", F.least(F.lit(1.0), 0.5 * b + 0.3 * e + 0.2 * r + 0.5 * b * e))


_TRAINED: dict[int, tuple[dict, list[float]]] = {}


def trained(spark: SparkSession, epochs: int = 100) -> tuple[dict, list[float]]:
    """The ranker of the fixed training set; always the same, so it is trained once in a process."""
    if epochs not in _TRAINED:
        rows = training_set(spark).orderBy("i").toPandas()  # a fixed thousand rows
        _TRAINED[epochs] = train(rows[["bm25", "embed", "rrf"]].to_numpy(), rows["target"].to_numpy(), epochs)
    return _TRAINED[epochs]


def weights_table(spark: SparkSession, weights: dict) -> DataFrame:
    """The one-row table a ranker is stored as."""
    row = [(np.asarray(weights["w1"]).tolist(), np.asarray(weights["b1"]).tolist(), np.asarray(weights["w2"]).tolist(), np.asarray(weights["b2"]).tolist())]
    return spark.createDataFrame(row, "w1 array<array<double>>, b1 array<double>, w2 array<array<double>>, b2 array<double>")
