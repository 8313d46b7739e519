"""Kernel machines at scale: a landmark feature map and a linear model behind it.

An exact kernel machine needs all pairs of rows. The map below compares every row with
a fixed number of landmark rows instead (the Nystroem approximation), after which the
model is linear and trained by passes that only add up gradients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ordered import hashed_values
from tabloom.plans.features import FEATURES

LANDMARKS = 200


def kernel(name: str, x: np.ndarray, y: np.ndarray, gamma: float, degree: int, coef0: float = 0.0) -> np.ndarray:
    if name == "rbf":
        squared = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
        return np.exp(-gamma * np.maximum(squared, 0.0))
    if name == "poly":
        return (gamma * x @ y.T + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * x @ y.T + coef0)
    raise ValueError(f"unknown kernel {name!r}")


@dataclass
class KernelMap:
    name: str
    gamma: float
    degree: int
    landmarks: list[list[float]]
    weights: list[list[float]]

    def apply(self, df: DataFrame) -> DataFrame:
        points, weights = np.array(self.landmarks), np.array(self.weights)
        name, gamma, degree = self.name, self.gamma, self.degree

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(kernel(name, np.stack(x.to_numpy()), points, gamma, degree) @ weights))

        return df.withColumn(FEATURES, array_to_vector(mapped(vector_to_array(FEATURES))))


def gamma_value(df: DataFrame, gamma) -> float:
    """'scale' is 1 / (width * variance over all cells), 'auto' is 1 / width."""
    if gamma not in ("scale", "auto"):
        return float(gamma)
    cells = df.select(F.explode(vector_to_array(FEATURES)).alias("v"), F.size(vector_to_array(FEATURES)).alias("d"))
    got = cells.agg(F.max("d").alias("d"), F.var_pop("v").alias("v")).first()
    width = got["d"] or 1
    return 1.0 / width if gamma == "auto" else 1.0 / (width * (got["v"] or 1.0))


def fit_map(df: DataFrame, name: str, gamma, degree: int, landmarks: int = LANDMARKS) -> KernelMap:
    """Landmarks are distinct feature vectors with the smallest hashes: a uniform sample
    of bounded size, the same for any partitioning."""
    g = gamma_value(df, gamma)
    rows = df.select(vector_to_array(FEATURES).alias("x"))
    points = np.array(hashed_values(rows, "x", landmarks, rows.count()), dtype=float)
    values, vectors = np.linalg.eigh(kernel(name, points, points, g, degree))
    keep = values > 1e-8 * max(values.max(), 1e-300)
    weights = vectors[:, keep] / np.sqrt(values[keep])
    return KernelMap(name, g, degree, points.tolist(), weights.tolist())


def fit_svr(df: DataFrame, label: str, c: float, epsilon: float, max_iter: int = 100, smooth: float = 1e-3) -> np.ndarray:
    """Weights and intercept of a linear epsilon-insensitive regression by quasi-Newton
    steps. An iteration is two passes: the gradient, then the loss at several step sizes
    at once. Tasks add up one vector each."""
    frame = df.select(vector_to_array(FEATURES).alias("x"), F.col(label).cast("double").alias("y")).persist()
    first = frame.agg(F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    d, n = first["d"], first["n"]
    w = np.zeros(d + 1)
    w[d] = first["m"]
    delta = smooth * max(first["s"] or 1.0, 1e-12)

    def total(fn) -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = None
            for b in batches:
                if b.empty:
                    continue
                x = np.column_stack([np.stack(b["x"].to_numpy()), np.ones(len(b))])
                part = fn(x, b["y"].to_numpy(dtype=float))
                acc = part if acc is None else acc + part
            if acc is not None:
                yield pd.DataFrame({"i": np.arange(len(acc)), "v": acc})

        sums = frame.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        return sums.sort_values("i")["v"].to_numpy()

    def loss(r: np.ndarray) -> np.ndarray:
        # |r| - epsilon, rounded off near its kink over a width of delta
        over = np.abs(r) - epsilon
        return np.where(over <= 0, 0.0, np.where(over < delta, over**2 / (2 * delta), over - delta / 2))

    def gradient(w: np.ndarray) -> np.ndarray:
        def fn(x, y):
            r = x @ w - y
            slope = np.sign(r) * np.clip((np.abs(r) - epsilon) / delta, 0.0, 1.0)
            return x.T @ slope

        g = c * total(fn)
        g[:d] += w[:d]
        return g

    steps = 2.0 ** np.arange(4, -20, -2)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    g = gradient(w)
    for _ in range(max_iter):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        scale = (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(c * n, 1.0)
        q *= scale
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        tried = np.vstack([w - t * q for t in steps] + [w])
        scores = c * total(lambda x, y: loss(x @ tried.T - y[:, None]).sum(axis=0)) + 0.5 * (tried[:, :d] ** 2).sum(axis=1)
        best = int(scores.argmin())
        if best == len(steps) or scores[-1] - scores[best] <= 1e-7 * max(abs(scores[-1]), 1.0):
            break
        fresh = tried[best]
        fresh_g = gradient(fresh)
        s, y = fresh - w, fresh_g - g
        if s @ y > 1e-12:
            past = (past + [(s, y)])[-8:]
        w, g = fresh, fresh_g
    frame.unpersist()
    return w
