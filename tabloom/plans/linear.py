"""Linear models from products of all pairs of features: least squares without negative coefficients,
and cross-validation of the whole linear family in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import TrainError
from tabloom.plans.features import FEATURES

MAX_WIDTH = 4000  # features whose products the driver can hold


def raw_products(data: DataFrame, label: str, fold: str | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(shift, products of (1, features, label) per fold): every task adds up its rows as one matrix. Rows
    are shifted by one of them first, so that large offsets cost no digits."""
    number = F.lit(0) if fold is None else F.col(fold).cast("int")
    rows = data.select(vector_to_array(FEATURES).alias("x"), F.col(label).cast("double").alias("y"), number.alias("fold"))
    first = rows.first()
    if first is None:
        return np.zeros(1), {}
    shift = np.array([*first["x"], first["y"]], float)
    width = len(shift)
    if width > MAX_WIDTH:
        raise TrainError(f"{width - 1} features are too many for products of all pairs ({MAX_WIDTH} at most).")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if len(b):
                z = np.column_stack([np.stack(b["x"].to_numpy()), b["y"].to_numpy(dtype=float)]) - shift
                z = np.column_stack([np.ones(len(z)), z])
                for f in np.unique(b["fold"]):
                    own = z[(b["fold"] == f).to_numpy()]
                    held[f] = held.get(f, 0.0) + own.T @ own
        i, j = np.triu_indices(width + 1)
        for f, total in held.items():
            yield pd.DataFrame({"fold": f, "i": i, "j": j, "v": total[i, j]})

    cells = rows.mapInPandas(partial, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for f, own in cells.groupby("fold"):
        total = np.zeros((width + 1, width + 1))
        total[own["i"], own["j"]] = own["v"]
        out[int(f)] = total + np.triu(total, 1).T
    return shift, out


def centred(total: np.ndarray, shift: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred products) of the features and, last, the label."""
    n, sums = total[0, 0], total[0, 1:]
    return int(n), shift + sums / n, total[1:, 1:] - np.outer(sums, sums) / n


def lasso(gram: np.ndarray, with_label: np.ndarray, penalty: float, rounds: int, tolerance: float = 1e-7) -> np.ndarray:
    """The w of least w' G w / 2 - b' w + penalty * |w|, one coefficient after the other."""
    w, left = np.zeros(len(with_label)), with_label.astype(float).copy()
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            pull = left[j] + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / gram[j, j]
            if new != w[j]:
                left -= gram[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most <= tolerance * max(np.abs(w).max(initial=0.0), 1e-300):
            break
    return w


def solved(algorithm: str, p: dict, total: np.ndarray, shift: np.ndarray) -> list[float]:
    """Coefficients and intercept of a linear model from the products of its rows."""
    n, mean, spread = centred(total, shift)
    if not p["fit_intercept"]:
        spread = spread + n * np.outer(mean, mean)
    gram, with_label = spread[:-1, :-1], spread[:-1, -1]
    if algorithm == "Lasso":
        w = lasso(gram / n, with_label / n, p["alpha"], p["max_iter"])
    elif algorithm == "Ridge":
        w = np.linalg.solve(gram + p["alpha"] * np.eye(len(gram)), with_label)
    elif p.get("positive"):
        w = nonnegative(gram, with_label)
    else:
        w = np.linalg.lstsq(gram, with_label, rcond=1e-12)[0]
    return [*map(float, w), float(mean[-1] - mean[:-1] @ w) if p["fit_intercept"] else 0.0]


def explained(weights: list[float], total: np.ndarray, shift: np.ndarray) -> float:
    """r2 of a linear model over the rows behind the products."""
    n, mean, spread = centred(total, shift)
    w = np.array(weights[:-1])
    off = mean[-1] - mean[:-1] @ w - weights[-1]
    errors = spread[-1, -1] - 2 * w @ spread[:-1, -1] + w @ spread[:-1, :-1] @ w + n * off * off
    return 1 - errors / spread[-1, -1]


def nonnegative(gram: np.ndarray, with_label: np.ndarray) -> np.ndarray:
    """The w >= 0 of least w' G w / 2 - b' w, by an active set: the coefficient with the steepest slope
    becomes free, the free ones are solved for, and those that would turn negative on the way are
    fixed at zero again."""
    d = len(with_label)
    w, free = np.zeros(d), np.zeros(d, bool)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    tolerance = 1e-10 * max(float(np.abs(with_label / scale).max(initial=0.0)), 1e-300)
    for _ in range(10 * d + 10):
        slope = np.where(free, -np.inf, (with_label - gram @ w) / scale)
        if not d or slope.max() <= tolerance:
            break
        free[slope.argmax()] = True
        while True:
            z = np.zeros(d)
            z[free] = np.linalg.lstsq(gram[np.ix_(free, free)], with_label[free], rcond=None)[0]
            if not free.any() or z[free].min() > 0:
                w = z
                break
            sink = free & (z <= 0)
            step = np.min(w[sink] / np.maximum(w[sink] - z[sink], 1e-300))
            w = w + step * (z - w)
            free &= ~(sink & (w <= 1e-12 * max(np.abs(w).max(), 1e-300)))
            w[~free] = 0.0
    return w


def fit_nonnegative(data: DataFrame, label: str, fit_intercept: bool = True) -> list[float]:
    """Coefficients, none of them negative, and the intercept."""
    shift, totals = raw_products(data, label)
    return solved("LinearRegression", {"fit_intercept": fit_intercept, "positive": True}, totals[0], shift)
