"""Replacing numeric columns by fewer derived ones: PCA, discriminant analysis, ICA.

Matrices are decomposed on the driver (columns x columns); rows are only ever summed
in tasks and projected by plain column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import PrepareError
from tabloom.functions import stats
from tabloom.functions.linalg import covariance, fix_signs, means, scatter
from tabloom.plans.steps import Projection, Step
from tabloom.types import as_double, col

STEP = "data_reduction"
PCA_VARIANCE = 0.95
ICA_MAX_ITER = 200
ICA_TOL = 0.01


def _frame(df: DataFrame, columns: Sequence[str], op: str, label: str) -> DataFrame:
    if any(stats.null_counts(df, columns).values()):
        raise PrepareError(STEP, op, f"{label} requires no missing values. Apply imputation first (Step 3).")
    return df.select(*[as_double(df, c).alias(c) for c in columns])


def _project(columns: Sequence[str], centre: np.ndarray, weights: np.ndarray, prefix: str) -> Projection:
    names = [f"{prefix}{k + 1}" for k in range(weights.shape[1])]
    return Projection(list(columns), [float(c) for c in centre], weights.tolist(), names)


def pca_components(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, components as columns, explained variances), all components, largest first."""
    _, centre, cov = covariance(df, columns)
    values, vectors = np.linalg.eigh(cov)
    order = values.argsort()[::-1]
    return centre, fix_signs(vectors[:, order]), np.maximum(values[order], 0.0)


def fit_pca(df: DataFrame, columns: Sequence[str]) -> Step:
    columns = list(columns)
    frame = _frame(df, columns, "pca", "PCA")
    most = min(len(columns), frame.count())
    if most < 2:
        raise PrepareError(STEP, "pca", "PCA requires at least 2 columns and 2 rows.")
    centre, vectors, variances = pca_components(frame, columns)
    if most >= 10:
        share = np.cumsum(variances) / variances.sum()
        keep = min(int(np.searchsorted(share, PCA_VARIANCE, side="right")) + 1, most)
    else:
        keep = most - 1
    return Step(STEP, "pca", projection=_project(columns, centre, vectors[:, :keep], "PC"), drop=columns)


def pca_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Explained variance and its share per component."""
    _, _, variances = pca_components(df.select(*[as_double(df, c).alias(c) for c in columns]), columns)
    total = variances.sum() or 1.0
    rows = [(f"PC{i + 1}", float(v), float(v / total)) for i, v in enumerate(variances)]
    return df.sparkSession.createDataFrame(rows, "component string, variance double, ratio double")


def covariance_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _, _, cov = covariance(df.select(*[as_double(df, c).alias(c) for c in columns]), columns)
    rows = [(a, b, float(cov[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, cov double")


def lda_directions(frame: DataFrame, columns: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(overall means, discriminant directions as columns, classes).

    The within-class scatter is the total scatter minus that of the class means, so
    nothing is kept per class beyond one row of means in a distributed table.
    """
    columns = list(columns)
    n, centre = means(frame, columns)
    total = scatter(frame, columns, centre)
    per_class = frame.groupBy(target).agg(
        F.count(F.lit(1)).cast("double").alias("_rows"), *[F.avg(col(c)).alias(c) for c in columns]
    )
    between = scatter(per_class, columns, centre, weight="_rows")
    classes = per_class.count()
    within = total - between
    std = np.sqrt(np.maximum(np.diag(within) / n, 0.0))
    std[std == 0] = 1.0
    scaled = within / np.outer(std, std) / max(n - classes, 1)
    values, vectors = np.linalg.eigh(scaled)
    order = values.argsort()[::-1]
    values, vectors = values[order], vectors[:, order]
    rank = int((np.sqrt(np.maximum(values, 0)) > 1e-4).sum())
    whiten = (vectors[:, :rank] / std[:, None]) / np.sqrt(values[:rank])
    spread = whiten.T @ between @ whiten / max(classes - 1, 1)
    values, vectors = np.linalg.eigh(spread)
    order = values.argsort()[::-1]
    values, vectors = values[order], vectors[:, order]
    roots = np.sqrt(np.maximum(values, 0))
    rank = int((roots > 1e-4 * max(roots.max(initial=0.0), 1e-300)).sum())
    return centre, fix_signs(whiten @ vectors[:, :rank]), classes


def fit_lda(df: DataFrame, columns: Sequence[str], target: str) -> Step:
    features = [c for c in columns if c != target]
    if not features:
        raise PrepareError(STEP, "lda", "No feature columns remaining for LDA.")
    frame = _frame(df, features, "lda", "LDA")
    frame = df.select(*[as_double(df, c).alias(c) for c in features], col(target).cast("string").alias("_class"))
    present = stats.distinct_counts(frame, ["_class"])["_class"]
    if present < 2:
        raise PrepareError(STEP, "lda", f"LDA requires at least 2 classes in target. Found: {present}.")
    # a missing target is a class of its own, named like its text form
    frame = frame.withColumn("_class", F.coalesce("_class", F.lit("nan")))
    centre, directions, _ = lda_directions(frame, features, "_class")
    keep = min(len(features), present - 1)
    return Step(STEP, "lda", projection=_project(features, centre, directions[:, :keep], "LDA"), drop=features)


def ica_directions(
    frame: DataFrame, columns: Sequence[str], k: int, max_iter: int = ICA_MAX_ITER, tol: float = ICA_TOL, seed: int = 42
) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, unmixing directions as columns, iterations): symmetric fixed-point
    iterations with the logcosh contrast. One pass over the rows per iteration."""
    columns = list(columns)
    n, centre, cov = covariance(frame, columns)
    values, vectors = np.linalg.eigh(cov)
    order = values.argsort()[::-1][:k]
    whiten = fix_signs(vectors[:, order]) / np.sqrt(np.maximum(values[order], 1e-12))
    k = len(order)

    def orthogonal(w: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(w @ w.T)
        return (u / np.sqrt(np.maximum(s, 1e-15))) @ u.T @ w

    w = orthogonal(np.random.default_rng(seed).normal(size=(k, k)))
    kept = frame.persist()
    iterations = 0
    for iterations in range(1, max_iter + 1):

        def partial(batches: Iterator[pd.DataFrame], w=w) -> Iterator[pd.DataFrame]:
            gz, gp = np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                z = (batch[columns].to_numpy(dtype=float) - centre) @ whiten
                g = np.tanh(z @ w.T)
                gz += g.T @ z
                gp += (1.0 - g * g).sum(axis=0)
            flat = np.concatenate([gz.ravel(), gp])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        sums = kept.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        flat = sums.sort_values("i")["v"].to_numpy() / n
        fresh = orthogonal(flat[: k * k].reshape(k, k) - flat[k * k :][:, None] * w)
        change = np.abs(np.abs((fresh * w).sum(axis=1)) - 1.0).max()
        w = fresh
        if change < tol:
            break
    kept.unpersist()
    return centre, whiten @ w.T, iterations


def fit_ica(df: DataFrame, columns: Sequence[str], max_iter: int = ICA_MAX_ITER, seed: int = 42) -> Step:
    """Independent components, ordered by kurtosis and oriented by their largest weight."""
    columns = list(columns)
    frame = _frame(df, columns, "ica", "ICA")
    k = max(1, min(len(columns) - 1, frame.count() - 1))
    centre, directions, _ = ica_directions(frame, columns, k, max_iter, seed=seed)
    directions = fix_signs(directions)
    parts = _project(columns, centre, directions, "IC")
    got = stats.one_row(parts.apply(frame, columns), {name: F.kurtosis(name) for name in parts.names})
    order = sorted(range(k), key=lambda i: -(got[f"IC{i + 1}"] or 0.0))
    return Step(STEP, "ica", projection=_project(columns, centre, directions[:, order], "IC"), drop=columns)
