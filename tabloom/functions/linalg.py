"""Second moments of many columns, summed in tasks and combined by a shuffle.

Only matrices of (columns x columns) numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import stats
from tabloom.types import col


def means(frame: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    got = stats.one_row(frame, {"n": F.count(F.lit(1)), **{c: F.avg(col(c)) for c in columns}})
    return got["n"], np.array([got[c] if got[c] is not None else 0.0 for c in columns], dtype=float)


def scatter(frame: DataFrame, columns: Sequence[str], centre: np.ndarray, weight: str | None = None) -> np.ndarray:
    """Sum of (x - centre)(x - centre)' over all rows, optionally weighted.

    A task adds up its rows with matrix products and emits one small matrix.
    """
    columns = list(columns)
    d = len(columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float) - centre
            total += x.T @ (x if weight is None else x * batch[weight].to_numpy(dtype=float)[:, None])
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    wanted = columns + ([weight] if weight else [])
    cells = (
        frame.select(*[col(c) for c in wanted])
        .mapInPandas(partial, "i int, j int, v double")
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    out = np.zeros((d, d))
    out[cells["i"], cells["j"]] = cells["v"]
    return out + np.triu(out, 1).T


# sums of squares below this share of their terms are rounding: the column is constant there
FLAT = 1e-13


def correlations(frame: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlation of every two columns over the rows where both are present; NaN
    where a column is constant over those rows.

    Columns are centred first. A task adds up four products of its values and of their mask
    (present or not) and emits one row per pair of columns.
    """
    columns = list(columns)
    d = len(columns)
    got = stats.one_row(
        frame, {(c, k): f(col(c)) for c in columns for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))}
    )
    # a constant column is centred by its very value, so that its spread is exactly zero
    flat = {c: got[(c, "min")] is not None and got[(c, "min")] == got[(c, "max")] for c in columns}
    centre = np.array([got[(c, "min" if flat[c] else "avg")] or 0.0 for c in columns], dtype=float)
    i, j = np.divmod(np.arange(d * d), d) if d else (np.array([], int), np.array([], int))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sx, sxx, sxy = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - centre
            there = ~np.isnan(x)
            x, mask = np.where(there, x, 0.0), there.astype(float)
            n += mask.T @ mask
            sx += x.T @ mask
            sxx += (x * x).T @ mask
            sxy += x.T @ x
        yield pd.DataFrame({"i": i, "j": j, "n": n.ravel(), "sx": sx.ravel(), "sxx": sxx.ravel(), "sxy": sxy.ravel()})

    names = ["n", "sx", "sxx", "sxy"]
    cells = (
        frame.select(*[col(c) for c in columns])
        .mapInPandas(partial, "i int, j int, n double, sx double, sxx double, sxy double")
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in names])
        .toPandas()
    )
    whole = {c: np.zeros((d, d)) for c in names}
    for c in names:
        whole[c][cells["i"], cells["j"]] = cells[c]
    with np.errstate(invalid="ignore", divide="ignore"):
        n, sx, sxx, sxy = (whole[c] for c in names)
        spread = sxx - sx * sx / n
        spread = np.where(spread > FLAT * sxx, spread, np.nan)
        out = (sxy - sx * sx.T / n) / np.sqrt(spread * spread.T)
    at = np.arange(d)
    out[at, at] = np.where(np.isnan(np.diag(spread)), np.nan, 1.0)
    return out


def covariance(frame: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample covariance)."""
    n, centre = means(frame, columns)
    return n, centre, scatter(frame, columns, centre) / max(n - 1, 1)


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns oriented so that their largest entry by magnitude is positive."""
    peak = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[peak, range(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)
