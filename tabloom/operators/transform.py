"""Monotone transforms of numeric columns and quantile binning."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import PrepareError
from tabloom.functions import stats
from tabloom.plans.steps import Step, number, sql_double
from tabloom.types import as_double, col, dtype_of, is_numeric, nan_to_null

STEP = "transformations"
OPS = ["log", "sqrt", "reciprocal", "yeojohnson", "boxcox"]
BINS = 5
EDGE_DIGITS = 10
BOXCOX_FLOOR = 1e-6
LAMBDA_RANGE = (-5.0, 5.0)
# powers beyond this overflow a DOUBLE for all but numbers next to one
WIDEST = 640.0
LAMBDAS_PER_PASS = 24
PASSES = 4
# logarithms are cut into bins of this width; the sums of so many powers per bin give all candidates
BIN_WIDTH = 1 / 64
POWERS = 12
# candidates up to here are exact to rounding from these sums
BINNED_RANGE = 8.0
LARGEST_LOG = 709.0  # of a variance that a DOUBLE holds


def yeojohnson_sql(x: str, lam: float) -> str:
    if abs(lam) < 1e-12:
        pos = f"log1p({x})"
    else:
        pos = f"(pow({x} + 1D, {number(lam)}) - 1D) / {number(lam)}"
    if abs(lam - 2.0) < 1e-12:
        neg = f"-log1p(-{x})"
    else:
        neg = f"-(pow(1D - {x}, {number(2.0 - lam)}) - 1D) / {number(2.0 - lam)}"
    return f"CASE WHEN {x} >= 0D THEN {pos} WHEN {x} < 0D THEN {neg} END"


def boxcox_sql(x: str, lam: float) -> str:
    if abs(lam) < 1e-12:
        return f"ln({x})"
    return f"(pow({x}, {number(lam)}) - 1D) / {number(lam)}"


class PowerSums:
    """The likelihood of all powers from one scan. A transformed value is a function of t, the logarithm of
    x (of 1 + |x| for Yeo-Johnson): exp(l t) up to constants. Per narrow bin of t and sign of x the rows
    and the sums of powers of (t - centre) are kept, which give the mean and variance of exp(l t) for any
    l by its series. There are as many bins as logarithms of a DOUBLE can differ, whatever the rows."""

    def __init__(self, df: DataFrame, x: str, method: str):
        self.signed = method == "yeojohnson"
        t = f"log1p(abs({x}))" if self.signed else f"ln({x})"
        side = f"{x} >= 0D" if self.signed else "true"
        logs = df.selectExpr(f"{t} AS t", f"{side} AS up").where("t IS NOT NULL")
        logs = logs.withColumn("bin", F.floor(F.col("t") / F.lit(BIN_WIDTH)))
        u = F.col("t") - (F.col("bin") + F.lit(0.5)) * F.lit(BIN_WIDTH)
        powers, term = [], F.lit(1.0)
        logs = logs.withColumn("u", u)
        for k in range(1, POWERS + 1):
            term = term * F.col("u")
            powers.append(F.sum(term).alias(f"s{k}"))
        # a bounded number of rows: bins that occur
        found = logs.groupBy("up", "bin").agg(F.count(F.lit(1)).alias("n"), *powers).orderBy("up", "bin").collect()
        self.up = np.array([r["up"] for r in found], bool)
        self.centre = (np.array([r["bin"] for r in found], float) + 0.5) * BIN_WIDTH
        self.n = np.array([r["n"] for r in found], float)
        self.sums = np.array([[r[f"s{k}"] for k in range(1, POWERS + 1)] for r in found], float).reshape(len(found), POWERS)
        total = self.n * self.centre + self.sums[:, 0]
        self.jacobian = float(np.where(self.up | ~np.array(self.signed), total, -total).sum())
        self.rows = float(self.n.sum())

    @property
    def finite(self) -> bool:
        return bool(len(self.n)) and bool(np.isfinite(self.sums).all())

    @property
    def wide(self) -> bool:
        """Whether the logarithms differ by enough of a bin's width for its sums to tell them apart."""
        z = self.centre - float((self.n * self.centre).sum() / self.rows)
        z = z - float((self.n * z + self.sums[:, 0]).sum() / self.rows)
        variance = float((self.n * z * z + 2 * z * self.sums[:, 0] + self.sums[:, 1]).sum() / self.rows)
        return variance > (1e-4 * BIN_WIDTH) ** 2

    def score(self, lam: float) -> float | None:
        """The likelihood of a power, None where its variance is zero or too large for a DOUBLE."""
        rate = np.where(self.up, lam, 2.0 - lam) if self.signed else np.full(len(self.n), lam)
        sign = np.where(self.up, 1.0, -1.0) if self.signed else 1.0
        # exp(rate * t) is held as a multiple of exp(top), so that no large power overflows
        middle = 0.0 if self.signed else float((self.n * self.centre).sum() / self.rows)
        z = self.centre - middle
        top = max(0.0, float((rate * z).max()))
        with np.errstate(over="ignore", invalid="ignore"):
            base = np.exp(rate * z - top)
            still = np.abs(rate) < 1e-12
            at = np.where(still, z * np.exp(-top), np.exp(-top) * np.expm1(np.minimum(rate * z, 700.0)) / np.where(still, 1.0, rate))
            at = np.where(rate * z > 700.0, base / np.where(still, 1.0, rate), at)
        first, second = np.zeros(len(self.n)), np.zeros(len(self.n))
        for k in range(POWERS, 0, -1):
            first += rate ** (k - 1) / math.factorial(k) * self.sums[:, k - 1]
            if k > 1:
                second += (2.0**k - 2.0) * rate ** (k - 2) / math.factorial(k) * self.sums[:, k - 1]
        at, first = sign * at, sign * base * first
        mean = float((self.n * at + first).sum() / self.rows)
        off = at - mean
        variance = float((self.n * off * off + 2 * off * first + base * base * second).sum() / self.rows)
        if not variance > 0:
            return None
        log = math.log(variance) + 2 * top + 2 * lam * middle
        if log > LARGEST_LOG:
            return None
        return -self.rows / 2.0 * log + (lam - 1.0) * self.jacobian


def best_lambda(df: DataFrame, x: str, method: str) -> float:
    """Maximum-likelihood lambda. A grid of candidates is scored from sums of one scan; a best one at the
    border widens the grid, another one is closed in on, and a parabola refines the last three. Only
    grids far beyond the usual powers, or of infinite or nearly equal values, take a pass of their own each."""
    form = yeojohnson_sql if method == "yeojohnson" else boxcox_sql
    jacobian = f"sign({x}) * log1p(abs({x}))" if method == "yeojohnson" else f"ln({x})"
    low, high = LAMBDA_RANGE
    best, closings = 1.0, 0
    sums = PowerSums(df, x, method)
    binned = sums.finite and sums.wide
    while closings < PASSES:
        step = (high - low) / (LAMBDAS_PER_PASS - 1)
        grid = [low + k * step for k in range(LAMBDAS_PER_PASS)]
        if binned and max(abs(low), abs(high)) <= BINNED_RANGE:
            found = {k: sums.score(lam) for k, lam in enumerate(grid)}
            scores = {k: v for k, v in found.items() if v is not None}
        else:
            aggs = {("v", k): F.expr(f"ln(nullif(var_pop({form(x, lam)}), 0D))") for k, lam in enumerate(grid)}
            aggs["n"] = F.expr(f"count({x})")
            aggs["j"] = F.expr(f"sum({jacobian})")
            got = stats.one_row(df, aggs)
            scores = {
                k: -got["n"] / 2.0 * got[("v", k)] + (lam - 1.0) * got["j"]
                for k, lam in enumerate(grid)
                if got[("v", k)] is not None and math.isfinite(got[("v", k)])
            }
        if not scores:
            return best
        k = max(scores, key=scores.get)
        best = grid[k]
        if closings == 0 and k in (0, LAMBDAS_PER_PASS - 1) and high < WIDEST:
            low, high = 2 * low, 2 * high
            continue
        closings += 1
        if closings == PASSES and k - 1 in scores and k + 1 in scores:
            a, b, c = scores[k - 1], scores[k], scores[k + 1]
            bend = a - 2 * b + c
            if bend < 0:
                best += step * 0.5 * (a - c) / bend
        low, high = best - step, best + step
    return best


def fit_power(df: DataFrame, attributes: Sequence[str], method: str, lambdas: dict[str, float] | None = None) -> Step:
    """Power transform to normality, then mean 0 and population variance 1."""
    attributes = list(attributes)
    name = "Yeo-Johnson" if method == "yeojohnson" else "Box-Cox"
    missing = stats.null_counts(df, attributes)
    for a in attributes:
        if missing[a]:
            raise PrepareError(STEP, method, f"{name} requires no missing values in '{a}'. Apply imputation first.")
    shaped = {}
    for a in attributes:
        x = sql_double(df, a)
        if method == "boxcox":
            x = f"greatest({x}, {number(BOXCOX_FLOOR)})"
        lam = (lambdas or {}).get(a)
        if lam is None:
            lam = best_lambda(df, x, method)
        shaped[a] = yeojohnson_sql(x, lam) if method == "yeojohnson" else boxcox_sql(x, lam)
    got = stats.one_row(
        df, {(a, k): F.expr(f"{k}({sql})") for a, sql in shaped.items() for k in ("avg", "stddev_pop")}
    )
    return Step(
        STEP,
        method,
        replace={
            a: f"({sql} - {number(got[(a, 'avg')] or 0.0)}) / {number(got[(a, 'stddev_pop')] or 1.0)}"
            for a, sql in shaped.items()
        },
    )


def fit_transform(df: DataFrame, attributes: Sequence[str], op: str) -> Step:
    attributes = list(attributes)
    for a in attributes:
        if not is_numeric(dtype_of(df, a)):
            raise PrepareError(STEP, op, f"Attribute '{a}' is not numeric. Transformations require numeric data.")
    if op in ("yeojohnson", "boxcox"):
        return fit_power(df, attributes, op)
    replace = {}
    for a in attributes:
        x = sql_double(df, a)
        if op == "log":
            replace[a] = f"CASE WHEN {x} IS NOT NULL THEN log1p(greatest({x}, 0D)) END"
        elif op == "sqrt":
            replace[a] = f"CASE WHEN {x} IS NOT NULL THEN sqrt(greatest({x}, 0D)) END"
        elif op == "reciprocal":
            replace[a] = f"1D / nullif({x}, 0D)"
        else:
            raise PrepareError(STEP, op, "Unknown operation.")
    return Step(STEP, op, replace=replace)


def few_distinct(df: DataFrame, columns: Sequence[str], enough: int) -> tuple[dict[str, int], dict[str, int], int]:
    """(min(distinct values, enough), values there) per column, and the rows. A sketch far above
    ``enough`` decides directly; only columns with few values are counted exactly."""
    frame = nan_to_null(df.select(*[as_double(df, c).alias(c) for c in columns]))
    aggs = {(c, k): f(col(c)) for c in columns for k, f in (("rough", F.approx_count_distinct), ("n", F.count))}
    got = stats.one_row(frame, {"rows": F.count(F.lit(1)), **aggs})
    small = [c for c in columns if got[(c, "rough")] < 10 * enough]
    exact = stats.distinct_counts(frame, small) if small else {}
    return {c: min(exact.get(c, enough), enough) for c in columns}, {c: got[(c, "n")] for c in columns}, got["rows"]


def fit_binning(df: DataFrame, attributes: Sequence[str]) -> Step:
    """Up to five equally filled bins, right-closed, numbered from 0."""
    attributes = list(attributes)
    distinct, there, rows = few_distinct(df, attributes, BINS)
    for a in attributes:
        if there[a] < rows:
            raise PrepareError(STEP, "binning", f"Binning requires no missing values in '{a}'. Apply imputation first.")
        if distinct[a] < 2:
            raise PrepareError(STEP, "binning", f"Column '{a}' has too few unique values for binning.")
    probs = {a: [i / distinct[a] for i in range(distinct[a] + 1)] for a in attributes}
    q = stats.quantiles(df, probs, there)
    replace = {}
    for a in attributes:
        edges = list(dict.fromkeys(round(e, EDGE_DIGITS) for e in q[a]))
        x = sql_double(df, a)
        above = [f"CAST({x} > {number(e)} AS INT)" for e in edges[1:-1]] or ["0"]
        replace[a] = f"CAST({' + '.join(above)} AS DOUBLE)"
    return Step(STEP, "binning", replace=replace)
