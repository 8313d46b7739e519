"""The data behind plots: histogram, box, scatter and bar."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import stats
from tabloom.operators.profile import FENCE
from tabloom.operators.sampling import sample_cap
from tabloom.session import working_copy
from tabloom.types import as_double, col, dtype_of, is_numeric

SCATTER_POINTS = 2000
BAR_CATEGORIES = 30
BOX_OUTLIERS = 200
MAX_BINS = 1_000_000


def _require_numeric(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"Column '{name}' not found in dataset.")
    if not is_numeric(dtype_of(df, name)):
        raise ValueError(f"Column '{name}' is not numeric. Use a bar chart for categorical columns.")


def bin_layout(n: int, low: float, high: float, q1: float, q3: float) -> tuple[float, float, int]:
    """(first edge, last edge, bins): the finer of the Freedman-Diaconis and Sturges widths."""
    if n == 0:
        return 0.0, 1.0, 1
    if high == low:
        return low - 0.5, high + 0.5, 1
    span = high - low
    sturges = span / (math.log2(n) + 1.0)
    scott_free = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    width = min(scott_free, sturges) if scott_free else sturges
    return low, high, int(math.ceil(span / width)) if width else 1


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, x, y): bin index, rounded bin centre and row count; empty bins included.
    Values are binned and pre-aggregated in one pass, so the shuffle carries only bins."""
    _require_numeric(df, column)
    frame = df.select(as_double(df, column).alias("v")).where(F.col("v").isNotNull())
    with working_copy(frame) as held:
        got = stats.one_row(held, {"n": F.count("v"), "lo": F.min("v"), "hi": F.max("v")})
        q = stats.quantiles(held, {"v": [0.25, 0.75]}, {"v": got["n"]}) if got["n"] else {"v": [0.0, 0.0]}
    low, high, bins = bin_layout(got["n"], got["lo"] or 0.0, got["hi"] or 0.0, *q["v"])
    if bins > MAX_BINS:
        raise ValueError(f"Column '{column}' needs {bins} bins; clip its outliers first.")
    width = (high - low) / bins
    raw = F.floor((F.col("v") - low) / (high - low) * bins).cast("bigint")
    # an edge is the float product below; a value next to one may round across it
    guess = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    left, right = F.lit(low) + guess * F.lit(width), F.lit(low) + (guess + 1) * F.lit(width)
    index = F.when((F.col("v") < left) & (guess > 0), guess - 1).when(
        (F.col("v") >= right) & (guess < bins - 1), guess + 1
    ).otherwise(guess)
    counts = frame.select(index.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("y"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    centre = (F.lit(low) + F.col("bin") * F.lit(width) + F.lit(low) + (F.col("bin") + 1) * F.lit(width)) / 2
    return every.join(counts, "bin", "left").select(
        "bin", F.round(centre, 4).alias("x"), F.coalesce("y", F.lit(0)).alias("y")
    )


def box_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles and fences clamped to the data."""
    _require_numeric(df, column)
    frame = df.select(as_double(df, column).alias("v")).where(F.col("v").isNotNull())
    with working_copy(frame) as held:
        got = stats.one_row(held, {"n": F.count("v"), "lo": F.min("v"), "hi": F.max("v")})
        quartiles = stats.quantiles(held, {"v": [0.25, 0.5, 0.75]}, {"v": got["n"]})["v"]
    schema = "col1 string, q1 double, median double, q3 double, lower_fence double, upper_fence double"
    if not got["n"]:
        return df.sparkSession.createDataFrame([(column, None, None, None, None, None)], schema)
    q1, q2, q3 = quartiles
    low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
    row = (column, q1, q2, q3, max(got["lo"], low), min(got["hi"], high))
    out = df.sparkSession.createDataFrame([row], schema)
    return out.select("col1", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


def box_outliers(df: DataFrame, column: str, limit: int = BOX_OUTLIERS) -> DataFrame:
    """The first ``limit`` values outside the Tukey fences, smallest first."""
    _require_numeric(df, column)
    frame = df.select(as_double(df, column).alias("v")).where(F.col("v").isNotNull())
    with working_copy(frame) as held:
        q1, q3 = stats.quantiles(held, {"v": [0.25, 0.75]})["v"]
    if q1 is None:
        return frame.select(F.col("v").alias("outlier"))
    low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
    outer = frame.where((F.col("v") < low) | (F.col("v") > high))
    return outer.orderBy("v").limit(limit).select(F.round("v", 4).alias("outlier"))


def scatter_points(
    df: DataFrame, x: str, y: str, limit: int = SCATTER_POINTS, seed: int = 42, key: Sequence[str] | None = None
) -> DataFrame:
    """Up to ``limit`` complete pairs; with a key, reruns give the same ones."""
    _require_numeric(df, x)
    _require_numeric(df, y)
    keys = [col(k).alias(f"k{i}") for i, k in enumerate(key or ())]
    pairs = df.select(as_double(df, x).alias("x"), as_double(df, y).alias("y"), *keys).dropna(subset=["x", "y"])
    names = [f"k{i}" for i in range(len(keys))] or None
    return sample_cap(pairs, limit, seed, names).select("x", "y")


def bar_counts(df: DataFrame, column: str, limit: int = BAR_CATEGORIES) -> DataFrame:
    """The most frequent values as text; equal counts in value order."""
    return (
        df.select(col(column).cast("string").alias("x"))
        .where(F.col("x").isNotNull())
        .groupBy("x")
        .agg(F.count(F.lit(1)).alias("y"))
        .orderBy(F.desc("y"), F.asc("x"))
        .limit(limit)
    )
