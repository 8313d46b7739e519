"""Samples and splits that do not depend on partitioning when a key is given."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import materialize
from tabloom.types import col

SAMPLE_ROWS = 10_000
TEST_PERCENT = 20


STEPS = 1 << 40


def _draw(key: Sequence[str] | None, seed: int, use: str) -> Column:
    """A pseudo-random number in [0, 1) per row: a hash of the key, or plain random. Hashing
    whole rows would move all copies of a row together, so it is not an option here.
    ``use`` keeps the draws of a sample, a split and folds of the same key independent."""
    if key:
        return F.pmod(F.xxhash64(*[col(k) for k in key], F.lit(seed), F.lit(use)), F.lit(STEPS)) / F.lit(float(STEPS))
    return F.rand(seed + zlib.crc32(use.encode()))


def sample_cap(df: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``rows`` rows (all of them when there are fewer), picked by the smallest draws.

    A bound on the draw first thins the table to about twice the wanted rows, so that
    ordering touches only those. Without a key the thinned rows are written once.
    """
    total = df.count()
    if total <= rows:
        return df
    share = (2.0 * rows + 100.0) / total
    drawn = df.withColumn("_draw", _draw(key, seed, "sample"))
    thin = drawn.where(F.col("_draw") < share) if share < 1.0 else drawn
    if not key:
        thin = materialize(thin)
    if share < 1.0 and thin.count() < rows:
        # a key with few distinct values draws unevenly; then order everything
        thin = drawn if key else materialize(df.withColumn("_draw", _draw(key, seed, "sample")))
    return thin.orderBy("_draw", *[col(k) for k in key or ()]).limit(rows).drop("_draw")


def train_test_split(
    df: DataFrame, test_percent: int = TEST_PERCENT, seed: int = 42, key: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test). With a key the side of a row is a hash of it and no data moves.
    Without one, sides are drawn at random and written once, so both frames agree."""
    side = _draw(key, seed, "split") < test_percent / 100.0
    if key:
        return df.where(~side), df.where(side)
    drawn = materialize(df.withColumn("_test", side))
    return drawn.where(~F.col("_test")).drop("_test"), drawn.where("_test").drop("_test")


def folds(df: DataFrame, k: int = 3, seed: int = 42, key: Sequence[str] | None = None, name: str = "fold") -> DataFrame:
    """A fold number per row. Hashing spreads every class evenly over the folds without
    ranking the rows of a class, which would put a frequent class into one task."""
    drawn = df.withColumn(name, F.floor(_draw(key, seed, "folds") * k).cast("int"))
    return drawn if key else materialize(drawn)
