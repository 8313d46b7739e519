"""Joining per-category statistics onto rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.types import col

# a lookup table of this many short rows is a few megabytes
BROADCAST_ROWS = 50_000
BROADCAST_KEY_BYTES = 8 * 1024 * 1024
HOT_KEYS = 1_000


def fits_broadcast(table: DataFrame, key: str) -> bool:
    """True when the lookup table is small both in rows and in key bytes (checked by a count)."""
    got = table.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(key).cast("string"))).alias("bytes")
    ).first()
    return got["n"] <= BROADCAST_ROWS and (got["bytes"] or 0) <= BROADCAST_KEY_BYTES


def hot_keys(table: DataFrame, key: str, weight: str) -> list:
    """The keys that most rows refer to."""
    return [r[0] for r in table.orderBy(F.desc(weight), key).limit(HOT_KEYS).select(key).collect()]


def lookup_join(
    df: DataFrame,
    column: str,
    table: DataFrame,
    key: str,
    value: str,
    default: Column | None = None,
    weight: str | None = None,
    small: bool | None = None,
    into: str | None = None,
    hot: list | None = None,
) -> DataFrame:
    """Replace ``column`` (or fill ``into``) by ``table.value`` where ``table.key`` matches.

    NULL keys never match. A checked small table is broadcast. A large one is joined by one
    shuffle on the key and a salt: rows without a key, and rows of a hot key (the given ones, or
    those of largest ``weight``, the row count per key), are spread by the partition they come
    from, and the few entries of hot keys are there once per salt.
    """
    into = into or column
    if small is None:
        small = fits_broadcast(table, key)
    right = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    if small:
        joined = df.join(F.broadcast(right), col(column) == F.col("_k"), "left")
    else:
        if hot is None:
            hot = hot_keys(table, key, weight) if weight else []
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        here = F.pmod(F.spark_partition_id(), F.lit(salts))
        spread = col(column).isin(hot) if hot else F.lit(False)
        copies = F.when(F.col("_k").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
        left = df.select("*", F.when(col(column).isNull() | spread, here).otherwise(0).alias("_salt"))
        right = right.select("*", F.explode(copies).alias("_at"))
        joined = left.join(right, (col(column) == F.col("_k")) & (F.col("_salt") == F.col("_at")), "left")
    result = F.col("_v") if default is None else F.coalesce(F.col("_v"), default)
    if into in df.columns:
        kept = [result.alias(c) if c == into else col(c) for c in df.columns]
    else:
        kept = [col(c) for c in df.columns] + [result.alias(into)]
    return joined.select(*kept)
