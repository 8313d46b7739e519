"""Running totals, ranks and last-seen values over an order, without ever sorting
a whole table (or one hot key) inside a single task.

The order is cut into ranges of about ROWS_PER_RANGE rows: by split values in the query's text
while they are few, and by Spark's range partitioning beyond that, so that ranges never grow
with the table. Work inside a range is an ordinary window; what earlier ranges contribute is
carried over from a table that holds one row per range (and key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import materialize

ROWS_PER_RANGE = 200_000
LITERAL_RANGES = 1024  # cut by values in the query's text; more are cut by partitioning
SAMPLE_PER_RANGE = 32


def hashed_values(df: DataFrame, column: str, want: int, rows: int) -> list:
    """About ``want`` or more distinct values of a column (all, if there are fewer), chosen
    by the smallest hashes, so that neither partitioning nor copies matter. Only values
    below a hash bound are shuffled; the bound is raised until enough are found."""
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    buckets = 1 << 30
    share = min(1.0, 4.0 * want / max(rows, 1))
    while True:
        kept = values if share >= 1.0 else values.where(F.pmod(F.xxhash64("v"), F.lit(buckets)) < int(share * buckets))
        distinct = kept.groupBy("v").agg(F.xxhash64(F.first("v")).alias("h"))
        picked = distinct.orderBy(F.pmod("h", F.lit(buckets)), "v").limit(want).collect()
        if len(picked) >= want or share >= 1.0:
            return [r["v"] for r in picked]
        share = min(1.0, share * 64)


def split_values(df: DataFrame, order: str, ranges: int, rows: int) -> list:
    """``ranges - 1`` values cutting the distinct values of ``order`` about evenly."""
    if ranges < 2:
        return []
    values = sorted(hashed_values(df, order, ranges * SAMPLE_PER_RANGE, rows))
    step = len(values) / ranges
    return list(dict.fromkeys(values[int(i * step)] for i in range(1, ranges) if int(i * step) < len(values)))


def range_of(order: Column, splits: Sequence) -> Column:
    """Index of the range a value falls into; NULL sorts into range -1."""

    def cut(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order <= F.lit(splits[mid]), cut(lo, mid)).otherwise(cut(mid + 1, hi))

    return F.when(order.isNull(), F.lit(-1)).otherwise(cut(0, len(splits)))


def ranges_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_RANGE))


def with_ranges(df: DataFrame, order: str, ranges: int, rows: int) -> DataFrame:
    """The rows with ``_range``, which rises with ``order``; equal values share a range."""
    if ranges <= LITERAL_RANGES:
        return df.withColumn("_range", range_of(F.col(order), split_values(df, order, ranges, rows)))
    # kept, so that every reader sees the same ranges
    return materialize(df.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    order: str,
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add inclusive running totals ``sums[new] = source`` along ``order`` per ``by``.

    ``order`` should be unique within ``by`` (aggregate equal values first).
    ``df`` is read twice, so hand in something deterministic.
    """
    rows = df.count()
    ranges = ranges or ranges_for(rows)
    frame = with_ranges(df, order, ranges, rows)
    totals = frame.groupBy(*by, "_range").agg(*[F.sum(src).alias(f"_t_{new}") for new, src in sums.items()])
    direction = F.col("_range").desc() if descending else F.col("_range").asc()
    # at most `ranges` rows per key
    earlier = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)).alias(f"_c_{new}") for new in sums],
    )
    within = (
        Window.partitionBy(*by, "_range")
        .orderBy(F.col(order).desc() if descending else F.col(order).asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = frame.select("*", *[F.sum(src).over(within).alias(f"_w_{new}") for new, src in sums.items()])
    # plain equality where it is enough keeps the partitioning of the window below
    conditions = [
        F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) if df.schema[k].nullable else F.col(f"l.{k}") == F.col(f"r.{k}")
        for k in by
    ]
    conditions.append(F.col("l._range") == F.col("r._range"))
    condition = conditions[0]
    for extra in conditions[1:]:
        condition = condition & extra
    right = carried if by or ranges > LITERAL_RANGES else F.broadcast(carried)  # without keys: a row per range
    joined = summed.alias("l").join(right.alias("r"), condition, "inner")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"l._w_{new}") + F.col(f"r._c_{new}")).alias(new) for new in sums],
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    suffix: str = "_right",
    ranges: int | None = None,
) -> DataFrame:
    """For every left row the latest right row with ``right.on <= left.on`` and equal ``by``.

    All left rows are kept; those without time or key match nothing and take no part in the
    search. Right columns that clash get ``suffix``. Among right rows with the same key and time
    the largest one (compared column by column) wins, so that the result does not depend on
    row order.
    """
    by = list(by)
    rows = left.count() + right.count()
    ranges = ranges or ranges_for(rows)
    whole = F.col(on).isNotNull()
    for k in by:
        whole = whole & F.col(k).isNotNull()
    loose, left, right = left.where(~whole), left.where(whole), right.where(whole)
    payload_cols = [c for c in right.columns if c not in by]
    payload = F.struct(*[F.col(c).alias(c) for c in [on] + [c for c in payload_cols if c != on]])
    left_struct = F.struct(*[F.col(c).alias(c) for c in left.columns])
    # one row per (key, time) on the right: copies collapse before the shuffle
    right_best = right.groupBy(*by, on).agg(F.max(payload).alias("_payload"))
    stacked = left.select(*by, F.col(on), F.lit(1).alias("_side"), left_struct.alias("_left")).unionByName(
        right_best.select(*by, F.col(on), F.lit(0).alias("_side"), "_payload"), allowMissingColumns=True
    )
    stacked = with_ranges(stacked, on, ranges, rows)
    last_of_range = stacked.where("_side = 0").groupBy(*by, "_range").agg(F.max_by("_payload", on).alias("_last"))
    per_range = stacked.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # keys are there, so plain equality reuses the partitioning of the window
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by + ["_range"]]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    earlier = Window.partitionBy(*[F.col(k) for k in by]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_range.alias("a")
        .join(last_of_range.alias("b"), condition, "left")
        .select(*[F.col(f"a.{k}").alias(k) for k in by], F.col("a._range").alias("_range"), F.col("b._last").alias("_last"))
        .select(*by, "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    )
    within = (
        Window.partitionBy(*by, "_range")
        .orderBy(F.col(on), F.col("_side"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = stacked.withColumn("_seen", F.last("_payload", ignorenulls=True).over(within)).where("_side = 1")
    joined = seen.alias("a").join(carried.alias("b"), condition, "left")
    match = F.coalesce(F.col("a._seen"), F.col("b._carry"))
    result = joined.select(F.col("a._left").alias("_left"), match.alias("_match"))
    names = {c: c + suffix if c in left.columns else c for c in payload_cols}
    matched = result.select(
        *[F.col(f"_left.{c}").alias(c) for c in left.columns], *[F.col(f"_match.{c}").alias(name) for c, name in names.items()]
    )
    return matched.unionByName(loose.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(name) for c, name in names.items()]))


def first_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, spread: Column, salts: int = 32
) -> DataFrame:
    """The first ``k`` rows of every group. Each group is first cut down inside
    ``salts`` slices, so the final window sees at most ``salts * k`` rows per group."""
    sliced = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    partial = Window.partitionBy(*by, "_salt").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        sliced.withColumn("_rn", F.row_number().over(partial))
        .where(F.col("_rn") <= k)
        .withColumn("_rn", F.row_number().over(final))
        .where(F.col("_rn") <= k)
        .drop("_salt", "_rn")
    )
