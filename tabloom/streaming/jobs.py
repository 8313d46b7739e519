"""The same operators over arriving data.

Every job takes a streaming DataFrame and returns a started query; pass
``available_now=True`` to process what is there and stop.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tabloom.functions.ordered import first_per_group
from tabloom.operators.catalog import DAILY_QUOTA, TTL_HOURS
from tabloom.plans.models import FittedModel
from tabloom.plans.steps import FittedPreparation

LATENESS_DAYS = 7


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "json", options: Mapping[str, str] | None = None) -> DataFrame:
    """Files arriving in a folder. A stream needs its schema in advance."""
    return spark.readStream.format(fmt).schema(schema).options(**(options or {})).load(path)


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def prepare_stream(
    fitted: FittedPreparation, stream: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Apply a fitted preparation to arriving rows. Its steps are expressions, lookups and neighbour
    searches against fixed tables, so no state is kept.

    Neighbours are searched batch by batch; such batches are written under their own number, so
    one that is repeated after a failure replaces itself."""
    if fitted.asks_neighbours:

        def write(batch: DataFrame, number: int) -> None:
            fitted.transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

        return _start(stream.writeStream.foreachBatch(write), checkpoint, available_now)
    writer = fitted.transform(stream).writeStream.format("parquet").option("path", out).outputMode("append")
    return _start(writer, checkpoint, available_now)


def score_stream(
    model: FittedModel, stream: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Predictions for arriving records. A batch is written under its own number, so one
    that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        scored = model.transform(batch).withColumnRenamed("prediction", "Prediction")
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(stream.writeStream.foreachBatch(write), checkpoint, available_now)


def quota_counts(stream: DataFrame, user: str, ts: str, quota: int = DAILY_QUOTA, delay: str = "0 seconds") -> DataFrame:
    """Accepted and rejected requests per user and finished day. Counts are combined
    before the shuffle, so a busy user costs one row per task."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    n = F.col("n")
    return (
        timed.groupBy(F.window("_ts", "1 day").alias("w"), F.col(user).alias("user"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "user",
            F.col("w.start").cast("date").alias("day"),
            F.least(n, F.lit(quota)).alias("accepted"),
            F.greatest(n - quota, F.lit(0)).alias("rejected"),
        )
    )


def quota_stream(
    stream: DataFrame,
    user: str,
    ts: str,
    key: str,
    out: str,
    state: str,
    checkpoint: str,
    quota: int = DAILY_QUOTA,
    available_now: bool = False,
    lateness_days: int = LATENESS_DAYS,
    late: str | None = None,
) -> StreamingQuery:
    """Decide every arriving request: accepted while its user has used less than the quota
    that day, in time order inside a batch and arrival order between batches.

    What a user has used is one row per user and day, written per batch, and kept for
    ``lateness_days`` before the newest day of earlier batches. Requests of older days can no
    longer be decided: they are written, batch by batch, to ``late`` (default: ``out`` with
    ``-late``), not to ``out``.
    """
    late_out = late or f"{out.rstrip('/')}-late"

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_day", F.to_date(ts))
        past = None
        if number > 0:
            past = spark.read.parquet(f"{state}/batch={number - 1}").agg(F.max("_day")).first()[0]
        if past is not None:
            on_time = F.col("_day").isNull() | (F.col("_day") > F.date_sub(F.lit(past), lateness_days))
            rows.where(~on_time).drop("_day").write.mode("overwrite").parquet(f"{late_out}/batch={number}")
            rows = rows.where(on_time)
        keyed = rows.select(F.col(key).alias("_key"), F.col(user).alias("_user"), "_day", F.col(ts).alias("_ts"))
        order = [F.col("_ts"), F.col("_key")]
        first = first_per_group(keyed, ["_user", "_day"], order, quota, F.col("_key"))
        used = spark.createDataFrame([], first.select("_user", "_day").schema).withColumn("used", F.lit(0).cast("bigint"))
        if number > 0:
            used = spark.read.parquet(f"{state}/batch={number - 1}")
        from pyspark.sql import Window

        # at most `quota` rows per user and day are left here
        rank = F.row_number().over(Window.partitionBy("_user", "_day").orderBy(*order))
        accepted = (
            first.withColumn("_rn", rank)
            .join(used, ["_user", "_day"], "left")
            .where(F.col("_rn") + F.coalesce("used", F.lit(0)) <= quota)
            .select("_key", "_user", "_day")
        )
        fresh = accepted.groupBy("_user", "_day").agg(F.count(F.lit(1)).alias("used"))
        merged = used.unionByName(fresh).groupBy("_user", "_day").agg(F.sum("used").alias("used"))
        newest = merged.agg(F.max("_day")).first()[0]
        if newest is not None:
            merged = merged.where(F.col("_day") > F.date_sub(F.lit(newest), lateness_days))
        merged.write.mode("overwrite").parquet(f"{state}/batch={number}")
        decided = rows.drop("_day").join(accepted.select("_key"), F.col(key) == F.col("_key"), "left")
        decided.select(*batch.columns, F.col("_key").isNotNull().alias("accepted")).write.mode("overwrite").parquet(
            f"{out}/batch={number}"
        )

    return _start(stream.writeStream.foreachBatch(decide), checkpoint, available_now)


def expired_stream(stream: DataFrame, ts: str, key: str, hours: int = TTL_HOURS) -> DataFrame:
    """Entries come out once the newest timestamp seen is more than ``hours`` later. The
    watermark does the waiting: a group keyed by its own time closes when it is passed."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", f"{int(hours)} hours")
    return timed.groupBy(F.col(key), F.col("_ts")).agg(F.count(F.lit(1)).alias("_n")).select(key, F.col("_ts").alias(ts))


def append_to(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append finished rows to a Parquet folder, each exactly once."""
    return _start(stream.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, available_now)
