from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tabloom.plans.prepare import prepare
from tabloom.session import scratch_path
from tabloom.streaming import jobs

START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(rows, "id int, user int, ts timestamp_ntz")


def test_quota_holds_across_batches(spark):
    folder = scratch_path(spark, "in")
    first = events(spark, [(i, 1, START + timedelta(minutes=i)) for i in range(3)])
    second = events(spark, [(10 + i, 1, START + timedelta(hours=1, minutes=i)) for i in range(4)] + [(50, 2, START)])
    out, state, check = (scratch_path(spark, n) for n in ("out", "state", "check"))

    def run():
        stream = jobs.read_stream(spark, folder, first.schema, "parquet")
        jobs.quota_stream(stream, "user", "ts", "id", out, state, check, available_now=True).awaitTermination()

    first.write.mode("append").parquet(folder)
    run()
    second.write.mode("append").parquet(folder)
    run()
    got = {r["id"]: r["accepted"] for r in spark.read.parquet(out).collect()}
    assert got == {0: True, 1: True, 2: True, 10: True, 11: True, 12: False, 13: False, 50: True}


def test_quota_sets_late_requests_apart(spark):
    folder = scratch_path(spark, "in")
    new = events(spark, [(1, 1, START + timedelta(days=20)), (2, 1, START + timedelta(days=18))])
    old = events(spark, [(3, 1, START + timedelta(days=2)), (4, 1, START + timedelta(days=18, hours=1))])
    out, state, check = (scratch_path(spark, n) for n in ("out", "state", "check"))
    for part in (new, old):
        part.write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, new.schema, "parquet")
        jobs.quota_stream(stream, "user", "ts", "id", out, state, check, available_now=True, lateness_days=3).awaitTermination()
    assert {r["id"]: r["accepted"] for r in spark.read.parquet(out).collect()} == {1: True, 2: True, 4: True}
    assert [r["id"] for r in spark.read.parquet(f"{out}-late").collect()] == [3]


def test_expiry_waits_for_the_watermark(spark):
    folder = scratch_path(spark, "in")
    rows = [(1, 1, START), (2, 1, START + timedelta(hours=3)), (3, 1, START + timedelta(hours=7))]
    df = events(spark, rows)
    df.write.parquet(folder)
    stream = jobs.expired_stream(jobs.read_stream(spark, folder, df.schema, "parquet"), "ts", "id")
    out = scratch_path(spark, "out")
    jobs.append_to(stream, out, scratch_path(spark, "check"), available_now=True).awaitTermination()
    assert [r["id"] for r in spark.read.schema(stream.schema).parquet(out).collect()] == [1]


def test_stream_equals_batch(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority")
    ops = {"missing_values": ["mode"], "encoding": ["freq"]}
    fitted = prepare(df, ops, ["o_orderpriority"]).fitted
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    df.repartition(3).write.parquet(folder)
    stream = jobs.read_stream(spark, folder, df.schema, "parquet")
    jobs.prepare_stream(fitted, stream, out, scratch_path(spark, "check"), available_now=True).awaitTermination()
    key = lambda d: sorted(tuple(r) for r in d.select("o_orderkey", F.round("o_orderpriority", 9)).collect())
    assert key(spark.read.parquet(out)) == key(fitted.transform(df))
