"""Streams over the driver's tables, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.plans import training
from tabloom.plans.prepare import prepare
from tabloom.queries.common import LINEITEM_X, QueryMap, lineitem_x, rounded, table
from tabloom.queries.models import LINE_KEY, _lines
from tabloom.session import scratch_path
from tabloom.streaming import jobs

PREP = ["price_n", "qty_o"]


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return jobs.read_stream(spark, f"{sf}/{name}*.parquet", schema, "parquet")


def _finish(query, failed="stream failed"):
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"{failed}: {query.exception()}")


def _append(spark, stream, label):
    out = scratch_path(spark, label)
    _finish(jobs.append_to(stream, out, scratch_path(spark, f"{label}-checkpoint"), available_now=True))
    return spark.read.schema(stream.schema).parquet(out)


def _quota_counts(spark, sf):
    return _append(spark, jobs.quota_counts(_stream(spark, sf, "events"), "user_id", "ts"), "quota")


def _expired(spark, sf):
    out = _append(spark, jobs.expired_stream(_stream(spark, sf, "events"), "ts", "event_id"), "expired")
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _decisions(spark, sf):
    out, state = scratch_path(spark, "decisions"), scratch_path(spark, "used")
    stream = _stream(spark, sf, "events")
    _finish(jobs.quota_stream(stream, "user_id", "ts", "event_id", out, state, scratch_path(spark, "q"), available_now=True))
    return spark.read.parquet(out).select("event_id", "accepted")


def _prepared(spark, sf):
    """Fit on the table, then apply to the same rows arriving as a stream."""
    df = lineitem_x(spark, sf).select(*LINE_KEY, *PREP)
    ops = {"missing_values": ["median"], "outliers": ["iqr"], "scaling": ["minmax"]}
    fitted = prepare(df, ops, PREP).fitted
    arriving = _stream(spark, sf, "lineitem").selectExpr(
        *LINE_KEY,
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price_n",
        "CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 50 ELSE l_quantity END AS qty_o",
    )
    out = scratch_path(spark, "prepared")
    _finish(jobs.prepare_stream(fitted, arriving, out, scratch_path(spark, "p"), available_now=True))
    return rounded(spark.read.parquet(out), 6, *PREP)


def _scored(spark, sf):
    df = _lines(spark, sf)
    model = training.fit_model(df, "LinearRegression", "l_extendedprice", key=LINE_KEY).model
    arriving = _stream(spark, sf, "lineitem").select(*df.columns)
    out = scratch_path(spark, "scored")
    _finish(jobs.score_stream(model, arriving, out, scratch_path(spark, "s"), available_now=True))
    return spark.read.parquet(out).select(*LINE_KEY, F.round("Prediction", 2).alias("prediction"))


QUERIES: QueryMap = {
    "stream_quota_counts": _quota_counts,
    "stream_quota_decisions": _decisions,
    "stream_ttl_expired": _expired,
    "stream_prepare": _prepared,
    "stream_score": _scored,
}


def _minmaxed(c: str) -> str:
    return f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}"


ORACLES = {
    "stream_quota_counts": """SELECT user_id AS user, day, least(n, 5) AS accepted, greatest(n - 5, 0) AS rejected
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
        WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""",
    "stream_quota_decisions": "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 5 AS accepted FROM events",
    "stream_ttl_expired": "SELECT event_id, ts FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 6 HOURS",
    "stream_prepare": f"""WITH a AS (SELECT {', '.join(LINE_KEY)}, coalesce(price_n, (SELECT quantile_cont(price_n, 0.5) FROM {LINEITEM_X})) AS price_n, qty_o FROM {LINEITEM_X}),
        f AS (SELECT {', '.join(f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi" for c in PREP)} FROM a),
        b AS (SELECT {', '.join(LINE_KEY)}, greatest(least(price_n, price_n_hi), price_n_lo) AS price_n, greatest(least(qty_o, qty_o_hi), qty_o_lo) AS qty_o FROM a, f)
        SELECT {', '.join(LINE_KEY)}, {', '.join(_minmaxed(c) for c in PREP)} FROM b""",
}
