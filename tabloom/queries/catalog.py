"""Lookups, joins, neighbours, sources and streams of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.lookup import lookup_join
from tabloom.functions.ordered import asof_join
from tabloom.operators import catalog, sampling
from tabloom.operators.knn import Metric, classify, knn_join, nearest, regress
from tabloom.plans.sql import qualify
from tabloom.queries.common import QueryMap, orders_x, rounded, table
from tabloom.session import scratch_path
from tabloom.sources import readers, writers


def _lookup(spark, sf):
    orders = orders_x(spark, sf).select("o_orderkey", "prio_n")
    stats = orders.where("prio_n IS NOT NULL").groupBy("prio_n").agg(F.count(F.lit(1)).alias("n"))
    return lookup_join(orders, "prio_n", stats, "prio_n", "n", F.lit(0), weight="n", into="n")


def _lookup_shuffled(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    stats = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return lookup_join(orders, "o_custkey", stats, "o_custkey", "n", F.lit(0), weight="n", small=False, into="n")


def _asof(spark, sf):
    events = table(spark, sf, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return asof_join(left, right, "ts", ["user_id"]).select("event_id", "user_id", "click_id", F.col("ts_right").alias("click_ts"))


def _nodes(spark, sf):
    region = table(spark, sf, "region").selectExpr("'r' || r_regionkey AS id", "CAST(NULL AS STRING) AS parent_id", "r_name AS name")
    nation = table(spark, sf, "nation").selectExpr("'n' || n_nationkey AS id", "'r' || n_regionkey AS parent_id", "n_name AS name")
    customer = table(spark, sf, "customer").selectExpr("'c' || c_custkey AS id", "'n' || c_nationkey AS parent_id", "c_name AS name")
    return region.unionByName(nation).unionByName(customer)


def _breadcrumbs(spark, sf):
    found = catalog.breadcrumbs(_nodes(spark, sf))
    return found.select("id", F.size("path").cast("bigint").alias("depth"), F.array_join(F.transform("path", lambda s: s["name"]), " / ").alias("path"))


def _ttl(spark, sf):
    events = table(spark, sf, "events")
    now = F.lit(catalog.newest(events, "ts"))
    return catalog.expired(events, "ts", now).select("event_id", "ts")


def _alive(spark, sf):
    events = table(spark, sf, "events")
    return catalog.alive(events, "ts", F.lit(catalog.newest(events, "ts"))).select("event_id", "ts")


def _timeline(spark, sf):
    events = table(spark, sf, "events")
    kinds = ["view", "click", "signup", "purchase"]
    return catalog.activity_timeline(
        {k: events.where(F.col("event_type") == k).selectExpr("CAST(event_id AS STRING) AS title", "ts") for k in kinds}
    )


def _empty(spark, sf):
    busy = table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000")
    return catalog.empty_parents(table(spark, sf, "customer"), "c_custkey", [(busy, "o_custkey")]).select("c_custkey", "c_name")


def _qualify(spark, sf):
    monthly = table(spark, sf, "orders").groupBy(
        "o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    order = Window.partitionBy("o_orderpriority").orderBy(F.desc("revenue"), "month")  # one row per month
    return qualify(monthly, F.row_number().over(order), lambda rn: rn <= 3)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def _knn(spark, sf):
    v = _vectors(spark, sf)
    return rounded(knn_join(v, v, "vec_id", "vec_id", "vec", 5, skip_self=True), 6)


def _neighbours(spark, sf, metric):
    v = _vectors(spark, sf)
    asked = v.select(F.col("vec_id").alias("qid"), "vec")
    known = v.select(F.col("vec_id").alias("tid"), "vec", F.col("label").cast("double").alias("payload"))
    return nearest(asked, known, 5, metric, skip_self=True)


def _knn_classify(spark, sf):
    found = classify(_neighbours(spark, sf, Metric("euclidean")))
    return found.select(F.col("qid").alias("vec_id"), F.col("prediction").cast("bigint").alias("prediction"))


def _knn_regress(spark, sf):
    found = regress(_neighbours(spark, sf, Metric("manhattan")), "distance")
    return rounded(found.select(F.col("qid").alias("vec_id"), "prediction"), 6)


def _csv(spark, sf):
    path = scratch_path(spark, "csv")
    writers.save(table(spark, sf, "customer"), path, "csv")
    return readers.load(spark, path, "csv")


def _json(spark, sf):
    path = scratch_path(spark, "json")
    writers.save(table(spark, sf, "part"), path, "json")
    return readers.load(spark, path, "json")


def _csv_schema(spark, sf):
    path, rows = scratch_path(spark, "csv"), table(spark, sf, "customer")
    writers.save(rows, path, "csv")
    return readers.read_csv(spark, path, rows.schema)


def _json_mixed(spark, sf):
    """One folder with files of one object per line and a file that is one array."""
    path = scratch_path(spark, "json")
    writers.save(table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name"), path, "json")
    few = table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name")  # 25 rows by their nature
    array = few.agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value"))
    array.coalesce(1).write.mode("append").text(path)
    return readers.load(spark, path, "json").select("id", "name")


def _metadata(spark, sf):
    return readers.inspect(table(spark, sf, "orders"))


def _json_rows(spark, sf):
    return writers.json_rows(orders_x(spark, sf).select("o_orderkey", "prio_n"))


def _sample(spark, sf):
    return sampling.sample_cap(table(spark, sf, "lineitem"), key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


def _split(spark, sf):
    train, test = sampling.train_test_split(table(spark, sf, "orders"), key=["o_orderkey"])
    return train.select("o_orderkey", F.lit("train").alias("side")).unionByName(test.select("o_orderkey", F.lit("test").alias("side")))


QUERIES: QueryMap = {
    "lookup_join": _lookup,
    "lookup_join_shuffled": _lookup_shuffled,
    "asof_join": _asof,
    "empty_parents": _empty,
    "breadcrumbs": _breadcrumbs,
    "catalog_search": lambda s, d: catalog.search(
        table(s, d, "orders"), ["o_orderpriority"], "o_orderdate", text="urgent", day="1995-06-17"
    ),
    "name_search": lambda s, d: catalog.search(table(s, d, "part"), ["p_name", "p_type"], "p_partkey", text="steel"),
    "topk_recent": lambda s, d: catalog.by_status(table(s, d, "orders"), "o_orderstatus", ["F", "P"], "o_orderdate", 10, "o_orderkey"),
    "ttl_expired": _ttl,
    "ttl_alive": _alive,
    "activity_timeline": _timeline,
    "daily_quota": lambda s, d: catalog.daily_quota(table(s, d, "events"), "user_id", "ts", "event_id").select(
        "event_id", "user_id", "ts", "accepted"
    ),
    "qualify": _qualify,
    "preview": lambda s, d: table(s, d, "orders").orderBy("o_orderkey").limit(5),
    "knn_join": _knn,
    "knn_classify": _knn_classify,
    "knn_regress": _knn_regress,
    "csv_roundtrip": _csv,
    "json_roundtrip": _json,
    "csv_with_schema": _csv_schema,
    "json_mixed": _json_mixed,
    "dataset_metadata": _metadata,
    "json_rows": _json_rows,
    "sample_cap": _sample,
    "train_test_split": _split,
}

_NEAR = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT a.vec_id, b.vec_id AS neighbor, b.label, DISTANCE AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor) AS rank FROM n)
"""
_EUCLID = _NEAR.replace("DISTANCE", "list_distance(a.e, b.e)")
_MANHATTAN = _NEAR.replace("DISTANCE", "list_sum([abs(x[1] - x[2]) FOR x IN list_zip(a.e, b.e)])").replace(
    "list_zip(a.e, b.e)", "[[a.e[i], b.e[i]] FOR i IN range(1, len(a.e) + 1)]"
)

ORACLES = {
    "lookup_join": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio_n FROM orders)
        SELECT o.o_orderkey, o.prio_n, coalesce(n, 0) AS n FROM o LEFT JOIN (SELECT prio_n, count(*) AS n FROM o GROUP BY prio_n) s ON o.prio_n = s.prio_n""",
    "lookup_join_shuffled": "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "asof_join": """WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'),
        r AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT l.event_id, l.user_id, r.click_id, r.ts AS click_ts FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "empty_parents": """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
        (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)""",
    "breadcrumbs": """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name FROM region
          UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
        t AS (SELECT id, 1::BIGINT AS depth, name AS path FROM n WHERE parent_id IS NULL
          UNION ALL SELECT n.id, depth + 1, path || ' / ' || n.name FROM n JOIN t ON n.parent_id = t.id) SELECT * FROM t""",
    "catalog_search": """SELECT * FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR CAST(o_orderdate AS DATE) = DATE '1995-06-17'""",
    "name_search": "SELECT * FROM part WHERE p_name ILIKE '%steel%' OR p_type ILIKE '%steel%'",
    "topk_recent": "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 10",
    "ttl_expired": "SELECT event_id, ts FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 6 HOURS",
    "ttl_alive": "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOURS",
    "activity_timeline": """SELECT event_type AS type, title, ts FROM (SELECT event_type, CAST(event_id AS VARCHAR) AS title, ts,
        row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS rn FROM events
        WHERE event_type IN ('view', 'click', 'signup', 'purchase')) WHERE rn <= 5 ORDER BY ts DESC, type, title LIMIT 10""",
    "daily_quota": """SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 5 AS accepted FROM events""",
    "qualify": """SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY revenue DESC, month) <= 3""",
    "preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "knn_join": _EUCLID + "SELECT vec_id, rank, neighbor, round(dist, 6) AS dist FROM r WHERE rank <= 5",
    "knn_classify": _EUCLID
    + """SELECT vec_id, label::BIGINT AS prediction FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS best
        FROM r WHERE rank <= 5 GROUP BY vec_id, label) WHERE best = 1""",
    "knn_regress": _MANHATTAN + "SELECT vec_id, round(sum(label / dist) / sum(1 / dist), 6) AS prediction FROM r WHERE rank <= 5 GROUP BY vec_id",
    "csv_roundtrip": "SELECT * FROM customer",
    "json_roundtrip": "SELECT * FROM part",
    "csv_with_schema": "SELECT * FROM customer",
    "json_mixed": "SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT n_nationkey, n_name FROM nation",
    "dataset_metadata": """SELECT name AS column_name, dtype, (SELECT count(*) FROM orders) AS row_count FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'),
        ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) t(name, dtype)""",
    "json_rows": """SELECT CASE WHEN o_orderkey % 11 = 0 THEN '{"o_orderkey":' || o_orderkey || ',"prio_n":null}'
        ELSE '{"o_orderkey":' || o_orderkey || ',"prio_n":"' || o_orderpriority || '"}' END AS json FROM orders""",
}
