"""The SQL workbench: queries a user types over one dataset, named ``data``."""

from __future__ import annotations

from tabloom.plans.sql import run_select, run_sql
from tabloom.queries.common import QueryMap, table
from tabloom.session import tune

# name -> (table, SQL). One text serves both engines where their dialects agree.
SHARED = {
    "sql_scalar_subquery": ("orders", """
        SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM data
        WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > (SELECT avg(o_totalprice) FROM data) GROUP BY o_orderpriority"""),
    "sql_time_agg": ("orders", """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS revenue
        FROM data GROUP BY 1"""),
    "sql_coalesce_group": ("orders", """
        SELECT coalesce(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END, 'Unknown') AS priority, count(*) AS n
        FROM data GROUP BY 1 HAVING count(*) > 10"""),
    "sql_rollup": ("lineitem", """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM data GROUP BY ROLLUP (l_returnflag, l_linestatus)"""),
    "sql_cube": ("lineitem", """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_discount), 2) AS disc FROM data GROUP BY CUBE (l_returnflag, l_linestatus)"""),
    "sql_grouping_sets": ("orders", """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM data GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"""),
    "sql_distinct_agg": ("lineitem", """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(*) AS n FROM data GROUP BY l_returnflag"""),
    "sql_self_join": ("orders", """
        WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(o_totalprice) AS r FROM data GROUP BY 1)
        SELECT a.m AS m, round(a.r, 2) AS revenue, round(a.r - b.r, 2) AS growth FROM m a JOIN m b ON a.m = b.m + 1"""),
    "sql_semi_join": ("lineitem", """
        SELECT l_returnflag, count(*) AS n FROM data d
        WHERE EXISTS (SELECT 1 FROM data x WHERE x.l_orderkey = d.l_orderkey AND x.l_quantity >= 50) GROUP BY l_returnflag"""),
    "sql_anti_join": ("lineitem", """
        SELECT l_returnflag, count(*) AS n FROM data d
        WHERE NOT EXISTS (SELECT 1 FROM data x WHERE x.l_orderkey = d.l_orderkey AND x.l_quantity >= 50) GROUP BY l_returnflag"""),
    "sql_range_join": ("orders", """
        SELECT b.band AS band, count(*) AS n, round(sum(d.o_totalprice), 2) AS total FROM data d
        JOIN (VALUES ('low', 0.0, 100000.0), ('mid', 100000.0, 300000.0), ('high', 300000.0, 1e12)) AS b(band, lo, hi)
          ON d.o_totalprice >= b.lo AND d.o_totalprice < b.hi GROUP BY b.band"""),
    "sql_rank": ("part", """
        WITH t AS (SELECT p_brand, p_type, count(*) AS n, round(sum(p_retailprice), 2) AS value FROM data GROUP BY p_brand, p_type)
        SELECT * FROM (SELECT p_brand, p_type, n, value, rank() OVER (PARTITION BY p_brand ORDER BY value DESC) AS rk,
          dense_rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS dr FROM t) WHERE rk <= 3"""),
    "sql_lag_lead": ("orders", """
        WITH t AS (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM data GROUP BY 1, 2)
        SELECT o_orderpriority, y, n, lag(n, 1) OVER (PARTITION BY o_orderpriority ORDER BY y) AS prev,
          lead(n, 1) OVER (PARTITION BY o_orderpriority ORDER BY y) AS next FROM t"""),
    "sql_moving_avg": ("events", """
        WITH t AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM data GROUP BY 1, 2)
        SELECT event_type, day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS week_avg FROM t"""),
    "sql_running_total": ("events", """
        WITH t AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS v FROM data GROUP BY 1, 2)
        SELECT event_type, day, v, round(sum(v) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS running FROM t"""),
    "sql_union": ("orders", """
        SELECT o_orderstatus AS v FROM data UNION SELECT o_orderpriority FROM data"""),
    "sql_intersect": ("orders", """
        SELECT o_custkey FROM data WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM data WHERE o_orderstatus = 'P'"""),
    "sql_except": ("orders", """
        SELECT o_custkey FROM data WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM data WHERE o_orderstatus = 'P'"""),
    "sql_string_fns": ("part", """
        SELECT upper(p_brand) AS brand, count(*) AS n, min(substring(p_name, 1, 5)) AS head, max(length(p_name)) AS longest,
          min(replace(lower(p_type), ' ', '_')) AS kind, min(concat(p_brand, '-', p_type)) AS tag, count(CASE WHEN p_type LIKE '%STEEL%' THEN 1 END) AS steel
        FROM data GROUP BY upper(p_brand)"""),
    "sql_date_fns": ("orders", """
        SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, min(CAST(o_orderdate AS DATE)) AS first_day, max(day(o_orderdate)) AS last_dom,
          count(DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE)) AS weeks FROM data GROUP BY 1, 2"""),
    "sql_math_fns": ("lineitem", """
        SELECT l_linenumber, round(sum(sqrt(l_quantity)), 4) AS roots, round(avg(ln(l_extendedprice)), 6) AS logs, CAST(sum(floor(l_extendedprice / 1000)) AS BIGINT) AS thousands,
          max(greatest(l_discount, l_tax)) AS worst, round(sum(pow(l_discount, 2)), 6) AS sq, CAST(sum(abs(l_linenumber - 4)) AS BIGINT) AS off FROM data GROUP BY l_linenumber"""),
}

# dialects differ: (table, Spark SQL, oracle SQL)
SPLIT = {
    "sql_json_fns": ("events", """
        SELECT event_type, count(*) AS n, CAST(sum(CAST(get_json_object(props, '$.k') AS INT)) AS BIGINT) AS k_sum,
          max(from_json(props, 'k INT').k) AS k_max, min(variant_get(parse_json(props), '$.k', 'int')) AS k_min FROM data GROUP BY event_type""", """
        SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k_sum,
          max(CAST(json_extract_string(props, '$.k') AS INT)) AS k_max, min(CAST(json_extract_string(props, '$.k') AS INT)) AS k_min FROM events GROUP BY event_type"""),
    "sql_array_fns": ("embeddings", """
        SELECT label, count(*) AS n, max(size(embedding)) AS dims, round(CAST(max(array_max(embedding)) AS DOUBLE), 5) AS top, round(CAST(min(array_min(embedding)) AS DOUBLE), 5) AS low,
          round(avg(element_at(embedding, 1)), 5) AS first, round(max(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x)), 5) AS total FROM data GROUP BY label""", """
        SELECT label, count(*) AS n, max(len(embedding)) AS dims, round(max(list_max(CAST(embedding AS DOUBLE[]))), 5) AS top, round(min(list_min(CAST(embedding AS DOUBLE[]))), 5) AS low,
          round(avg(embedding[1]), 5) AS first, round(max(list_sum(CAST(embedding AS DOUBLE[]))), 5) AS total FROM embeddings GROUP BY label"""),
    "sql_pivot": ("orders", """
        SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM data) PIVOT (count(1) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""", """
        SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
          count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority"""),
}

GUARDED = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {t} WHERE o_totalprice > 1000 AND o_orderpriority <> 'drop TABLE' GROUP BY o_orderstatus"


def _panel(name: str, sql: str):
    return lambda spark, sf: run_sql(table(spark, sf, name), sql)


def _guarded(spark, sf):
    return run_select(tune(spark), f"{sf}/orders*.parquet", GUARDED.replace("{t}", "TABLE"), "parquet")


QUERIES: QueryMap = {
    **{k: _panel(t, sql) for k, (t, sql) in SHARED.items()},
    **{k: _panel(t, sql) for k, (t, sql, _) in SPLIT.items()},
    "sql_guarded_select": _guarded,
}

ORACLES = {
    **{k: f"WITH data AS (SELECT * FROM {t}) SELECT * FROM ({sql})" for k, (t, sql) in SHARED.items()},
    **{k: sql for k, (_, _, sql) in SPLIT.items()},
    "sql_guarded_select": GUARDED.replace("{t}", "orders"),
}
