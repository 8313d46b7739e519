"""Profiles and plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import plots, profile
from tabloom.queries.common import (
    LABELLED_SQL,
    LINEITEM_NUMBERS,
    LINEITEM_X,
    ORDERS_DUP,
    ORDERS_X,
    QueryMap,
    labelled_documents,
    lineitem_x,
    orders_dup,
    orders_x,
    rounded,
    table,
    union_all,
)

NUMS = LINEITEM_NUMBERS
NUMS_X = ["price_n", "qty_o", "l_discount", "konst"]
CORR = ["l_quantity", "l_extendedprice", "l_discount", "price_n"]


def _sparse(spark, sf):
    df = lineitem_x(spark, sf).selectExpr(
        "l_orderkey", "l_linenumber", "price_n", "CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS rarely"
    )
    return profile.drop_sparse_columns(df)


def _facts(spark, sf):
    df = table(spark, sf, "lineitem").drop("l_shipdate", "l_orderkey")
    return profile.dataset_facts(df, target="l_returnflag", linearity="non-linear")


QUERIES: QueryMap = {
    "null_profile": lambda s, d: profile.null_profile(lineitem_x(s, d), ["price_n", "qty_o", "l_shipdate", "l_returnflag"]),
    "unique_counts": lambda s, d: profile.unique_counts(lineitem_x(s, d), ["price_n", "l_discount", "l_returnflag", "l_shipdate"]),
    "duplicate_rows": lambda s, d: profile.duplicate_rows(orders_dup(s, d)),
    "remove_duplicates": lambda s, d: profile.remove_duplicates(orders_dup(s, d)),
    "drop_sparse_columns": _sparse,
    "describe_numeric": lambda s, d: rounded(profile.describe_numeric(lineitem_x(s, d), NUMS_X), 4),
    "describe_categorical": lambda s, d: profile.describe_categorical(orders_x(s, d), ["prio_n", "o_orderstatus"]),
    "eda_numeric": lambda s, d: profile.eda_numeric(lineitem_x(s, d), NUMS_X),
    "eda_categorical": lambda s, d: profile.eda_categorical(orders_x(s, d), ["prio_n", "o_orderstatus"]),
    "eda_mode": lambda s, d: profile.mode_values(lineitem_x(s, d), ["price_n", "l_discount", "l_quantity"]),
    "iqr_outliers": lambda s, d: rounded(profile.iqr_outliers(lineitem_x(s, d), ["price_n", "qty_o", "l_tax"]), 4),
    "sigma_outliers": lambda s, d: profile.sigma_outliers(lineitem_x(s, d), NUMS_X),
    "skewness": lambda s, d: rounded(profile.skewness(lineitem_x(s, d), NUMS_X), 6),
    "kurtosis": lambda s, d: rounded(profile.kurtosis(lineitem_x(s, d), NUMS_X), 6),
    "correlation_matrix": lambda s, d: rounded(profile.correlation_matrix(lineitem_x(s, d), CORR + ["konst"]), 6),
    "correlation_pairs": lambda s, d: rounded(profile.correlation_pairs(lineitem_x(s, d), CORR), 6),
    "insights": lambda s, d: profile.insights(profile.eda_numeric(lineitem_x(s, d), NUMS_X)),
    "class_weights": lambda s, d: rounded(profile.class_weights(labelled_documents(s, d), "quality"), 6),
    "owner_counts": lambda s, d: profile.owner_counts(
        table(s, d, "orders"),
        "o_custkey",
        {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority").startswith("1-")},
    ),
    "dataset_facts": _facts,
    "algo_ranking": lambda s, d: profile.algorithm_ranking(_facts(s, d)),
    "histogram_auto": lambda s, d: plots.histogram(table(s, d, "orders"), "o_totalprice"),
    "histogram_events": lambda s, d: plots.histogram(table(s, d, "events"), "value"),
    "box_summary": lambda s, d: plots.box_summary(lineitem_x(s, d), "qty_o"),
    "box_outliers": lambda s, d: plots.box_outliers(lineitem_x(s, d), "qty_o"),
    "scatter_sample": lambda s, d: plots.scatter_points(
        lineitem_x(s, d), "price_n", "l_quantity", key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    ),
    "bar_counts": lambda s, d: plots.bar_counts(table(s, d, "part"), "p_type"),
}

_FENCED = f"""
(SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({{c}} AS DOUBLE), 0.5) AS q2,
         quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3, min({{c}}) AS mn, max({{c}}) AS mx FROM {LINEITEM_X}))"""

_EDA = f"""
SELECT '{{c}}' AS column_name, count(*) AS total_count, count(*) - count({{c}}) AS null_count,
  round(100.0 * (count(*) - count({{c}})) / count(*), 2) AS null_percent,
  round(avg({{c}}), 4) AS mean, round(max(q2), 4) AS median,
  round((SELECT {{c}} FROM {LINEITEM_X} WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY count(*) DESC, {{c}} LIMIT 1), 4) AS mode,
  round(stddev_samp({{c}}), 4) AS std, round(min({{c}}), 4) AS min, round(max({{c}}), 4) AS max,
  round(CASE WHEN stddev_pop({{c}}) = 0 THEN 0 ELSE skewness({{c}}) END, 4) AS skewness,
  round(CASE WHEN stddev_pop({{c}}) = 0 THEN 0 ELSE kurtosis({{c}}) END, 4) AS kurtosis,
  round(max(q1), 4) AS q1, round(max(q3), 4) AS q3, round(max(q3) - max(q1), 4) AS iqr,
  count(*) FILTER (WHERE {{c}} < lo OR {{c}} > hi) AS outlier_count
FROM {LINEITEM_X}, {_FENCED}"""

_HIST = """
WITH v AS (SELECT CAST({c} AS DOUBLE) AS v FROM {t} WHERE {c} IS NOT NULL),
s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi,
        2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) * pow(count(*), -1.0 / 3) AS fd,
        (max(v) - min(v)) / (log2(count(*)) + 1) AS st FROM v),
b AS (SELECT lo, hi, CAST(ceil((hi - lo) / CASE WHEN fd = 0 THEN st ELSE least(fd, st) END) AS BIGINT) AS k FROM s),
c AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * k) AS BIGINT), k - 1) AS bin, count(*) AS y FROM v, b GROUP BY 1)
SELECT r.bin AS bin, round(lo + (r.bin + 0.5) * ((hi - lo) / k), 4) AS x, CAST(coalesce(y, 0) AS BIGINT) AS y
FROM (SELECT unnest(range(0, (SELECT k FROM b))) AS bin) r CROSS JOIN b LEFT JOIN c ON c.bin = r.bin"""

# the expected rules, written out for the SQL side
_RULES = """SELECT * FROM (VALUES
  ('problem_type', 'regression', 'Linear Regression', 3, 0),
  ('problem_type', 'regression', 'Ridge (L2)', 3, 1),
  ('problem_type', 'regression', 'Lasso (L1)', 3, 2),
  ('problem_type', 'regression', 'SVR', 3, 3),
  ('problem_type', 'regression', 'KNN Regressor', 3, 4),
  ('problem_type', 'regression', 'Decision Tree', 3, 8),
  ('problem_type', 'regression', 'Random Forest', 3, 9),
  ('problem_type', 'classification', 'Logistic Regression', 3, 5),
  ('problem_type', 'classification', 'SVC', 3, 6),
  ('problem_type', 'classification', 'KNN Classifier', 3, 7),
  ('problem_type', 'classification', 'Decision Tree', 3, 8),
  ('problem_type', 'classification', 'Random Forest', 3, 9),
  ('problem_type', 'clustering', 'KMeans Clustering', 5, 10),
  ('linearity', 'linear', 'Linear Regression', 3, 0),
  ('linearity', 'linear', 'Logistic Regression', 3, 5),
  ('linearity', 'linear', 'Ridge (L2)', 2, 1),
  ('linearity', 'linear', 'Lasso (L1)', 2, 2),
  ('linearity', 'non-linear', 'Random Forest', 3, 9),
  ('linearity', 'non-linear', 'Decision Tree', 2, 8),
  ('linearity', 'non-linear', 'SVC', 2, 6),
  ('linearity', 'non-linear', 'KNN Classifier', 1, 7),
  ('linearity', 'non-linear', 'KNN Regressor', 1, 4),
  ('dataset_size', 'small', 'KNN Classifier', 3, 7),
  ('dataset_size', 'small', 'KNN Regressor', 3, 4),
  ('dataset_size', 'small', 'SVC', 2, 6),
  ('dataset_size', 'large', 'Random Forest', 3, 9),
  ('dataset_size', 'large', 'Ridge (L2)', 2, 1),
  ('dataset_size', 'large', 'Lasso (L1)', 2, 2),
  ('noise_level', 'high', 'Random Forest', 4, 9),
  ('noise_level', 'high', 'Ridge (L2)', 2, 1),
  ('noise_level', 'high', 'Lasso (L1)', 2, 2),
  ('noise_level', 'low', 'Linear Regression', 2, 0),
  ('noise_level', 'low', 'Logistic Regression', 2, 5),
  ('need_interpretability', 'true', 'Linear Regression', 3, 0),
  ('need_interpretability', 'true', 'Logistic Regression', 3, 5),
  ('need_interpretability', 'true', 'Decision Tree', 3, 8),
  ('feature_type', 'mixed', 'Decision Tree', 2, 8),
  ('feature_type', 'mixed', 'Random Forest', 2, 9),
  ('feature_type', 'mixed', 'KNN Classifier', 1, 7),
  ('class_balance', 'imbalanced', 'Random Forest', 3, 9),
  ('class_balance', 'imbalanced', 'SVC', 2, 6),
  ('speed_requirement', 'fast', 'Linear Regression', 2, 0),
  ('speed_requirement', 'fast', 'Logistic Regression', 2, 5),
  ('speed_requirement', 'fast', 'Decision Tree', 2, 8),
  ('n_features', 'high', 'Ridge (L2)', 3, 1),
  ('n_features', 'high', 'Lasso (L1)', 3, 2),
  ('n_features', 'high', 'SVC', 2, 6)) t(feature, value, algorithm, points, position)"""

_FACT_NUMS = ["l_partkey", "l_suppkey", "l_linenumber", *NUMS]
_FACTS_SQL = f"""
WITH noise AS (SELECT sum(x) AS out FROM ({union_all('''
  SELECT count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS x FROM lineitem,
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)''', _FACT_NUMS)})),
n AS (SELECT count(*) AS n FROM lineitem),
k AS (SELECT min(c) AS lo, max(c) AS hi FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag))
SELECT 'problem_type' AS feature, 'classification' AS value UNION ALL
SELECT 'dataset_size', CASE WHEN n < 10000 THEN 'small' WHEN n > 100000 THEN 'large' ELSE 'medium' END FROM n UNION ALL
SELECT 'feature_type', 'mixed' UNION ALL
SELECT 'noise_level', CASE WHEN out / (n * 8.0) <= 0.01 THEN 'low' WHEN out / (n * 8.0) > 0.1 THEN 'high' ELSE 'medium' END FROM noise, n UNION ALL
SELECT 'need_interpretability', 'false' UNION ALL
SELECT 'linearity', 'non-linear' UNION ALL
SELECT 'speed_requirement', 'moderate' UNION ALL
SELECT 'n_features', 'low' UNION ALL
SELECT 'class_balance', CASE WHEN lo * 2 < hi THEN 'imbalanced' ELSE 'balanced' END FROM k"""

_CORR_CONST = CORR + ["konst"]


def _matrix_cell(a: str, b: str) -> str:
    if "konst" in (a, b):
        return f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(NULL AS DOUBLE) AS corr"
    value = "1.0" if a == b else f"round(corr({a}, {b}), 6)"
    return f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({value} AS DOUBLE) AS corr FROM c" + (" LIMIT 1" if a == b else "")


ORACLES = {
    "null_profile": union_all(
        "SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, "
        f"round(100.0 * (count(*) - count({{c}})) / count(*), 2) AS null_percent FROM {LINEITEM_X}",
        ["price_n", "qty_o", "l_shipdate", "l_returnflag"],
    ),
    "unique_counts": union_all(
        f"SELECT '{{c}}' AS column_name, count(DISTINCT {{c}}) AS unique_count FROM {LINEITEM_X}",
        ["price_n", "l_discount", "l_returnflag", "l_shipdate"],
    ),
    "duplicate_rows": f"""SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
        FROM (SELECT count(*) AS c FROM {ORDERS_DUP} GROUP BY ALL)
        """.replace("GROUP BY ALL", "GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"),
    "remove_duplicates": f"SELECT DISTINCT * FROM {ORDERS_DUP}",
    "drop_sparse_columns": f"SELECT l_orderkey, l_linenumber, price_n FROM {LINEITEM_X}",
    "describe_numeric": union_all(
        f"""SELECT '{{c}}' AS column_name, count({{c}}) AS count, round(avg({{c}}), 4) AS mean, round(stddev_samp({{c}}), 4) AS std,
        round(min({{c}}), 4) AS min, round(quantile_cont({{c}}, 0.25), 4) AS q25, round(quantile_cont({{c}}, 0.5), 4) AS q50,
        round(quantile_cont({{c}}, 0.75), 4) AS q75, round(max({{c}}), 4) AS max FROM {LINEITEM_X}""",
        NUMS_X,
    ),
    "describe_categorical": union_all(
        f"""SELECT '{{c}}' AS column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
        (SELECT {{c}} FROM {ORDERS_X} WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY count(*) DESC, {{c}} LIMIT 1) AS top, max(n) AS freq
        FROM (SELECT {{c}}, count(*) AS n FROM {ORDERS_X} WHERE {{c}} IS NOT NULL GROUP BY {{c}})""".replace("AS unique", 'AS "unique"'),
        ["prio_n", "o_orderstatus"],
    ),
    "eda_numeric": union_all(_EDA, NUMS_X),
    "eda_categorical": union_all(
        f"""SELECT '{{c}}' AS column_name, count(*) AS total_count, count(*) - count({{c}}) AS null_count,
        round(100.0 * (count(*) - count({{c}})) / count(*), 2) AS null_percent, count(DISTINCT {{c}}) AS unique_count,
        (SELECT {{c}} FROM {ORDERS_X} WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY count(*) DESC, {{c}} LIMIT 1) AS top_value,
        (SELECT count(*) AS n FROM {ORDERS_X} WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY n DESC LIMIT 1) AS top_count
        FROM {ORDERS_X}""",
        ["prio_n", "o_orderstatus"],
    ),
    "eda_mode": union_all(
        f"""SELECT * FROM (SELECT '{{c}}' AS column_name, {{c}} AS mode, count(*) AS mode_count FROM {LINEITEM_X}
        WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY mode_count DESC, mode LIMIT 1)""",
        ["price_n", "l_discount", "l_quantity"],
    ),
    "iqr_outliers": union_all(
        f"""SELECT '{{c}}' AS column_name, round(max(q1), 4) AS q1, round(max(q3), 4) AS q3, round(max(lo), 4) AS lower_fence,
        round(max(hi), 4) AS upper_fence, count(*) FILTER (WHERE {{c}} < lo OR {{c}} > hi) AS outlier_count FROM {LINEITEM_X}, {_FENCED}""",
        ["price_n", "qty_o", "l_tax"],
    ),
    "sigma_outliers": union_all(
        f"""SELECT '{{c}}' AS column_name, count(*) FILTER (WHERE s > 0 AND abs({{c}} - m) > 3 * s) AS outlier_count
        FROM {LINEITEM_X}, (SELECT avg({{c}}) AS m, stddev_samp({{c}}) AS s FROM {LINEITEM_X})""",
        NUMS_X,
    ),
    "skewness": union_all(
        f"SELECT '{{c}}' AS column_name, round(CASE WHEN stddev_pop({{c}}) = 0 THEN 0 ELSE skewness({{c}}) END, 6) AS skewness FROM {LINEITEM_X}",
        NUMS_X,
    ),
    "kurtosis": union_all(
        f"SELECT '{{c}}' AS column_name, round(CASE WHEN stddev_pop({{c}}) = 0 THEN 0 ELSE kurtosis({{c}}) END, 6) AS kurtosis FROM {LINEITEM_X}",
        NUMS_X,
    ),
    "correlation_matrix": f"WITH c AS (SELECT * FROM {LINEITEM_X} WHERE price_n IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT * FROM ({_matrix_cell(a, b)})" for a in _CORR_CONST for b in _CORR_CONST),
    "correlation_pairs": " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {LINEITEM_X}"
        for i, a in enumerate(CORR)
        for b in CORR[i + 1 :]
    ),
    "insights": f"""SELECT column_name, CASE WHEN skewness > 1 THEN 'highly skewed right' WHEN skewness < -1 THEN 'highly skewed left'
        WHEN abs(skewness) > 0.5 THEN 'moderately skewed' ELSE 'roughly symmetric' END AS shape,
        null_percent > 10 AS consider_imputation, outlier_count > 0 AS has_outliers, outlier_count FROM ({union_all(_EDA, NUMS_X)})""",
    "class_weights": f"""SELECT quality AS class, count(*) AS n,
        round((SELECT count(*) FROM {LABELLED_SQL}) / ((SELECT count(DISTINCT quality) FROM {LABELLED_SQL}) * count(*)), 6) AS weight
        FROM {LABELLED_SQL} GROUP BY quality""",
    "owner_counts": """SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
        count(*) FILTER (WHERE o_orderpriority LIKE '1-%') AS urgent FROM orders GROUP BY o_custkey""",
    "dataset_facts": _FACTS_SQL,
    "algo_ranking": f"""WITH facts AS ({_FACTS_SQL}), rules AS ({_RULES}),
        scored AS (SELECT algorithm, position, sum(points) AS score FROM facts JOIN rules USING (feature, value) GROUP BY 1, 2)
        SELECT row_number() OVER (ORDER BY score DESC, position) AS rank, algorithm FROM scored ORDER BY 1 LIMIT 3""",
    "histogram_auto": _HIST.replace("{c}", "o_totalprice").replace("{t}", "orders"),
    "histogram_events": _HIST.replace("{c}", "value").replace("{t}", "events"),
    "box_summary": f"""SELECT 'qty_o' AS col1, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3,
        round(greatest(mn, lo), 4) AS lower_fence, round(least(mx, hi), 4) AS upper_fence FROM {_FENCED.replace('{c}', 'qty_o')}""",
    "box_outliers": f"""SELECT round(qty_o, 4) AS outlier FROM {LINEITEM_X}, {_FENCED.replace('{c}', 'qty_o')}
        WHERE qty_o < lo OR qty_o > hi ORDER BY qty_o LIMIT 200""",
    "bar_counts": "SELECT p_type AS x, count(*) AS y FROM part GROUP BY p_type ORDER BY y DESC, x LIMIT 30",
}
