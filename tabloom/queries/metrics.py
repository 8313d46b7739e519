"""Model and clustering quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import cluster_metrics, metrics
from tabloom.queries.common import QueryMap, embedding_dims, embedding_sql, rounded, table

DIMS = 64
E_COLS = [f"e{i}" for i in range(DIMS)]


def _scored(spark, sf):
    """Stand-in predictions: is a line returned, judged by its quantity."""
    return table(spark, sf, "lineitem").selectExpr(
        "CAST(l_returnflag = 'R' AS INT) AS y", "CAST(l_quantity > 25 AS INT) AS yhat", "l_quantity / 51 AS p",
        "l_returnflag AS flag", "CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 17 THEN 'N' ELSE 'A' END AS flag_hat",
        "l_extendedprice / 1000 AS price", "l_quantity * 1.5 AS price_hat",
    )


SCORED = """(SELECT CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_quantity > 25 AS INT) AS yhat, l_quantity / 51 AS p,
  l_returnflag AS flag, CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 17 THEN 'N' ELSE 'A' END AS flag_hat,
  l_extendedprice / 1000 AS price, l_quantity * 1.5 AS price_hat FROM lineitem)"""


def _y():
    return F.col("y") == 1


def _report(spark, sf):
    df = _scored(spark, sf)
    found = (
        metrics.classification_metrics(df, "y", "yhat")
        .unionByName(metrics.binary_rates(df, "y", "yhat", 1))
        .unionByName(metrics.roc_auc(df, _y(), "p"))
        .unionByName(metrics.probability_metrics(df, _y(), "p"))
    )
    return metrics.metric_report(found, "LogisticRegression")


def _pivot(spark, sf):
    return metrics.confusion_pivot(_scored(spark, sf), "flag", "flag_hat")


QUERIES: QueryMap = {
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(_scored(s, d), "flag", "flag_hat"),
    "confusion_pivot": _pivot,
    "classification_metrics": lambda s, d: metrics.classification_metrics(_scored(s, d), "flag", "flag_hat"),
    "binary_rates": lambda s, d: metrics.binary_rates(_scored(s, d), "y", "yhat", 1),
    "roc_curve": lambda s, d: rounded(metrics.roc_curve(_scored(s, d), _y(), "p"), 6),
    "roc_auc": lambda s, d: metrics.roc_auc(_scored(s, d), _y(), "p", 6),
    "brier_logloss": lambda s, d: metrics.probability_metrics(_scored(s, d), _y(), "p", 6),
    "regression_metrics": lambda s, d: metrics.regression_metrics(_scored(s, d), "price", "price_hat", features=1),
    "metric_report": _report,
    "cluster_sizes": lambda s, d: cluster_metrics.cluster_sizes(table(s, d, "embeddings"), "label"),
    "calinski_harabasz": lambda s, d: rounded(
        cluster_metrics.calinski_harabasz(embedding_dims(s, d, DIMS, "label"), E_COLS, "label"), 6
    ),
    "davies_bouldin": lambda s, d: rounded(cluster_metrics.davies_bouldin(embedding_dims(s, d, DIMS, "label"), E_COLS, "label"), 6),
    "inertia": lambda s, d: rounded(cluster_metrics.inertia(embedding_dims(s, d, DIMS, "label"), E_COLS, "label"), 4),
    "silhouette": lambda s, d: rounded(
        cluster_metrics.silhouette(embedding_dims(s, d, DIMS, "label"), E_COLS, "label"), 6
    ),
    "silhouette_squared": lambda s, d: rounded(
        cluster_metrics.silhouette_squared(embedding_dims(s, d, DIMS, "label"), E_COLS, "label"), 6
    ),
}

_RATES = f"""SELECT count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn,
  count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn FROM {SCORED}"""

_BINARY = f"""WITH c AS ({_RATES}) SELECT 'specificity' AS metric, round(tn / (tn + fp), 4) AS value FROM c
  UNION ALL SELECT 'false_positive_rate', round(fp / (fp + tn), 4) FROM c UNION ALL SELECT 'false_negative_rate', round(fn / (fn + tp), 4) FROM c
  UNION ALL SELECT 'false_discovery_rate', round(fp / (fp + tp), 4) FROM c UNION ALL SELECT 'negative_predictive_value', round(tn / (tn + fn), 4) FROM c"""


def _classification(actual: str, predicted: str) -> str:
    beta = lambda b: f"coalesce((1 + {b}) * P * R / nullif({b} * P + R, 0), 0)"
    return f"""
WITH n AS (SELECT {actual} AS a, {predicted} AS h, count(*) AS n FROM {SCORED} GROUP BY 1, 2),
l AS (SELECT a AS label FROM n UNION SELECT h FROM n),
k AS (SELECT label, coalesce((SELECT sum(n) FROM n WHERE a = label), 0)::DOUBLE AS t, coalesce((SELECT sum(n) FROM n WHERE h = label), 0)::DOUBLE AS p,
       coalesce((SELECT sum(n) FROM n WHERE a = label AND h = label), 0)::DOUBLE AS hit FROM l),
r AS (SELECT *, coalesce(hit / nullif(p, 0), 0) AS "P", coalesce(hit / nullif(t, 0), 0) AS "R" FROM (SELECT label, t, p AS p, hit FROM k)),
z AS (SELECT sum(t) AS s, sum(hit) AS c, sum(t * prec) AS wp, sum(t * rec) AS wr, sum(t * f1) AS f1, sum(t * f2) AS f2, sum(t * f05) AS f05,
       sum(t * pr) AS tp, sum(t * t) AS tt, sum(pr * pr) AS pp FROM (
   SELECT t, pr, hit, prec, rec, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1, coalesce(5 * prec * rec / nullif(4 * prec + rec, 0), 0) AS f2,
     coalesce(1.25 * prec * rec / nullif(0.25 * prec + rec, 0), 0) AS f05
   FROM (SELECT t, p AS pr, hit, coalesce(hit / nullif(p, 0), 0) AS prec, coalesce(hit / nullif(t, 0), 0) AS rec FROM k)))
SELECT 'accuracy' AS metric, round(c / s, 4) AS value FROM z UNION ALL SELECT 'precision', round(wp / s, 4) FROM z
UNION ALL SELECT 'recall', round(wr / s, 4) FROM z UNION ALL SELECT 'f1_score', round(f1 / s, 4) FROM z
UNION ALL SELECT 'f2_score', round(f2 / s, 4) FROM z UNION ALL SELECT 'f0_5_score', round(f05 / s, 4) FROM z
UNION ALL SELECT 'cohen_kappa', round((c / s - tp / (s * s)) / (1 - tp / (s * s)), 4) FROM z
UNION ALL SELECT 'mcc', round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 4) FROM z""".replace(
        """r AS (SELECT *, coalesce(hit / nullif(p, 0), 0) AS "P", coalesce(hit / nullif(t, 0), 0) AS "R" FROM (SELECT label, t, p AS p, hit FROM k)),
""",
        "",
    )


def _auc(digits: int) -> str:
    return f"""SELECT 'roc_auc' AS metric, round((sum(r) FILTER (WHERE y = 1) - np * (np + 1) / 2) / (np * nn), {digits}) AS value
    FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {SCORED}),
    (SELECT sum(y)::DOUBLE AS np, (count(*) - sum(y))::DOUBLE AS nn FROM {SCORED}) GROUP BY np, nn"""


def _probability(digits: int) -> str:
    return f"""SELECT 'brier_score' AS metric, round(avg((p - y) * (p - y)), {digits}) AS value FROM {SCORED}
    UNION ALL SELECT 'log_loss_val', round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), {digits}) FROM {SCORED}"""


_DIST = " + ".join(f"(a.{e} - b.{e}) * (a.{e} - b.{e})" for e in E_COLS)
_SIL = f"""
WITH v AS {embedding_sql(DIMS, 'vec_id', 'label')},
m AS (SELECT a.vec_id, a.label, b.label AS other, sum(DIST) AS s, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
p AS (SELECT vec_id, max(n) FILTER (WHERE other = label) AS n, max(s / nullif(n - 1, 0)) FILTER (WHERE other = label) AS a,
        min(s / n) FILTER (WHERE other <> label) AS b FROM m GROUP BY vec_id)
SELECT 'NAME' AS metric, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS value FROM p"""

_REG = f"""WITH e AS (SELECT price AS y, price_hat AS f, price - price_hat AS e FROM {SCORED}),
z AS (SELECT count(*) AS n, sum(e * e) AS sse, avg(abs(e)) AS mae, avg(e * e) AS mse, max(abs(e)) AS mx, avg(e) AS me, var_pop(e) AS ve,
  stddev_pop(e) AS se, var_pop(y) AS vy, corr(y, f) AS r, avg(abs(e) / abs(y)) AS mape, quantile_cont(abs(e), 0.5) AS med FROM e)
SELECT 'r2_score' AS metric, round(1 - sse / (vy * n), 4) AS value FROM z UNION ALL SELECT 'mae', round(mae, 4) FROM z
UNION ALL SELECT 'mse', round(mse, 4) FROM z UNION ALL SELECT 'rmse', round(sqrt(mse), 4) FROM z
UNION ALL SELECT 'median_absolute_error', round(med, 4) FROM z UNION ALL SELECT 'max_error', round(mx, 4) FROM z
UNION ALL SELECT 'explained_variance', round(1 - ve / vy, 4) FROM z UNION ALL SELECT 'residual_mean', round(me, 4) FROM z
UNION ALL SELECT 'residual_std', round(se, 4) FROM z UNION ALL SELECT 'mape', round(mape * 100, 4) FROM z
UNION ALL SELECT 'pearson_correlation', round(r, 4) FROM z
UNION ALL SELECT 'adjusted_r2', round(1 - (sse / (vy * n)) * (n - 1) / (n - 2), 4) FROM z"""

# the expected bands and order, written out for the SQL side
_BANDS = """
  ('accuracy', '+', 0.7::DOUBLE, 0.85::DOUBLE),
  ('precision', '+', 0.65::DOUBLE, 0.8::DOUBLE),
  ('recall', '+', 0.65::DOUBLE, 0.8::DOUBLE),
  ('f1_score', '+', 0.65::DOUBLE, 0.8::DOUBLE),
  ('f2_score', '+', 0.65::DOUBLE, 0.8::DOUBLE),
  ('f0_5_score', '+', 0.65::DOUBLE, 0.8::DOUBLE),
  ('cohen_kappa', '+', 0.4::DOUBLE, 0.6::DOUBLE),
  ('mcc', '+', 0.4::DOUBLE, 0.7::DOUBLE),
  ('specificity', '+', 0.65::DOUBLE, 0.8::DOUBLE),
  ('false_positive_rate', '-', 0.25::DOUBLE, 0.1::DOUBLE),
  ('false_negative_rate', '-', 0.25::DOUBLE, 0.1::DOUBLE),
  ('false_discovery_rate', '-', 0.25::DOUBLE, 0.1::DOUBLE),
  ('negative_predictive_value', '+', 0.65::DOUBLE, 0.8::DOUBLE),
  ('roc_auc', '+', 0.75::DOUBLE, 0.9::DOUBLE),
  ('brier_score', '-', 0.25::DOUBLE, 0.1::DOUBLE),
  ('log_loss_val', '-', 0.5::DOUBLE, 0.2::DOUBLE),
  ('r2_score', '+', 0.6::DOUBLE, 0.85::DOUBLE),
  ('adjusted_r2', '+', 0.6::DOUBLE, 0.85::DOUBLE),
  ('explained_variance', '+', 0.6::DOUBLE, 0.85::DOUBLE),
  ('pearson_correlation', '+', 0.7::DOUBLE, 0.9::DOUBLE),
  ('silhouette_score', '+', 0.25::DOUBLE, 0.5::DOUBLE)"""
_ORDER = """
  (1, 'accuracy'), (2, 'roc_auc'), (3, 'log_loss_val'), (4, 'precision'), (5, 'recall'), (6, 'f1_score'), (7, 'brier_score'), (8, 'cohen_kappa'), (9, 'mcc'), (10, 'specificity')"""

ORACLES = {
    "confusion_matrix": f"""WITH l AS (SELECT flag AS x FROM {SCORED} UNION SELECT flag_hat FROM {SCORED}),
        n AS (SELECT flag, flag_hat, count(*) AS n FROM {SCORED} GROUP BY 1, 2)
        SELECT a.x AS actual, b.x AS predicted, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN n ON flag = a.x AND flag_hat = b.x""",
    "confusion_pivot": f"""SELECT flag AS actual, count(*) FILTER (WHERE flag_hat = 'A') AS "A", count(*) FILTER (WHERE flag_hat = 'N') AS "N",
        count(*) FILTER (WHERE flag_hat = 'R') AS "R" FROM {SCORED} GROUP BY flag""",
    "classification_metrics": _classification("flag", "flag_hat"),
    "binary_rates": _BINARY,
    "roc_curve": f"""WITH g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM {SCORED} GROUP BY p),
        c AS (SELECT p, CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY p DESC) AS BIGINT) AS fp FROM g),
        t AS (SELECT sum(pos) AS np, sum(neg) AS nn FROM g)
        SELECT round(p, 6) AS threshold, tp, fp, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM c, t
        UNION ALL SELECT NULL, 0, 0, 0.0, 0.0""",
    "roc_auc": _auc(6),
    "brier_logloss": _probability(6),
    "regression_metrics": _REG,
    "metric_report": f"""WITH m AS (SELECT * FROM ({_classification('y', 'yhat')}) UNION ALL SELECT * FROM ({_BINARY}) UNION ALL SELECT * FROM ({_auc(4)})
        UNION ALL SELECT * FROM ({_probability(4)})), b AS (SELECT * FROM (VALUES {_BANDS}) t(metric, better, warn, good)),
        o AS (SELECT * FROM (VALUES {_ORDER}) t(position, metric))
        SELECT position, m.metric, value, CASE WHEN better IS NULL THEN 'neutral' WHEN better = '+' AND value >= good OR better = '-' AND value <= good THEN 'good'
          WHEN better = '+' AND value >= warn OR better = '-' AND value <= warn THEN 'warn' ELSE 'bad' END AS band
        FROM m JOIN o ON m.metric = o.metric LEFT JOIN b ON m.metric = b.metric""",
    "cluster_sizes": "SELECT label AS cluster, count(*) AS count FROM embeddings GROUP BY label",
    "calinski_harabasz": f"""WITH v AS {embedding_sql(DIMS, 'label')},
        c AS (SELECT label, count(*) AS n, {', '.join(f'avg({e}) AS {e}, var_pop({e}) AS v_{e}' for e in E_COLS)} FROM v GROUP BY label),
        g AS (SELECT {', '.join(f'avg({e}) AS g_{e}' for e in E_COLS)} FROM v)
        SELECT 'calinski_harabasz' AS metric, round((sum(n * ({' + '.join(f'({e} - g_{e}) * ({e} - g_{e})' for e in E_COLS)})) / (count(*) - 1))
          / (sum(n * ({' + '.join(f'v_{e}' for e in E_COLS)})) / (sum(n) - count(*))), 6) AS value FROM c, g""",
    "davies_bouldin": f"""WITH v AS {embedding_sql(DIMS, 'label')},
        c AS (SELECT label, {', '.join(f'avg({e}) AS {e}' for e in E_COLS)} FROM v GROUP BY label),
        s AS (SELECT a.label, avg(sqrt({_DIST})) AS s FROM v a JOIN c b ON a.label = b.label GROUP BY a.label),
        r AS (SELECT a.label, max((x.s + y.s) / sqrt({_DIST})) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s x ON x.label = a.label
          JOIN s y ON y.label = b.label GROUP BY a.label)
        SELECT 'davies_bouldin' AS metric, round(avg(r), 6) AS value FROM r""",
    "inertia": f"""WITH v AS {embedding_sql(DIMS, 'label')},
        c AS (SELECT label, {', '.join(f'avg({e}) AS {e}' for e in E_COLS)} FROM v GROUP BY label)
        SELECT 'inertia' AS metric, round(sum({_DIST}), 4) AS value FROM v a JOIN c b ON a.label = b.label""",
    "silhouette": _SIL.replace("DIST", f"sqrt({_DIST})").replace("NAME", "silhouette_score"),
    "silhouette_squared": _SIL.replace("DIST", _DIST).replace("NAME", "silhouette_squared"),
}
