"""Model quality from (actual, predicted, probability) columns.

Classification metrics come from the confusion counts, which have one row per pair of
labels; everything after that first grouped pass is tiny.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import stats
from tabloom.functions.ordered import running_sums
from tabloom.session import materialize, working_copy

EPS = 2.220446049250313e-16  # spacing of doubles at 1


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) of the pairs that occur."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for every pair of known labels, zeros included.
    The label table has one row per class, so pairing it with itself is small."""
    counts = confusion_counts(df, actual, predicted)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    found = labels.agg(F.sort_array(F.collect_set("label")).alias("labels"))
    grid = found.select(F.explode("labels").alias("actual"), "labels").select("actual", F.explode("labels").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_pivot(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row per actual label, one column per predicted label."""
    labels = [r[0] for r in confusion_matrix(df, actual, predicted).select("predicted").distinct().orderBy("predicted").collect()]
    counts = confusion_counts(df, actual, predicted)
    return counts.groupBy("actual").pivot("predicted", labels).agg(F.sum("n")).na.fill(0)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def classification_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    """Accuracy, weighted precision, recall and F scores, kappa and MCC as (metric, value)."""
    counts = confusion_counts(df, actual, predicted)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per = sides.groupBy("label").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("t", "p", "hit")]
    )
    precision, recall = _ratio(F.col("hit"), F.col("p")), _ratio(F.col("hit"), F.col("t"))

    def f_beta(beta: float) -> Column:
        b = beta * beta
        return _ratio((1 + b) * precision * recall, b * precision + recall)

    t, p = F.col("t"), F.col("p")
    total = per.agg(
        F.sum(t).alias("s"),
        F.sum("hit").alias("c"),
        F.sum(t * precision).alias("wp"),
        F.sum(t * recall).alias("wr"),
        F.sum(t * f_beta(1.0)).alias("f1"),
        F.sum(t * f_beta(2.0)).alias("f2"),
        F.sum(t * f_beta(0.5)).alias("f05"),
        F.sum(t * p).alias("tp"),
        F.sum(t * t).alias("tt"),
        F.sum(p * p).alias("pp"),
    )
    s, c = F.col("s"), F.col("c")
    expected = F.col("tp") / (s * s)
    spread = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    values = {
        "accuracy": c / s,
        "precision": F.col("wp") / s,
        "recall": F.col("wr") / s,
        "f1_score": F.col("f1") / s,
        "f2_score": F.col("f2") / s,
        "f0_5_score": F.col("f05") / s,
        "cohen_kappa": (c / s - expected) / F.nullif(1.0 - expected, F.lit(0.0)),
        "mcc": _ratio(c * s - F.col("tp"), spread),
    }
    return metric_rows(total, values, digits)


def metric_rows(row: DataFrame, values: Mapping[str, Column], digits: int | None) -> DataFrame:
    """One aggregate row as (metric, value) rows."""
    shown = {k: (F.round(v, digits) if digits is not None else v) for k, v in values.items()}
    cells = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in shown.items()]
    return row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")


def binary_rates(df: DataFrame, actual: str, predicted: str, positive, digits: int = 4) -> DataFrame:
    """Specificity, FPR, FNR, FDR and NPV; 0 where the denominator is 0."""
    is_pos, said_pos = F.col(actual) == F.lit(positive), F.col(predicted) == F.lit(positive)
    row = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count_if(is_pos & said_pos).cast("double").alias("tp"),
        F.count_if(is_pos & ~said_pos).cast("double").alias("fn"),
        F.count_if(~is_pos & said_pos).cast("double").alias("fp"),
        F.count_if(~is_pos & ~said_pos).cast("double").alias("tn"),
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return metric_rows(
        row,
        {
            "specificity": _ratio(tn, tn + fp),
            "false_positive_rate": _ratio(fp, fp + tn),
            "false_negative_rate": _ratio(fn, fn + tp),
            "false_discovery_rate": _ratio(fp, fp + tp),
            "negative_predictive_value": _ratio(tn, tn + fn),
        },
        digits,
    )


# --------------------------------------------------------------------------
# scores and probabilities


def _by_score(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(score, pos, neg): equal scores combined before anything is ordered."""
    return df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def roc_curve(df: DataFrame, positive: Column, score: str, ranges: int | None = None) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) over descending scores, starting at (0, 0).
    All points are kept; dropping collinear ones would not change the area."""
    grouped = materialize(_by_score(df, positive, score))
    curve = running_sums(grouped, "score", {"tp": "pos", "fp": "neg"}, descending=True, ranges=ranges)
    totals = grouped.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = float(totals["p"] or 0), float(totals["n"] or 0)
    points = curve.select(F.col("score").alias("threshold"), "tp", "fp")
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp")
    )
    rate = lambda c, total: F.col(c) / F.lit(total) if total else F.lit(None).cast("double")
    return points.unionByName(start).select("threshold", "tp", "fp", rate("tp", p).alias("tpr"), rate("fp", n).alias("fpr"))


def auc_value(df: DataFrame, positive: Column, score: str, ranges: int | None = None) -> float | None:
    """Area under the ROC curve by the rank sum, ties at half; None for a single class."""
    grouped = materialize(_by_score(df, positive, score))
    ranked = running_sums(grouped, "score", {"below": "neg"}, ranges=ranges)
    # negatives strictly below count one, tied ones a half
    got = ranked.agg(
        F.sum(F.col("pos") * (F.col("below") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
    ).first()
    return got["u"] / (got["p"] * got["n"]) if got["p"] and got["n"] else None


def roc_auc(df: DataFrame, positive: Column, score: str, digits: int | None = 4, ranges: int | None = None) -> DataFrame:
    value = auc_value(df, positive, score, ranges)
    out = df.sparkSession.createDataFrame([("roc_auc", value)], "metric string, value double")
    return out if digits is None else out.select("metric", F.round("value", digits).alias("value"))


def roc_auc_ovr(df: DataFrame, actual: str, scores: Mapping[object, str], ranges: int | None = None) -> float | None:
    """One-vs-rest areas weighted by class frequency, all classes in one pass."""
    cells = [F.struct(F.lit(i).alias("c"), F.col(s).alias("score"), (F.col(actual) == F.lit(label)).alias("hit")) for i, (label, s) in enumerate(scores.items())]
    long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("score IS NOT NULL AND hit IS NOT NULL")
    grouped = materialize(
        long.groupBy("c", "score").agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )
    ranked = running_sums(grouped, "score", {"below": "neg"}, by=["c"], ranges=ranges)
    per = ranked.groupBy("c").agg(
        F.sum(F.col("pos") * (F.col("below") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
    ).collect()
    if not per or any(not r["p"] or not r["n"] for r in per):
        return None
    return sum(r["u"] / r["n"] for r in per) / sum(r["p"] for r in per)


def _clip_probability(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def probability_metrics(df: DataFrame, positive: Column, probability: str, digits: int | None = 4) -> DataFrame:
    """Brier score and log loss of a binary probability."""
    y, p = positive.cast("int"), F.col(probability)
    clipped = _clip_probability(p)
    loss = -(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))
    row = df.where(positive.isNotNull() & p.isNotNull()).agg(
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("loss")
    )
    return metric_rows(row, {"brier_score": F.col("brier"), "log_loss_val": F.col("loss")}, digits)


def log_loss(df: DataFrame, true_probability: Column) -> Column:
    return F.avg(-F.ln(_clip_probability(true_probability)))


# --------------------------------------------------------------------------
# regression


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, features: int | None = None, digits: int | None = 4
) -> DataFrame:
    """All error measures from one aggregate, plus the exact median absolute error."""
    pairs = df.select(F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("f")).dropna()
    e = F.col("y") - F.col("f")
    with working_copy(pairs) as pairs:
        got = stats.one_row(
            pairs,
            {
                "n": F.count(F.lit(1)),
                "sse": F.sum(e * e),
                "mae": F.avg(F.abs(e)),
                "mse": F.avg(e * e),
                "max": F.max(F.abs(e)),
                "me": F.avg(e),
                "ve": F.var_pop(e),
                "se": F.stddev_pop(e),
                "vy": F.var_pop("y"),
                "vf": F.var_pop("f"),
                "cov": F.covar_pop("y", "f"),
                "mape": F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(EPS))),
            },
        )
        median = stats.quantiles(pairs.select(F.abs(e).alias("a")), {"a": [0.5]}, {"a": got["n"]})["a"][0]
    schema = "metric string, value double"
    n = got["n"]
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    sst = got["vy"] * n
    r2 = 1 - got["sse"] / sst if sst else 0.0
    values = {
        "r2_score": r2,
        "mae": got["mae"],
        "mse": got["mse"],
        "rmse": got["mse"] ** 0.5,
        "median_absolute_error": median,
        "max_error": got["max"],
        "explained_variance": 1 - got["ve"] / got["vy"] if got["vy"] else 0.0,
        "residual_mean": got["me"],
        "residual_std": got["se"],
        "mape": got["mape"] * 100,
        "pearson_correlation": got["cov"] / (got["vy"] * got["vf"]) ** 0.5 if got["vy"] and got["vf"] else None,
    }
    if features is not None:
        values["adjusted_r2"] = 1 - (1 - r2) * (n - 1) / (n - features - 1) if n > features + 1 else r2
    out = df.sparkSession.createDataFrame(list(values.items()), schema)
    return out if digits is None else out.select("metric", F.round("value", digits).alias("value"))


def metrics_dict(metrics: DataFrame) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in metrics.collect()}


# --------------------------------------------------------------------------
# reports

# fixed values: metric, better when higher (+), lower (-) or neither (0), warn and good bounds
METRIC_BANDS: list[tuple[str, str, float, float]] = [
    ("accuracy", "+", 0.70, 0.85),
    ("precision", "+", 0.65, 0.80),
    ("recall", "+", 0.65, 0.80),
    ("f1_score", "+", 0.65, 0.80),
    ("f2_score", "+", 0.65, 0.80),
    ("f0_5_score", "+", 0.65, 0.80),
    ("cohen_kappa", "+", 0.40, 0.60),
    ("mcc", "+", 0.40, 0.70),
    ("specificity", "+", 0.65, 0.80),
    ("false_positive_rate", "-", 0.25, 0.10),
    ("false_negative_rate", "-", 0.25, 0.10),
    ("false_discovery_rate", "-", 0.25, 0.10),
    ("negative_predictive_value", "+", 0.65, 0.80),
    ("roc_auc", "+", 0.75, 0.90),
    ("brier_score", "-", 0.25, 0.10),
    ("log_loss_val", "-", 0.50, 0.20),
    ("r2_score", "+", 0.60, 0.85),
    ("adjusted_r2", "+", 0.60, 0.85),
    ("explained_variance", "+", 0.60, 0.85),
    ("pearson_correlation", "+", 0.70, 0.90),
    ("silhouette_score", "+", 0.25, 0.50),
]

# fixed values: the metrics a report shows per algorithm, in order
REPORT_METRICS: dict[str, list[str]] = {
    "LogisticRegression": [
        "accuracy",
        "roc_auc",
        "log_loss_val",
        "precision",
        "recall",
        "f1_score",
        "brier_score",
        "cohen_kappa",
        "mcc",
        "specificity",
    ],
    "SVC": [
        "accuracy",
        "precision",
        "recall",
        "f1_score",
        "f2_score",
        "mcc",
        "cohen_kappa",
        "roc_auc",
        "n_support_vectors",
        "false_positive_rate",
    ],
    "DecisionTree": [
        "accuracy",
        "precision",
        "recall",
        "f1_score",
        "mcc",
        "cohen_kappa",
        "f2_score",
        "tree_depth",
        "specificity",
        "false_negative_rate",
    ],
    "RandomForest": [
        "accuracy",
        "roc_auc",
        "f1_score",
        "precision",
        "recall",
        "mcc",
        "cohen_kappa",
        "n_estimators",
        "log_loss_val",
        "brier_score",
    ],
    "KNeighborsClassifier": [
        "accuracy",
        "precision",
        "recall",
        "f1_score",
        "roc_auc",
        "mcc",
        "cohen_kappa",
        "f2_score",
        "specificity",
        "false_positive_rate",
    ],
    "LinearRegression": [
        "r2_score",
        "adjusted_r2",
        "rmse",
        "mae",
        "mse",
        "mape",
        "explained_variance",
        "pearson_correlation",
        "residual_mean",
        "residual_std",
    ],
    "Ridge": [
        "r2_score",
        "adjusted_r2",
        "rmse",
        "mae",
        "mse",
        "mape",
        "explained_variance",
        "pearson_correlation",
        "residual_mean",
        "max_error",
    ],
    "Lasso": [
        "r2_score",
        "adjusted_r2",
        "rmse",
        "mae",
        "mse",
        "mape",
        "non_zero_coefficients",
        "explained_variance",
        "residual_mean",
        "pearson_correlation",
    ],
    "SVR": [
        "r2_score",
        "adjusted_r2",
        "rmse",
        "mae",
        "mse",
        "mape",
        "explained_variance",
        "pearson_correlation",
        "n_support_vectors",
        "residual_std",
    ],
    "KNeighborsRegressor": [
        "r2_score",
        "adjusted_r2",
        "rmse",
        "mae",
        "median_absolute_error",
        "mape",
        "explained_variance",
        "pearson_correlation",
        "max_error",
        "residual_std",
    ],
    "KMeans": [
        "silhouette_score",
        "calinski_harabasz",
        "davies_bouldin",
        "inertia",
        "n_clusters",
    ],
}


def metric_report(metrics: DataFrame, algorithm: str) -> DataFrame:
    """(position, metric, value, band): the algorithm's metrics that exist, each judged
    good, warn, bad or neutral."""
    spark = metrics.sparkSession
    shown = REPORT_METRICS.get(algorithm)
    if shown:
        order = spark.createDataFrame([(i + 1, m) for i, m in enumerate(shown)], "position int, metric string")
    else:
        order = metrics.select(F.row_number().over(_by_metric()).alias("position"), "metric").where("position <= 10")
    table = spark.createDataFrame(METRIC_BANDS, "metric string, better string, warn double, good double")
    v = F.col("value")
    band = (
        F.when(F.col("better").isNull(), "neutral")
        .when(((F.col("better") == "+") & (v >= F.col("good"))) | ((F.col("better") == "-") & (v <= F.col("good"))), "good")
        .when(((F.col("better") == "+") & (v >= F.col("warn"))) | ((F.col("better") == "-") & (v <= F.col("warn"))), "warn")
        .otherwise("bad")
    )
    return (
        metrics.where(v.isNotNull())
        .join(F.broadcast(order), "metric")
        .join(F.broadcast(table), "metric", "left")
        .select("position", "metric", "value", band.alias("band"))
    )


def _by_metric():
    from pyspark.sql import Window

    return Window.orderBy("metric")  # a metric table has a few dozen rows


def leaderboard(results: DataFrame) -> DataFrame:
    """(rank, model, accuracy, is_best, ...): by accuracy, failed models left out.
    ``results`` has one row per compared model."""
    from pyspark.sql import Window

    order = Window.orderBy(F.coalesce("accuracy", F.lit(0.0)).desc(), "model")  # one row per model
    ranked = results.where(F.col("error").isNull()) if "error" in results.columns else results
    return ranked.withColumn("rank", F.row_number().over(order)).withColumn("is_best", F.col("rank") == 1)


