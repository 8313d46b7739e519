"""Feature selection: scores as tables, and the choice made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import PrepareError
from tabloom.functions import stats
from tabloom.operators.profile import correlation_pairs, is_continuous
from tabloom.plans.steps import Step
from tabloom.types import as_double, col

STEP = "feature_selection"
BEST = 10
CORR_LIMIT = 0.9
TREES = 100


def _long(wide: DataFrame, names: Sequence[str], **values: str) -> DataFrame:
    cells = [
        F.struct(F.lit(n).alias("feature"), *[col(f"{alias}{i}").alias(out) for out, alias in values.items()])
        for i, n in enumerate(names)
    ]
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def _keep_best(scores: dict[str, float | None], features: Sequence[str], k: int) -> list[str]:
    """The k best; equal scores keep the later column, unusable scores come last."""
    usable = {f: (float("-inf") if scores.get(f) is None else scores[f]) for f in features}
    order = sorted(range(len(features)), key=lambda i: (usable[features[i]], i))
    chosen = set(order[-k:])
    return [f for i, f in enumerate(features) if i in chosen]


def low_variance_threshold(df: DataFrame, columns: Sequence[str]) -> tuple[float, dict[str, float | None]]:
    m = stats.moments(df, columns)
    peak = max((m[c].max for c in columns if m[c].max is not None), default=0.0)
    return (0.01 if peak <= 1.0 else 0.1), {c: m[c].var_pop for c in columns}


def variance_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population variance per column and whether it passes the threshold."""
    threshold, variances = low_variance_threshold(df, columns)
    rows = [(c, v, threshold, v is not None and v > threshold) for c, v in variances.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, variance double, threshold double, kept boolean")


def fit_low_variance(df: DataFrame, columns: Sequence[str]) -> Step:
    threshold, variances = low_variance_threshold(df, columns)
    gone = [c for c in columns if variances[c] is None or not variances[c] > threshold]
    if len(gone) == len(columns):
        raise PrepareError(STEP, "low_variance", f"No feature meets the variance threshold {threshold}.")
    return Step(STEP, "low_variance", drop=gone)


def anova_f(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """One-way F statistic per feature. One grouped pass with map-side combining; the
    class table is reduced by a second aggregate, so many classes do no harm."""
    columns = list(columns)
    frame = df.select(col(target).alias("_c"), *[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    frame = frame.where(F.col("_c").isNotNull())
    overall = stats.one_row(frame, {i: F.avg(f"x{i}") for i in range(len(columns))})
    per_class = frame.groupBy("_c").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))],
        *[F.var_pop(f"x{i}").alias(f"v{i}") for i in range(len(columns))],
    )
    sums = [F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k")]
    for i in range(len(columns)):
        gap = F.col(f"m{i}") - F.lit(overall[i])
        sums += [F.sum(F.col("n") * gap * gap).alias(f"b{i}"), F.sum(F.col("n") * F.col(f"v{i}")).alias(f"w{i}")]
    wide = per_class.agg(*sums)
    none = F.lit(0.0)
    wide = wide.select(
        *[
            (
                (F.col(f"b{i}") / F.nullif(F.col("_k") - 1.0, none))
                / F.nullif(F.col(f"w{i}") / F.nullif((F.col("_n") - F.col("_k")).cast("double"), none), none)
            ).alias(f"f{i}")
            for i in range(len(columns))
        ]
    )
    return _long(wide, columns, f_score="f")


def f_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """F statistic of the linear correlation with a continuous target."""
    columns = list(columns)
    frame = df.select(as_double(df, target).alias("y"), *[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    none = F.lit(0.0)

    def squared(i: int):
        x, y = F.col(f"x{i}"), F.col("y")
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        r = F.covar_pop(x, y) / F.nullif(spread, none)
        return r * r

    wide = frame.agg(F.count("y").alias("_n"), *[squared(i).alias(f"r{i}") for i in range(len(columns))])
    wide = wide.select(
        *[
            (F.col(f"r{i}") / F.nullif(1.0 - F.col(f"r{i}"), none) * (F.col("_n") - 2.0)).alias(f"f{i}")
            for i in range(len(columns))
        ]
    )
    return _long(wide, columns, f_score="f")


def chi2_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Chi-squared of the class sums of each non-negative feature."""
    columns = list(columns)
    frame = df.select(col(target).alias("_c"), *[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    got = stats.one_row(frame, {"n": F.count(F.lit(1)), **{i: F.sum(f"x{i}") for i in range(len(columns))}})
    per_class = frame.groupBy("_c").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"o{i}") for i in range(len(columns))]
    )
    terms = []
    for i in range(len(columns)):
        expected = F.col("n") / F.lit(float(got["n"] or 1)) * F.lit(float(got[i] or 0.0))
        gap = F.col(f"o{i}") - expected
        terms.append(F.sum(gap * gap / F.nullif(expected, F.lit(0.0))).alias(f"f{i}"))
    return _long(per_class.agg(*terms), columns, chi2="f")


def _require_target(df: DataFrame, target: str | None, op: str, label: str) -> str:
    if not target or target not in df.columns:
        raise PrepareError(STEP, op, f"{label} requires a target column.")
    return target


def _require_features(df: DataFrame, columns: Sequence[str], op: str, label: str, words: str) -> None:
    if not columns:
        raise PrepareError(STEP, op, f"No feature columns remaining for {words}.")
    if any(stats.null_counts(df, columns).values()):
        raise PrepareError(STEP, op, f"{label} requires no missing values. Apply imputation first.")


def fit_kbest(df: DataFrame, columns: Sequence[str], target: str | None, k: int = BEST) -> Step:
    target = _require_target(df, target, "kbest", "K-best")
    features = [c for c in columns if c != target]
    _require_features(df, features, "kbest", "K-best", "k-best")
    score = f_regression if is_continuous(df, target) else anova_f
    scores = {r["feature"]: r["f_score"] for r in score(df, features, target).collect()}
    kept = _keep_best(scores, features, min(k, len(features)))
    return Step(STEP, "kbest", drop=[c for c in features if c not in kept])


def fit_correlation(df: DataFrame, columns: Sequence[str], limit: float = CORR_LIMIT) -> Step:
    """Drop a column when any earlier one correlates with it beyond the limit."""
    gone = {
        r["col_b"] for r in correlation_pairs(df, columns).collect() if r["corr"] is not None and abs(r["corr"]) > limit
    } if len(columns) > 1 else set()
    return Step(STEP, "correlation_threshold", drop=[c for c in columns if c in gone])


def tree_importance(df: DataFrame, columns: Sequence[str], target: str, trees: int = TREES, seed: int = 42) -> DataFrame:
    columns = list(columns)
    if is_continuous(df, target):
        frame = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)], as_double(df, target).alias("y"))
        forest = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, seed=seed)
    else:
        frame = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)], col(target).cast("string").alias("t"))
        frame = StringIndexer(inputCol="t", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(frame).transform(frame)
        forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, seed=seed)
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="x").transform(frame)
    weights = forest.fit(data.select("x", "y")).featureImportances.toArray()
    rows = [(c, float(w)) for c, w in zip(columns, weights)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def fit_tree(df: DataFrame, columns: Sequence[str], target: str | None, trees: int = TREES, seed: int = 42) -> Step:
    target = _require_target(df, target, "tree_importance", "Tree importance")
    features = [c for c in columns if c != target]
    _require_features(df, features, "tree_importance", "Tree importance", "tree importance")
    weights = {r["feature"]: r["importance"] for r in tree_importance(df, features, target, trees, seed).collect()}
    mean = sum(weights.values()) / len(weights)
    return Step(STEP, "tree_importance", drop=[c for c in features if weights[c] < mean])


def fit_chi2(df: DataFrame, columns: Sequence[str], target: str | None, k: int = BEST) -> Step:
    target = _require_target(df, target, "chi2", "Chi-squared")
    m = stats.moments(df, columns)
    if any(m[c].min is not None and m[c].min < 0 for c in columns):
        raise PrepareError(STEP, "chi2", "Chi-squared requires non-negative values. Apply MinMax scaling first.")
    if any(m[c].nulls for c in columns):
        raise PrepareError(STEP, "chi2", "Chi-squared requires no missing values. Apply imputation first.")
    scores = {r["feature"]: r["chi2"] for r in chi2_scores(df, columns, target).collect()}
    kept = _keep_best(scores, list(columns), min(k, len(columns)))
    return Step(STEP, "chi2", drop=[c for c in columns if c not in kept])
