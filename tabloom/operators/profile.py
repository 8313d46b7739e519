"""Dataset profile: counts, moments, quantiles, outliers, correlations, insights."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions import linalg, stats
from tabloom.session import working_copy
from tabloom.types import as_double, col, column_kinds, dtype_of, is_numeric, nan_to_null, numeric_columns

Z_LIMIT = 3.0
FENCE = 1.5


def _long(df: DataFrame, columns: Sequence[str], per_column: Mapping[str, callable]) -> DataFrame:
    """One aggregate row over all columns, turned into one output row per column."""
    aggs = [fn(c).alias(f"{i}:{m}") for i, c in enumerate(columns) for m, fn in per_column.items()]
    wide = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("column_name"), *[col(f"{i}:{m}").alias(m) for m in per_column])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[as_double(df, c).alias(c) for c in columns])


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    frame = nan_to_null(df.select(*[col(c) for c in columns]))
    missing = lambda c: F.count_if(col(c).isNull())
    return _long(
        frame,
        columns,
        {
            "total_rows": lambda c: F.count(F.lit(1)),
            "null_count": missing,
            "null_percent": lambda c: F.coalesce(
                F.round(100.0 * missing(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2), F.lit(0.0)
            ),
        },
    )


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column. The exact form counts (column, value) cells,
    which spreads all columns over the cluster instead of expanding every row per column."""
    columns = list(columns or df.columns)
    frame = nan_to_null(df.select(*[col(c) for c in columns]))
    if approx:
        return _long(frame, columns, {"unique_count": lambda c: F.approx_count_distinct(col(c))})
    counted = stats.value_counts(frame, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    names = F.array(*[F.lit(c) for c in columns])
    every = df.sparkSession.range(1).select(F.explode(names).alias("column_name"))
    return every.join(F.broadcast(counted), "column_name", "left").select(
        "column_name", F.coalesce("unique_count", F.lit(0)).alias("unique_count")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Total rows and how many of them repeat an earlier row."""
    return (
        df.groupBy(*[col(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("_copies"))
        .agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_sparse_columns(df: DataFrame, keep_ratio: float = 0.5, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep a column when at least ``keep_ratio`` of its values are present."""
    columns = list(columns or df.columns)
    frame = nan_to_null(df.select(*[col(c) for c in columns]))
    got = stats.one_row(frame, {"": F.count(F.lit(1)), **{("n", c): F.count(col(c)) for c in columns}})
    return df.drop(*[c for c in columns if got[("n", c)] < keep_ratio * got[""]])


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    with working_copy(df.select(*[col(c) for c in columns])) as held:
        m = stats.moments(held, columns)
        q = stats.quantiles(held, {c: [0.25, 0.5, 0.75] for c in columns}, {c: m[c].n for c in columns})
    rows = [(c, m[c].n, m[c].mean, m[c].std, m[c].min, *q[c], m[c].max) for c in columns]
    schema = "column_name string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    return df.sparkSession.createDataFrame(rows, schema)


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, top (smallest on ties), freq."""
    counted = stats.value_counts(df, columns)
    per = counted.groupBy("column_name").agg(F.sum("n").alias("count"))
    best = stats.top_value(counted)
    return per.join(best, "column_name").select(
        "column_name", "count", F.col("distinct_count").alias("unique"), F.col("value").alias("top"), F.col("n").alias("freq")
    )


def mode_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of numeric columns, the smallest on ties."""
    best = stats.top_value(stats.value_counts(df, columns, as_numbers=True))
    return best.select("column_name", F.col("value").alias("mode"), F.col("n").alias("mode_count"))


def fences(df: DataFrame, columns: Sequence[str], counts: Mapping[str, int] | None = None) -> dict[str, tuple | None]:
    """Quartiles and Tukey fences: (q1, q3, lower, upper) per column."""
    q = stats.quantiles(df, {c: [0.25, 0.75] for c in columns}, counts)
    out: dict[str, tuple | None] = {}
    for c in columns:
        q1, q3 = q[c]
        out[c] = None if q1 is None else (q1, q3, q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
    return out


def outside(x: Column, limits: tuple | None) -> Column:
    if limits is None:
        return F.lit(False)
    return (x < limits[2]) | (x > limits[3])


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    with working_copy(df.select(*[col(c) for c in columns])) as held:
        limits = fences(held, columns)
    frame = _doubles(df, columns)
    none = F.lit(None).cast("double")
    return _long(
        frame,
        columns,
        {
            "q1": lambda c: F.max(F.lit(limits[c][0]) if limits[c] else none),
            "q3": lambda c: F.max(F.lit(limits[c][1]) if limits[c] else none),
            "lower_fence": lambda c: F.max(F.lit(limits[c][2]) if limits[c] else none),
            "upper_fence": lambda c: F.max(F.lit(limits[c][3]) if limits[c] else none),
            "outlier_count": lambda c: F.count_if(outside(col(c), limits[c])),
        },
    )


def sigma_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values more than three sample standard deviations from the mean; 0 for constant columns."""
    frame = _doubles(df, columns)
    got = stats.one_row(frame, {(c, k): f(col(c)) for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))})

    def count(c: str) -> Column:
        mean, std = got[(c, "m")], got[(c, "s")]
        if not std:
            return F.count_if(F.lit(False))
        return F.count_if(F.abs(col(c) - mean) > Z_LIMIT * std)

    return _long(frame, columns, {"outlier_count": count})


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    frame = _doubles(df, columns)
    n = lambda c: F.count(col(c)).cast("double")
    return _long(frame, columns, {"skewness": lambda c: stats.sample_skewness(n(c), F.skewness(col(c)))})


def kurtosis(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    frame = _doubles(df, columns)
    n = lambda c: F.count(col(c)).cast("double")
    return _long(frame, columns, {"kurtosis": lambda c: stats.sample_kurtosis(n(c), F.kurtosis(col(c)))})


def _g1(n: int, skew: float | None) -> float:
    if n <= 2 or skew is None or math.isnan(skew):
        return 0.0
    return skew * math.sqrt(n * (n - 1)) / (n - 2)


def _g2(n: int, kurt: float | None) -> float:
    if n <= 3 or kurt is None or math.isnan(kurt):
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)


def eda_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The full numeric profile, one row per column. A column without values has only its counts."""
    columns = list(columns)
    with working_copy(df.select(*[col(c) for c in columns])) as held:
        quarters = [0.25, 0.5, 0.75]
        m = stats.moments(held, columns, quarters)
        counts = {c: m[c].n for c in columns}
        q = stats.quantiles(held, {c: quarters for c in columns}, counts, sketches={c: m[c].sketch for c in columns})
        limits = {
            c: None if q1 is None else (q1, q3, q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
            for c, (q1, _, q3) in q.items()
        }
        # modes and outliers from one count of values
        counted = stats.value_counts(held, columns, as_numbers=True)
        odd = F.lit(False)
        for c in columns:
            if limits[c] is not None:
                odd = odd | ((F.col("column_name") == c) & outside(F.col("value"), limits[c]))
        rows_of = {r["column_name"]: r for r in stats.top_value(counted, odd).collect()}
        most = {c: r["value"] for c, r in rows_of.items()}
        outliers = {c: r["marked"] for c, r in rows_of.items()}
    rows = []
    for c in columns:
        s = m[c]
        pct = 100.0 * s.nulls / s.rows if s.rows else 0.0
        if s.n == 0:
            rows.append((c, s.rows, s.nulls, pct, *[None] * 11, 0))
            continue
        q1, q2, q3 = q[c]
        std = s.std if s.n > 1 else 0.0
        rows.append(
            (c, s.rows, s.nulls, pct, s.mean, q2, most[c], std, s.min, s.max, _g1(s.n, s.skew_pop), _g2(s.n, s.kurt_pop), q1, q3, q3 - q1, outliers[c])
        )
    schema = (
        "column_name string, total_count bigint, null_count bigint, null_percent double, mean double, median double, "
        "mode double, std double, min double, max double, skewness double, kurtosis double, q1 double, q3 double, "
        "iqr double, outlier_count bigint"
    )
    out = df.sparkSession.createDataFrame(rows, schema)
    four = ["mean", "median", "mode", "std", "min", "max", "skewness", "kurtosis", "q1", "q3", "iqr"]
    return out.select(
        *[F.round(c, 4).alias(c) if c in four else F.round(c, 2).alias(c) if c == "null_percent" else c for c in out.columns]
    )


def eda_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    best = stats.top_value(stats.value_counts(df, columns))
    nulls = null_profile(df, columns)
    return nulls.join(best, "column_name", "left").select(
        "column_name",
        F.col("total_rows").alias("total_count"),
        "null_count",
        "null_percent",
        F.coalesce("distinct_count", F.lit(0)).alias("unique_count"),
        F.col("value").alias("top_value"),
        F.coalesce("n", F.lit(0)).alias("top_count"),
    )


def insights(profile: DataFrame) -> DataFrame:
    """Advice derived from the output of :func:`eda_numeric`."""
    skew = F.abs("skewness")
    return profile.where(F.col("skewness").isNotNull()).select(
        "column_name",
        F.when((skew > 1) & (F.col("skewness") > 0), "highly skewed right")
        .when(skew > 1, "highly skewed left")
        .when(skew > 0.5, "moderately skewed")
        .otherwise("roughly symmetric")
        .alias("shape"),
        (F.col("null_percent") > 10).alias("consider_imputation"),
        (F.col("outlier_count") > 0).alias("has_outliers"),
        "outlier_count",
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present
    (pairwise deletion), i < j. Constant columns give NULL."""
    columns = list(columns)
    return _corr_long(_doubles(df, columns), columns, [(i, j) for j in range(len(columns)) for i in range(j)])


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full matrix in long form over the rows where every column is present (listwise deletion)."""
    columns = list(columns or numeric_columns(df))
    return _corr_long(_doubles(df, columns).dropna(), columns, [(i, j) for i in range(len(columns)) for j in range(len(columns))])


def _corr_long(frame: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    found = linalg.correlations(frame, columns)
    rows = [(columns[i], columns[j], None if np.isnan(found[i, j]) else float(found[i, j])) for i, j in pairs]
    return frame.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weights rows / (classes * rows of the class)."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = stats.one_row(counts, {"rows": F.sum("n"), "classes": F.count(F.lit(1))})
    share = F.lit(float(total["rows"] or 0)) / (F.lit(float(total["classes"] or 1)) * F.col("n"))
    return counts.select("class", "n", share.alias("weight"))


def owner_counts(df: DataFrame, owner: str, flags: Mapping[str, Column]) -> DataFrame:
    """Rows per owner, and how many of them satisfy each condition."""
    return df.groupBy(owner).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(cond).alias(name) for name, cond in flags.items()]
    )


def dataset_profile(df: DataFrame) -> dict:
    """All parts of the profile of one dataset. Small results as plain values,
    matrices and summaries as DataFrames."""
    kinds = column_kinds(df)
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    text = [c for c, k in kinds.items() if k in ("categorical", "boolean", "datetime")]
    flat = [c for c, k in kinds.items() if k != "nested"]
    return {
        "total_rows": df.count(),
        "column_names": df.columns,
        "data_types": {f.name: f.dataType.simpleString() for f in df.schema.fields},
        "kinds": {k: [c for c in df.columns if kinds[c] == k] for k in sorted(set(kinds.values()))},
        "missing_values": null_profile(df, flat),
        "duplicate_rows": duplicate_rows(df.select(*[col(c) for c in flat])),
        "unique_counts": unique_counts(df, flat),
        "correlation_matrix": correlation_matrix(df, numeric) if numeric else None,
        "describe_numeric": describe_numeric(df, numeric) if numeric else None,
        "describe_categorical": describe_categorical(df, text) if text else None,
        "sigma_outliers": sigma_outliers(df, numeric) if numeric else None,
        "skewness": skewness(df, numeric) if numeric else None,
    }


# --------------------------------------------------------------------------
# which algorithms suit a dataset

# fixed values: algorithms in ranking order for equal scores
ALGORITHMS = [
    "Linear Regression",
    "Ridge (L2)",
    "Lasso (L1)",
    "SVR",
    "KNN Regressor",
    "Logistic Regression",
    "SVC",
    "KNN Classifier",
    "Decision Tree",
    "Random Forest",
    "KMeans Clustering",
]

# fixed values: fact about the dataset, its value, points, and the algorithms that get them
ALGORITHM_POINTS: list[tuple[str, str, int, list[str]]] = [
    ("problem_type", "regression", 3, ["Linear Regression", "Ridge (L2)", "Lasso (L1)", "SVR", "KNN Regressor", "Decision Tree", "Random Forest"]),
    ("problem_type", "classification", 3, ["Logistic Regression", "SVC", "KNN Classifier", "Decision Tree", "Random Forest"]),
    ("problem_type", "clustering", 5, ["KMeans Clustering"]),
    ("linearity", "linear", 3, ["Linear Regression", "Logistic Regression"]),
    ("linearity", "linear", 2, ["Ridge (L2)", "Lasso (L1)"]),
    ("linearity", "non-linear", 3, ["Random Forest"]),
    ("linearity", "non-linear", 2, ["Decision Tree", "SVC"]),
    ("linearity", "non-linear", 1, ["KNN Classifier", "KNN Regressor"]),
    ("dataset_size", "small", 3, ["KNN Classifier", "KNN Regressor"]),
    ("dataset_size", "small", 2, ["SVC"]),
    ("dataset_size", "large", 3, ["Random Forest"]),
    ("dataset_size", "large", 2, ["Ridge (L2)", "Lasso (L1)"]),
    ("noise_level", "high", 4, ["Random Forest"]),
    ("noise_level", "high", 2, ["Ridge (L2)", "Lasso (L1)"]),
    ("noise_level", "low", 2, ["Linear Regression", "Logistic Regression"]),
    ("need_interpretability", "true", 3, ["Linear Regression", "Logistic Regression", "Decision Tree"]),
    ("feature_type", "mixed", 2, ["Decision Tree", "Random Forest"]),
    ("feature_type", "mixed", 1, ["KNN Classifier"]),
    ("class_balance", "imbalanced", 3, ["Random Forest"]),
    ("class_balance", "imbalanced", 2, ["SVC"]),
    ("speed_requirement", "fast", 2, ["Linear Regression", "Logistic Regression", "Decision Tree"]),
    ("n_features", "high", 3, ["Ridge (L2)", "Lasso (L1)"]),
    ("n_features", "high", 2, ["SVC"]),
]

# fixed values: answer when fewer than three algorithms score at all
FALLBACK_ALGORITHMS = ["Random Forest", "SVC", "Decision Tree"]


def algorithm_rules(spark: SparkSession) -> DataFrame:
    rows = [(feature, value, a, points, ALGORITHMS.index(a)) for feature, value, points, algos in ALGORITHM_POINTS for a in algos]
    return spark.createDataFrame(rows, "feature string, value string, algorithm string, points int, position int")


def dataset_facts(
    df: DataFrame,
    target: str | None = None,
    problem_type: str | None = None,
    linearity: str = "unknown",
    need_interpretability: bool = False,
    speed_requirement: str = "moderate",
) -> DataFrame:
    """Facts (feature, value) about a dataset, measured on all its rows.

    Sizes: under 10 000 rows small, over 100 000 large. Features: under 10 low, over 50
    high. Noise is the share of missing cells and fence outliers: up to 1 % low, over
    10 % high. Classes are imbalanced when the rarest has under half the rows of the
    most frequent one.
    """
    features = [f.name for f in df.schema.fields if f.name != target]
    numeric = [c for c in features if is_numeric(dtype_of(df, c), with_bool=False)]
    with working_copy(df) as held:
        limits = fences(held, numeric) if numeric else {}
        frame = nan_to_null(held)
        aggs: dict = {"rows": F.count(F.lit(1))}
        aggs.update({("null", c): F.count_if(col(c).isNull()) for c in features})
        aggs.update({("out", c): F.count_if(outside(col(c).cast("double"), limits[c])) for c in numeric})
        got = stats.one_row(frame, aggs)
    rows = got["rows"]
    cells = max(rows * len(features), 1)
    noise = sum(v for k, v in got.items() if isinstance(k, tuple)) / cells
    if problem_type is None:
        if target is None:
            problem_type = "clustering"
        else:
            problem_type = "regression" if is_continuous(df, target) else "classification"
    facts = {
        "problem_type": problem_type,
        "dataset_size": "small" if rows < 10_000 else "large" if rows > 100_000 else "medium",
        "feature_type": "numerical" if len(numeric) == len(features) else "categorical" if not numeric else "mixed",
        "noise_level": "low" if noise <= 0.01 else "high" if noise > 0.10 else "medium",
        "need_interpretability": str(need_interpretability).lower(),
        "linearity": linearity,
        "speed_requirement": speed_requirement,
        "n_features": "low" if len(features) < 10 else "high" if len(features) > 50 else "medium",
    }
    if problem_type == "classification" and target:
        per = nan_to_null(df).where(col(target).isNotNull()).groupBy(col(target)).count()
        sizes = per.agg(F.min("count").alias("lo"), F.max("count").alias("hi")).first()
        uneven = sizes["hi"] is not None and sizes["lo"] * 2 < sizes["hi"]
        facts["class_balance"] = "imbalanced" if uneven else "balanced"
    return df.sparkSession.createDataFrame(list(facts.items()), "feature string, value string")


def is_continuous(df: DataFrame, target: str) -> bool:
    """A fractional target with more than 20 distinct values."""
    if dtype_of(df, target).simpleString().split("(")[0] not in ("float", "double", "decimal"):
        return False
    return stats.distinct_counts(df, [target])[target] > 20


def algorithm_scores(facts: DataFrame) -> DataFrame:
    """All algorithms that score, best first. At most one row per known algorithm."""
    rules = F.broadcast(algorithm_rules(facts.sparkSession))
    return (
        facts.join(rules, ["feature", "value"])
        .groupBy("algorithm", "position")
        .agg(F.sum("points").cast("bigint").alias("score"))
    )


def algorithm_ranking(facts: DataFrame, k: int = 3) -> DataFrame:
    """The three best algorithms, or the fixed fallback when fewer score."""
    best = Window.orderBy(F.desc("score"), "position")  # one row per algorithm
    ranked = algorithm_scores(facts).withColumn("rank", F.row_number().over(best))
    picked = ranked.agg(F.collect_list(F.struct("rank", "algorithm")).alias("found"))
    fallback = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(a).alias("algorithm")) for i, a in enumerate(FALLBACK_ALGORITHMS)])
    chosen = F.when(F.size("found") < 3, fallback).otherwise(F.col("found"))
    return (
        picked.select(F.explode(chosen).alias("r"))
        .select(F.col("r.rank").cast("bigint").alias("rank"), F.col("r.algorithm").alias("algorithm"))
        .where(F.col("rank") <= k)
    )
