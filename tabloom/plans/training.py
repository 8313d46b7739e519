"""Fit, evaluate, tune, compare and apply models."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.errors import TrainError
from tabloom.functions import stats
from tabloom.operators import cluster_metrics, metrics
from tabloom.operators.profile import drop_sparse_columns
from tabloom.operators.sampling import folds, sample_cap, train_test_split
from tabloom.plans import linear, registry, trees
from tabloom.plans.features import FEATURES, feature_columns, fit_features, with_features
from tabloom.plans.dual import KernelMachine
from tabloom.plans.models import LABEL, FittedModel, fit_estimator
from tabloom.session import plain_plans, working_copy
from tabloom.types import as_double, col, dtype_of, is_numeric, nan_to_null

MAX_CLASSES = 1000
TREES = ("DecisionTree", "DecisionTreeRegressor", "RandomForest", "RandomForestRegressor")
SHOWN = 10


@dataclass
class FitResult:
    model: FittedModel
    metrics: DataFrame
    comparison: DataFrame
    confusion: DataFrame | None = None

    def report(self) -> DataFrame:
        return metrics.metric_report(self.metrics, self.model.algorithm)

    def tables(self) -> dict[str, DataFrame]:
        """The small tables of a model report."""
        spark = self.metrics.sparkSession
        m = self.model
        info = {"algorithm": m.algorithm, "task": m.task, "target": str(m.target), "features": ",".join(m.inputs)}
        out = {
            "metrics": self.metrics,
            "hyperparameters": spark.createDataFrame([(k, str(v)) for k, v in m.params.items()] or [("-", "-")], "parameter string, value string"),
            "model_info": spark.createDataFrame(list(info.items()), "field string, value string"),
        }
        if self.confusion is not None:
            out["confusion_matrix"] = self.confusion
        return out


def _classes(df: DataFrame, target: str) -> list:
    found = [r[0] for r in df.select(col(target)).distinct().orderBy(col(target)).limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise TrainError(f"Target column '{target}' has more than {MAX_CLASSES} classes.")
    if len(found) < 2:
        raise TrainError(f"Target column '{target}' needs at least two classes.")
    return found


def with_label(df: DataFrame, target: str, classes: list | None) -> DataFrame:
    """The target as DOUBLE: the value itself, or the position among the sorted classes."""
    if classes is None:
        return df.withColumn(LABEL, as_double(df, target))
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target)) - 1
    return df.withColumn(LABEL, F.when(position >= 0, position).cast("double"))


def fit_model(
    df: DataFrame,
    algorithm: str,
    target: str | None = None,
    hyperparameters: Mapping[str, object] | None = None,
    key: Sequence[str] | None = None,
    seed: int = 42,
    exact_silhouette: bool = False,
    held_out: str | None = None,
) -> FitResult:
    """Split 80/20, learn features and model from the larger part, judge on the other.

    Rows with missing values are left out first. ``key`` names columns that identify a
    row; it makes the split a plain hash filter. ``held_out`` is an SQL condition that names the
    rows to judge on instead. ``exact_silhouette`` adds the silhouette over unsquared
    distances, which compares every pair of held-out rows.
    """
    task = registry.task_of(algorithm)
    params = registry.resolve(algorithm, hyperparameters)
    if task != "clustering" and (not target or target not in df.columns):
        raise TrainError(f"Target column '{target}' not found in dataset columns: {df.columns}")
    with plain_plans(df.sparkSession), working_copy(nan_to_null(df).dropna()) as clean:
        return _fit(clean, algorithm, task, target, params, key, seed, exact_silhouette, held_out)


def _fit(
    clean: DataFrame,
    algorithm: str,
    task: str,
    target: str | None,
    params: dict,
    key: Sequence[str] | None,
    seed: int,
    exact_silhouette: bool,
    held_out: str | None,
) -> FitResult:
    df = clean
    inputs_frame = clean.drop(*(key or []))
    numeric, text = feature_columns(inputs_frame, target if task != "clustering" else None)
    if held_out is None:
        train, test = train_test_split(clean, seed=seed, key=key)
    else:
        side = F.coalesce(F.expr(held_out), F.lit(False))
        train, test = clean.where(~side), clean.where(side)
    if not train.limit(1).count():
        raise TrainError("Dataset is empty after dropping missing values.")
    classes = _classes(clean, target) if task == "classification" else None
    if task == "regression" and not is_numeric(dtype_of(df, target)):
        raise TrainError(f"Target column '{target}' is not numeric.")
    stages = fit_features(train, numeric, text)
    data = with_features(stages, train)
    data = (with_label(data, target, classes).select(FEATURES, LABEL) if task != "clustering" else data.select(FEATURES)).persist()
    try:
        model, kernel, svr = fit_estimator(algorithm, task, data, params, seed, len(classes) if classes else None)
    finally:
        data.unpersist()
    fitted = FittedModel(algorithm, task, target if task != "clustering" else None, numeric + text, classes, stages, model, params, kernel, svr)
    return evaluate(fitted, test, exact_silhouette)


def evaluate(model: FittedModel, test: DataFrame, exact_silhouette: bool = False) -> FitResult:
    if model.task == "clustering":
        return _evaluate_clusters(model, test, exact_silhouette)
    scored = model.raw(with_label(nan_to_null(test), model.target, model.classes))
    kept = ["prediction", LABEL] + (["_p"] if "_p" in scored.columns else [])
    scored = scored.select(*kept).persist()
    try:
        if model.task == "regression":
            found = metrics.regression_metrics(scored, LABEL, "prediction", features=vector_width(model, test))
            values, confusion = metrics.metrics_dict(found), None
        else:
            values, confusion = _classification(model, scored)
        values.update(model_facts(model))
        shown = [(float(r[LABEL]), float(r["prediction"])) for r in scored.limit(SHOWN).collect()]
    finally:
        scored.unpersist()
    spark = test.sparkSession
    rows = [(k, None if v is None else float(v)) for k, v in values.items()]
    return FitResult(
        model,
        spark.createDataFrame(rows, "metric string, value double"),
        spark.createDataFrame(shown, "actual double, predicted double"),
        confusion,
    )


def vector_width(model: FittedModel, df: DataFrame) -> int:
    row = with_features(model.features, df).select(F.size(vector_to_array(FEATURES)).alias("n")).first()
    return row["n"] if row else 0


def _classification(model: FittedModel, scored: DataFrame) -> tuple[dict, DataFrame]:
    spark = scored.sparkSession
    values = metrics.metrics_dict(metrics.classification_metrics(scored, LABEL, "prediction"))
    present = sorted(r[0] for r in scored.select(LABEL).distinct().collect())
    cells = [(float(r["actual"]), float(r["predicted"]), r["n"]) for r in metrics.confusion_matrix(scored, LABEL, "prediction").collect()]
    name = lambda i: str(model.classes[int(i)])
    confusion = spark.createDataFrame([(name(a), name(p), n) for a, p, n in cells], "actual string, predicted string, n bigint")
    binary = len(present) == 2
    if binary:
        values.update(metrics.metrics_dict(metrics.binary_rates(scored, LABEL, "prediction", present[1])))
    if "_p" in scored.columns:
        spread = scored.select(LABEL, *[F.get("_p", F.lit(i)).alias(f"p{i}") for i in range(len(model.classes))])
        own = F.get(F.array(*[F.col(f"p{i}") for i in range(len(model.classes))]), F.col(LABEL).cast("int"))
        if binary:
            at = int(present[1])
            values["roc_auc"] = metrics.auc_value(spread, F.col(LABEL) == present[1], f"p{at}")
            values["brier_score"] = metrics.metrics_dict(
                metrics.probability_metrics(spread, F.col(LABEL) == present[1], f"p{at}", None)
            )["brier_score"]
        else:
            values["roc_auc"] = metrics.roc_auc_ovr(spread, LABEL, {p: f"p{int(p)}" for p in present})
        values["log_loss_val"] = spread.agg(metrics.log_loss(spread, own).alias("v")).first()["v"]
        for k in ("roc_auc", "brier_score", "log_loss_val"):
            if values.get(k) is not None:
                values[k] = round(values[k], 4)
    return values, confusion


def model_facts(model: FittedModel) -> dict[str, float]:
    m, out = model.model, {}
    if model.algorithm == "Lasso":
        out["non_zero_coefficients"] = m.coefficients.numNonzeros()
    if model.algorithm in ("DecisionTree", "DecisionTreeRegressor"):
        out["tree_depth"] = m.depth
    if model.algorithm in ("RandomForest", "RandomForestRegressor"):
        out["n_estimators"] = m.count
    if isinstance(m, KernelMachine):
        out["n_support_vectors"] = m.n_support
    return out


def _evaluate_clusters(model: FittedModel, test: DataFrame, exact_silhouette: bool) -> FitResult:
    scored = model.model.transform(model.featurize(test)).select(vector_to_array(FEATURES).alias("x"), F.col("prediction").alias("cluster"))
    width = vector_width(model, test)
    names = [f"x{i}" for i in range(width)]
    flat = scored.select("cluster", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)]).persist()
    try:
        parts = [cluster_metrics.calinski_harabasz(flat, names, "cluster"), cluster_metrics.davies_bouldin(flat, names, "cluster")]
        # the squared form is linear in the rows; the unsquared one needs every pair of them
        parts.append(cluster_metrics.silhouette_squared(flat, names, "cluster"))
        if exact_silhouette:
            parts.append(cluster_metrics.silhouette(flat, names, "cluster"))
        values = {}
        for p in parts:
            values.update({k: None if v is None else round(v, 4) for k, v in metrics.metrics_dict(p).items()})
        sizes = [(int(r["cluster"]), r["count"]) for r in cluster_metrics.cluster_sizes(flat, "cluster").collect()]
    finally:
        flat.unpersist()
    if model.model.hasSummary:
        values["inertia"] = round(float(model.model.summary.trainingCost), 2)
    values["n_clusters"] = float(model.params["n_clusters"])
    spark = test.sparkSession
    return FitResult(
        model,
        spark.createDataFrame(list(values.items()), "metric string, value double"),
        spark.createDataFrame(sorted(sizes), "cluster int, count bigint"),
    )


# --------------------------------------------------------------------------
# tuning


@dataclass
class TuneResult:
    best_params: dict
    best_score: float
    scoring: str
    scores: DataFrame


def tune(
    df: DataFrame,
    algorithm: str,
    target: str,
    candidates: Sequence[Mapping[str, object]] | None = None,
    key: Sequence[str] | None = None,
    k: int = 3,
    parallelism: int = 4,
    seed: int = 42,
) -> TuneResult:
    """Cross-validated search on the 80 % split: accuracy for classes, r2 otherwise.
    Features are one-hot without the first category and unscaled.

    Candidates share their passes where they can. The linear family needs the products of all
    pairs of features once per fold; candidates are solved from those of the other folds. Trees
    that differ only in depth, rows to split and number of trees are parts of one forest, which
    is grown once per fold. The scores are those of separate fits."""
    task = registry.task_of(algorithm)
    candidates = [dict(c) for c in (candidates or registry.grid(algorithm))]
    if task == "clustering":
        raise TrainError(f"Auto-Tune is not supported for clustering models like '{algorithm}'.")
    with plain_plans(df.sparkSession), working_copy(nan_to_null(df).dropna()) as clean:
        return _tune(clean, algorithm, task, target, candidates, key, k, parallelism, seed)


def _tune(clean, algorithm, task, target, candidates, key, k, parallelism, seed) -> TuneResult:
    df = clean
    numeric, text = feature_columns(clean.drop(*(key or [])), target)
    train, _ = train_test_split(clean, seed=seed, key=key)
    classes = _classes(clean, target) if task == "classification" else None
    stages = fit_features(train, numeric, text, scale=False, drop_first=True)
    data = with_label(with_features(stages, folds(train, k, seed + 1, key)), target, classes).select(FEATURES, LABEL, "fold").persist()

    params = [registry.resolve(algorithm, c) for c in candidates]

    def judged(model: FittedModel, fold: int) -> float:
        held = model.raw(data.where(F.col("fold") == fold).select(FEATURES, LABEL))
        if task == "classification":
            return held.agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]
        e = F.col(LABEL) - F.col("prediction")
        got = held.agg(F.sum(e * e).alias("s"), (F.var_pop(LABEL) * F.count(F.lit(1))).alias("t")).first()
        return 1 - got["s"] / got["t"]

    def one(job: tuple[list[int], int]) -> list[float]:
        (at,), fold = job
        part = data.where(F.col("fold") != fold).select(FEATURES, LABEL)
        model, kernel, svr = fit_estimator(algorithm, task, part, params[at], seed, len(classes) if classes else None)
        return [judged(FittedModel(algorithm, task, target, [], classes, _NoStages(), model, params[at], kernel, svr), fold)]

    def forest(job: tuple[list[int], int]) -> list[float]:
        members, fold = job
        part = data.where(F.col("fold") != fold).select(FEATURES, LABEL)
        count = lambda i: params[i].get("n_estimators") or 1
        loosest = {**params[members[0]], "max_depth": None, "min_samples_split": 2, "n_estimators": max(map(count, members))}
        if all(params[i].get("max_depth") is not None for i in members):
            loosest["max_depth"] = max(params[i]["max_depth"] for i in members)
        loosest["min_samples_split"] = min(params[i].get("min_samples_split") or 2 for i in members)
        whole, _, _ = fit_estimator(algorithm, task, part, loosest, seed, len(classes) if classes else None)
        cut = [whole.stopped(params[i].get("max_depth"), params[i].get("min_samples_split") or 2, count(i)) for i in members]
        return trees.scores(cut, data.where(F.col("fold") == fold), LABEL)

    jobs = [([i], f) for i in range(len(candidates)) for f in range(k)]
    work = one
    if algorithm in TREES:
        groups: dict[tuple, list[int]] = {}
        for i, p in enumerate(params):
            shared = {n: v for n, v in p.items() if n not in ("max_depth", "min_samples_split", "n_estimators")}
            groups.setdefault(tuple(sorted((n, str(v)) for n, v in shared.items())), []).append(i)
        jobs = [(members, f) for members in groups.values() for f in range(k)]
        work = forest
    found = [0.0] * (len(candidates) * k)
    try:
        if algorithm in ("LinearRegression", "Ridge", "Lasso"):
            shift, totals = linear.raw_products(data, LABEL, "fold")
            for i, p in enumerate(params):
                for f in range(k):
                    weights = linear.solved(algorithm, p, sum(t for g, t in totals.items() if g != f), shift)
                    found[i * k + f] = float(linear.explained(weights, totals[f], shift))
        else:
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                for (members, f), values in zip(jobs, pool.map(work, jobs)):
                    for i, value in zip(members, values):
                        found[i * k + f] = value
    finally:
        data.unpersist()
    means = [sum(found[i * k : (i + 1) * k]) / k for i in range(len(candidates))]
    best = max(range(len(means)), key=lambda i: means[i])
    scores = df.sparkSession.createDataFrame(
        [(i, str(c), m) for i, (c, m) in enumerate(zip(candidates, means))], "candidate int, params string, score double"
    )
    return TuneResult(candidates[best], round(means[best], 4), "accuracy" if task == "classification" else "r2", scores)


class _NoStages:
    """Stands in for feature stages when the rows already carry their vector."""

    stages: list = []

    def transform(self, df: DataFrame) -> DataFrame:
        return df


# --------------------------------------------------------------------------
# comparison

# fixed values: the compared classifiers and their settings
COMPARED = {
    "Logistic Regression": ("LogisticRegression", {"max_iter": 1000}),
    "Decision Tree": ("DecisionTree", {"max_depth": 10}),
    "Random Forest": ("RandomForest", {"n_estimators": 50, "max_depth": 10}),
    "KNN Classifier": ("KNeighborsClassifier", {"n_neighbors": 5}),
    "SVC": ("SVC", {"probability": True}),
}


def compare_models(
    df: DataFrame,
    target: str | None = None,
    key: Sequence[str] | None = None,
    rows: int | None = None,
    names: Sequence[str] | None = None,
    compat: bool = False,
    parallelism: int = 5,
    seed: int = 42,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(one row per classifier, ROC curves of a binary target).

    The target is the last column unless named. Models learn from the whole training part, unless ``rows`` asks for
    a random sample of so many; every held-out row is scored. By default everything is learned from the training
    part; ``compat`` fits the feature preparation on all rows, as a quick look would.
    """
    spark = df.sparkSession
    target = target or df.columns[-1]
    frame = nan_to_null(df)
    label = F.coalesce(col(target).cast("string"), F.lit("nan"))
    frame = frame.withColumn(target, label)
    features = [c for c in frame.columns if c != target and c not in (key or [])]
    kept = drop_sparse_columns(frame.select(*[col(c) for c in features]))
    frame = frame.select(*[col(c) for c in kept.columns], *[col(k) for k in key or () if k not in kept.columns], col(target))
    numeric, text = feature_columns(kept, None)
    classes = _classes(frame, target)
    train, test = train_test_split(frame, seed=seed, key=key)
    if rows is not None:
        train = sample_cap(train, rows, seed, key)
    basis = frame if compat else train
    stages = fit_comparison_features(basis, numeric, text)
    prepared = lambda part: with_label(stages(part), target, classes).select(FEATURES, LABEL)
    data, held = prepared(train).persist(), prepared(test).persist()

    def run(name: str) -> dict:
        algorithm, given = COMPARED[name]
        out: dict = {"model": name}
        try:
            params = registry.resolve(algorithm, given)
            start = time.time()
            model, kernel, svr = fit_estimator(algorithm, "classification", data, params, seed, len(classes))
            out["training_time"] = round(time.time() - start, 4)
            fitted = FittedModel(algorithm, "classification", target, [], classes, _NoStages(), model, params, kernel, svr)
            scored = fitted.raw(held)
            scored = scored.select("prediction", LABEL, *(["_p"] if "_p" in scored.columns else [])).persist()
            got = metrics.metrics_dict(metrics.classification_metrics(scored, LABEL, "prediction"))
            out.update({k: got[k] for k in ("accuracy", "precision", "recall")}, f1=got["f1_score"])
            if len(classes) == 2 and "_p" in scored.columns:
                flat = scored.select(LABEL, F.get("_p", F.lit(1)).alias("p"))
                auc = metrics.auc_value(flat, F.col(LABEL) == 1.0, "p")
                out["roc_auc"] = None if auc is None else round(auc, 4)
                out["roc"] = metrics.roc_curve(flat, F.col(LABEL) == 1.0, "p")
        except Exception as e:  # a failing model must not take the others with it
            out["error"] = f"{type(e).__name__}: {str(e)[:500]}"
        return out

    results = []
    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            results = list(pool.map(run, list(names or COMPARED)))
    finally:
        data.unpersist()
        if not any(r.get("roc") is not None for r in results):  # curves are read from these rows later
            held.unpersist()
    fields = ["model", "accuracy", "precision", "recall", "f1", "roc_auc", "training_time", "error"]
    schema = "model string, accuracy double, precision double, recall double, f1 double, roc_auc double, training_time double, error string"
    table = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in results], schema)
    return table, {r["model"]: r["roc"] for r in results if r.get("roc") is not None}


def fit_comparison_features(basis: DataFrame, numeric: Sequence[str], text: Sequence[str]):
    """Median fill and standardisation for numbers, position in sorted order for text.
    Returns a function that turns rows into vectors; categories not in ``basis`` get -1."""
    from pyspark.ml.feature import VectorAssembler

    from tabloom.operators.encode import fit_label

    step = fit_label(basis, text) if text else None
    m = stats.moments(basis, numeric) if numeric else {}
    q = stats.quantiles(basis, {c: [0.5] for c in numeric}, {c: m[c].n for c in numeric}) if numeric else {}
    filled = basis.select(*[F.coalesce(as_double(basis, c), F.lit(q[c][0] or 0.0)).alias(c) for c in numeric]) if numeric else None
    s = stats.moments(filled, numeric) if numeric else {}

    def apply(df: DataFrame) -> DataFrame:
        out = step.apply(df) if step else df
        cells = [
            ((F.coalesce(as_double(df, c), F.lit(q[c][0] or 0.0)) - (s[c].mean or 0.0)) / (s[c].std_pop or 1.0)).alias(f"_n{i}")
            for i, c in enumerate(numeric)
        ] + [F.coalesce(col(c).cast("double"), F.lit(-1.0)).alias(f"_t{i}") for i, c in enumerate(text)]
        names = [f"_n{i}" for i in range(len(numeric))] + [f"_t{i}" for i in range(len(text))]
        out = out.select("*", *cells)
        return VectorAssembler(inputCols=names, outputCol=FEATURES).transform(out).drop(*names)

    return apply


# --------------------------------------------------------------------------
# applying a model


def score(model: FittedModel, df: DataFrame) -> DataFrame:
    """Every row of the dataset with a ``Prediction``; a target column is not looked at."""
    return model.transform(df).withColumnRenamed("prediction", "Prediction")


def score_json(model: FittedModel, spark: SparkSession, path: str, schema) -> DataFrame:
    """Predictions for JSON records, one object per line or arrays of objects."""
    from tabloom.sources.readers import read_json

    return score(model, read_json(spark, path, schema))
