"""Fitting, tuning, comparing and applying models on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import metrics
from tabloom.plans import training
from tabloom.plans.models import FittedModel
from tabloom.queries.common import QueryMap, embedding_dims, labelled_documents, table
from tabloom.session import scratch_path
from tabloom.sources import writers

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")


def _docs(spark, sf):
    return labelled_documents(spark, sf).drop("toxic").select("doc_id", "n_chars", "text_len", "n_spaces", "lang", "quality")


def _vectors(spark, sf):
    return embedding_dims(spark, sf, 8, "vec_id", "label")


def _price(algorithm, **params):
    return lambda s, d: training.fit_model(_lines(s, d), algorithm, "l_extendedprice", params, LINE_KEY).metrics


def _quality(algorithm, **params):
    return lambda s, d: training.fit_model(_docs(s, d), algorithm, "quality", params, ["doc_id"]).metrics


def _label(algorithm, **params):
    return lambda s, d: training.fit_model(_vectors(s, d), algorithm, "label", params, ["vec_id"]).metrics


def _clusters(spark, sf):
    df = _vectors(spark, sf).drop("label")
    return training.fit_model(df, "KMeans", None, {"n_clusters": 10, "n_init": 2, "max_iter": 50}, ["vec_id"]).metrics


def _sizes_regression(algorithm, **params):
    def run(spark, sf):
        df = labelled_documents(spark, sf).select("doc_id", "n_chars", "n_spaces", "text_len")
        return training.fit_model(df, algorithm, "n_spaces", params, ["doc_id"]).metrics

    return run


def _score(spark, sf):
    """Fit, store, load and apply: a prediction for every line."""
    df = _lines(spark, sf)
    fitted = training.fit_model(df, "LinearRegression", "l_extendedprice", key=LINE_KEY).model
    path = scratch_path(spark, "model")
    fitted.save(spark, path)
    out = training.score(FittedModel.load(spark, path), df)
    return out.select(*LINE_KEY, F.round("Prediction", 2).alias("prediction"))


def _score_json(spark, sf):
    df = _docs(spark, sf)
    fitted = training.fit_model(df, "LogisticRegression", "quality", key=["doc_id"]).model
    path = scratch_path(spark, "records")
    writers.save(df.drop("quality"), path, "json")
    out = training.score_json(fitted, spark, path, df.drop("quality").schema)
    return out.select("doc_id", "Prediction")


def _tune(spark, sf):
    grid = [{"max_depth": 3}, {"max_depth": 6}, {"max_depth": 6, "criterion": "entropy"}]
    return training.tune(_docs(spark, sf), "DecisionTree", "quality", grid, ["doc_id"]).scores


def _compare(spark, sf):
    table_, _ = training.compare_models(_docs(spark, sf), "quality", ["doc_id"])
    return metrics.leaderboard(table_).drop("training_time")


def _report(spark, sf):
    df = _docs(spark, sf)
    return training.fit_model(df, "LogisticRegression", "quality", key=["doc_id"]).report()


QUERIES: QueryMap = {
    "fit_linear": _price("LinearRegression"),
    "fit_ridge": _price("Ridge", alpha=10.0),
    "fit_lasso": _price("Lasso", alpha=1.0),
    "fit_tree_regressor": _price("DecisionTreeRegressor", max_depth=6),
    "fit_forest_regressor": _price("RandomForestRegressor", n_estimators=10, max_depth=6, max_features=None),
    "fit_logistic": _quality("LogisticRegression"),
    "fit_tree": _quality("DecisionTree", max_depth=6),
    "fit_forest": _quality("RandomForest", n_estimators=20, max_depth=6),
    "fit_knn_classifier": _label("KNeighborsClassifier"),
    "fit_knn_regressor": _sizes_regression("KNeighborsRegressor", weights="distance"),
    "fit_kmeans": _clusters,
    "fit_svc_linear": _quality("SVC", kernel="linear", class_weight="balanced"),
    "fit_svc": _label("SVC"),
    "fit_svr": _sizes_regression("SVR", kernel="rbf", C=10.0),
    "tune_tree": _tune,
    "compare_models": _compare,
    "model_report": _report,
    "score_dataset": _score,
    "score_json": _score_json,
}

ORACLES: dict[str, str] = {}
