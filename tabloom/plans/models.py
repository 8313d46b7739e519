"""Fitted models behind one interface: ``transform``, ``save`` and ``load``."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.errors import TrainError
from tabloom.functions.lookup import lookup_join
from tabloom.operators.knn import classify, regress, votes
from tabloom.operators.neighbour_index import Metric, NeighbourIndex
from tabloom.plans.dual import KernelMachine, fit_classifier, fit_regressor, kernel_of
from tabloom.plans.features import FEATURES, with_features
from tabloom.plans.kernel import KernelMap, fit_map, fit_svr
from tabloom.plans.linear import fit_nonnegative
from tabloom.plans.trees import Rules, Trees, fit_trees
from tabloom.session import materialize
from tabloom.types import col

LABEL = "_label"
PARALLEL_CLASSES = 8  # one-vs-rest fits that run side by side
SVM_TOL = 1e-4


@dataclass
class KnnTable:
    """An index of the distinct training points with their copies: the whole of a neighbour model."""

    index: NeighbourIndex
    params: dict
    task: str

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for classes, ``_votes`` (label -> share). Equal feature
        vectors are searched once; results return by the vector's hash key."""
        p = self.params
        keyed = df.withColumn("_key", point_key(vector_to_array(FEATURES)))
        asked = keyed.groupBy("_key").agg(F.first(vector_to_array(FEATURES)).alias("vec"), F.count(F.lit(1)).alias("w"))
        asked = materialize(asked)
        found = self.index.nearest(asked.select(F.col("_key").alias("qid"), "vec"), p["n_neighbors"])
        if self.task == "classification":
            found = materialize(found)
            shares = votes(found, p["weights"])
            total = shares.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("label", "vote"))).alias("m"))
            one = classify(found, p["weights"]).select("qid", "prediction").join(total, "qid")
            answer = F.struct(F.col("prediction"), F.col("m"))
        else:
            one = regress(found, p["weights"])
            answer = F.struct(F.col("prediction"))
        per_key = one.join(asked.select(F.col("_key").alias("k"), "w"), F.col("qid") == F.col("k")).select("k", answer.alias("v"), "w")
        out = lookup_join(keyed, "_key", materialize(per_key), "k", "v", weight="w", into="_answer")
        out = out.withColumn("prediction", F.col("_answer")["prediction"])
        if self.task == "classification":
            out = out.withColumn("_votes", F.col("_answer")["m"])
        return out.drop("_key", "_answer")


def point_key(vector: Column) -> Column:
    """Two independent hashes of a feature vector."""
    return F.concat_ws("-", F.hex(F.xxhash64(vector, F.lit(1))), F.hex(F.xxhash64(vector, F.lit(2))))


@dataclass
class FittedModel:
    algorithm: str
    task: str
    target: str | None
    inputs: list[str]
    classes: list | None
    features: PipelineModel
    model: object
    params: dict = field(default_factory=dict)
    kernel: KernelMap | None = None
    svr: list[float] | None = None

    def featurize(self, df: DataFrame) -> DataFrame:
        lacking = [c for c in self.inputs if c not in df.columns]
        if lacking:
            raise TrainError(f"Input data schema mismatch: missing feature columns {lacking}. The model expects {self.inputs}.")
        out = with_features(self.features, df)
        return self.kernel.apply(out) if self.kernel else out

    def raw(self, df: DataFrame) -> DataFrame:
        """Adds the class index or value as ``prediction``, and ``_p`` (array) when the
        model gives class probabilities."""
        frame = self.featurize(df)
        if isinstance(self.model, KnnTable):
            out = self.model.predict(frame)
            if self.task == "classification":
                total = F.aggregate(F.map_values("_votes"), F.lit(0.0), lambda a, b: a + b)
                share = [F.coalesce(F.try_element_at("_votes", F.lit(float(i))), F.lit(0.0)) / total for i in range(len(self.classes))]
                out = out.withColumn("_p", F.array(*share)).drop("_votes")
            return out.drop(FEATURES)
        if isinstance(self.model, (KernelMachine, Trees)):
            return self.model.predict(frame).drop(FEATURES)
        if self.svr is not None:
            weights = np.array(self.svr)
            x = vector_to_array(FEATURES)
            products = F.zip_with(x, F.array(*[F.lit(float(v)) for v in weights[:-1]]), lambda a, b: a * b)
            value = F.aggregate(products, F.lit(float(weights[-1])), lambda a, b: a + b)
            return frame.withColumn("prediction", value).drop(FEATURES)
        out = self.model.transform(frame)
        if "probability" in out.columns:
            out = out.withColumn("_p", vector_to_array("probability"))
        return out.drop("probability", "rawPrediction", FEATURES)

    def transform(self, df: DataFrame) -> DataFrame:
        """The input columns plus ``prediction`` (a class as it appeared in the target)."""
        names = [c for c in df.columns if c != "prediction"]
        out = self.raw(df.select(*[col(c) for c in names]))
        value = F.col("prediction")
        if self.classes is not None:
            value = F.get(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int"))
        elif self.task == "clustering":
            value = value.cast("int")
        return out.select(*[col(c) for c in names], value.alias("prediction"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        meta = {
            "algorithm": self.algorithm, "task": self.task, "target": self.target, "inputs": self.inputs,
            "classes": self.classes, "params": self.params, "svr": self.svr,
            "kernel": asdict(self.kernel) if self.kernel else None, "kind": type(self.model).__name__,
        }
        if isinstance(self.model, KnnTable):
            self.model.index.save(f"{path}/points")
        elif isinstance(self.model, KernelMachine):
            self.model.save(f"{path}/machine")
        elif isinstance(self.model, Trees):
            self.model.save(spark, f"{path}/trees")
        elif self.model is not None:
            PipelineModel([self.model]).write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedModel":
        m = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        if m["kind"] == "KnnTable":
            model = KnnTable(NeighbourIndex.load(spark, f"{path}/points"), m["params"], m["task"])
        elif m["kind"] == "KernelMachine":
            model = KernelMachine.load(spark, f"{path}/machine")
        elif m["kind"] == "Trees":
            model = Trees.load(spark, f"{path}/trees")
        elif m["kind"] == "NoneType":
            model = None
        else:
            model = PipelineModel.load(f"{path}/model").stages[0]
        return cls(
            m["algorithm"], m["task"], m["target"], m["inputs"], m["classes"], PipelineModel.load(f"{path}/features"),
            model, m["params"], KernelMap(**m["kernel"]) if m["kernel"] else None, m["svr"],
        )


def _rules(p: dict, task: str, classes: int | None, seed: int) -> Rules:
    criterion = "gini" if p.get("criterion") in (None, "gini") else "entropy"
    return Rules(
        task, classes or 0, criterion, p.get("max_depth"), p.get("min_samples_split") or 2, p.get("min_samples_leaf") or 1,
        p.get("max_features"), bool(p.get("bootstrap")), seed,
    )


def fit_estimator(algorithm: str, task: str, data: DataFrame, p: dict, seed: int, n_classes: int | None) -> tuple:
    """(model, kernel map, svr weights) fitted on (features, label) rows."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    if algorithm == "LinearRegression":
        if p.get("positive"):
            return None, None, fit_nonnegative(data, LABEL, p["fit_intercept"])
        return LinearRegression(fitIntercept=p["fit_intercept"], **common).fit(data), None, None
    if algorithm in ("Ridge", "Lasso"):
        n = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(LABEL).alias("s")).first()
        ridge = algorithm == "Ridge"
        reg = p["alpha"] * (n["s"] or 0.0) / max(n["n"], 1) if ridge else p["alpha"]
        est = LinearRegression(
            regParam=reg, elasticNetParam=0.0 if ridge else 1.0, fitIntercept=p["fit_intercept"], standardization=False,
            solver="l-bfgs", maxIter=p["max_iter"] or 1000, tol=min(p["tol"], 1e-6), **common,
        )
        return est.fit(data), None, None
    if algorithm == "LogisticRegression":
        mix = {"l2": 0.0, "l1": 1.0, "elasticnet": p.get("l1_ratio") if p.get("l1_ratio") is not None else 0.5}
        penalty = p["penalty"]
        reg = 0.0 if penalty in (None, "none") else 1.0 / (p["C"] * max(data.count(), 1))
        est = LogisticRegression(
            regParam=reg, elasticNetParam=mix.get(penalty, 0.0), standardization=False, maxIter=p["max_iter"], **common
        )
        return est.fit(data), None, None
    if algorithm in ("DecisionTree", "DecisionTreeRegressor", "RandomForest", "RandomForestRegressor"):
        return fit_trees(data, LABEL, _rules(p, task, n_classes, seed), p.get("n_estimators") or 1), None, None
    if algorithm in ("KNeighborsClassifier", "KNeighborsRegressor"):
        points = data.select(vector_to_array(FEATURES).alias("vec"), F.col(LABEL).cast("double").alias("payload"))
        points = points.groupBy("vec", "payload").agg(F.count(F.lit(1)).alias("weight"))
        tid = F.concat_ws("-", point_key(F.col("vec")), F.col("payload").cast("string"))
        points = materialize(points.select(tid.alias("tid"), "vec", "weight", "payload"))
        return KnnTable(NeighbourIndex.build(points, Metric(p["metric"], float(p["p"]))), p, task), None, None
    if algorithm == "KMeans":
        best = None
        mode = "random" if p["init"] == "random" else "k-means||"
        for i in range(max(1, p["n_init"])):
            one = KMeans(k=p["n_clusters"], initMode=mode, maxIter=p["max_iter"], tol=p["tol"], seed=seed + i, featuresCol=FEATURES).fit(data)
            if best is None or one.summary.trainingCost < best.summary.trainingCost:
                best = one
        return best, None, None
    if algorithm == "SVC" and not p.get("landmarks"):
        balanced, probability = p.get("class_weight") == "balanced", bool(p.get("probability"))
        return fit_classifier(data, LABEL, n_classes, kernel_of(data, p), p["C"], balanced, probability), None, None
    if algorithm == "SVR" and not p.get("landmarks"):
        return fit_regressor(data, LABEL, kernel_of(data, p), p["C"], p["epsilon"]), None, None
    if algorithm == "SVC":
        mapped = None if p["kernel"] == "linear" else fit_map(data, p["kernel"], p["gamma"], p["degree"], int(p["landmarks"]))
        frame = mapped.apply(data) if mapped else data
        n = data.count()
        svc = LinearSVC(regParam=1.0 / (p["C"] * max(n, 1)), standardization=False, tol=SVM_TOL, **common)
        if p.get("class_weight") == "balanced":
            sizes = {r[LABEL]: r["count"] for r in data.groupBy(LABEL).count().collect()}
            weight = F.lit(1.0)
            for label, size in sizes.items():
                weight = F.when(F.col(LABEL) == label, n / (len(sizes) * size)).otherwise(weight)
            frame = frame.withColumn("_weight", weight)
            svc = svc.setWeightCol("_weight")
        if n_classes and n_classes > 2:
            est = OneVsRest(classifier=svc, parallelism=PARALLEL_CLASSES, **common)
            if "_weight" in frame.columns:
                est = est.setWeightCol("_weight")
            return est.fit(frame), mapped, None
        return svc.fit(frame), mapped, None
    if algorithm == "SVR":
        mapped = None if p["kernel"] == "linear" else fit_map(data, p["kernel"], p["gamma"], p["degree"], int(p["landmarks"]))
        frame = mapped.apply(data) if mapped else data
        return None, mapped, [float(v) for v in fit_svr(frame, LABEL, p["C"], p["epsilon"])]
    raise TrainError(f"Model '{algorithm}' is not supported.")
