from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import session
from tabloom.errors import TrainError
from tabloom.operators import cluster_metrics, metrics
from tabloom.plans import models, registry, training
from tabloom.plans.models import FittedModel
from tabloom.session import scratch_path
from tabloom.sources import writers


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    group = rng.integers(0, 3, 400)
    y = 3 * x[:, 0] - 2 * x[:, 1] + group + rng.normal(0, 0.1, 400)
    rows = [(i, float(a), float(b), f"g{g}", float(t), "yes" if t > 1 else "no") for i, ((a, b), g, t) in enumerate(zip(x, group, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, g string, y double, c string")


def test_linear_models(lines):
    df = lines.drop("c")
    plain = metrics.metrics_dict(training.fit_model(df, "LinearRegression", "y", key=["id"]).metrics)
    assert plain["r2_score"] > 0.99
    lasso = metrics.metrics_dict(training.fit_model(df, "Lasso", "y", {"alpha": "0.5"}, ["id"]).metrics)
    assert 0 < lasso["non_zero_coefficients"] < 5 and lasso["r2_score"] < plain["r2_score"]


def test_ridge_equals_its_closed_form(spark, lines):
    df = lines.select("id", "a", "b", "y")
    fitted = training.fit_model(df, "Ridge", "y", {"alpha": 25.0}, ["id"]).model
    train, _ = training.train_test_split(df, key=["id"])
    pdf = train.toPandas()
    x = pdf[["a", "b"]].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    t = pdf["y"].to_numpy()
    want = np.linalg.solve(x.T @ x + 25.0 * np.eye(2), x.T @ (t - t.mean()))
    np.testing.assert_allclose(fitted.model.coefficients.toArray(), want, rtol=1e-3)


@pytest.mark.parametrize("algorithm,params", [
    ("LogisticRegression", {}), ("DecisionTree", {"max_depth": 5}), ("RandomForest", {"n_estimators": 8, "max_depth": 5}),
    ("KNeighborsClassifier", {"weights": "distance"}), ("SVC", {"kernel": "linear"}),
])
def test_classifiers_save_and_load(spark, lines, algorithm, params):
    result = training.fit_model(lines.drop("y"), algorithm, "c", params, ["id"])
    got = metrics.metrics_dict(result.metrics)
    assert got["accuracy"] > 0.85 and "mcc" in got and "specificity" in got
    assert result.report().count() > 3 and result.comparison.count() == 10
    path = scratch_path(spark, "model")
    result.model.save(spark, path)
    loaded = FittedModel.load(spark, path)
    later = spark.createDataFrame([(9, 2.0, -2.0, "unseen"), (8, -2.0, None, None)], "id int, a double, b double, g string")
    out = {r["id"]: r["Prediction"] for r in training.score(loaded, later).collect()}
    assert out == {r["id"]: r["prediction"] for r in result.model.transform(later).collect()}
    assert out[9] == "yes" and out[8] in ("yes", "no")


def test_report_tables_are_written(spark, lines):
    result = training.fit_model(lines.drop("y"), "DecisionTree", "c", {"max_depth": 3}, ["id"])
    paths = writers.save_report(result.tables(), scratch_path(spark, "report"), "csv")
    assert set(paths) == {"metrics", "hyperparameters", "model_info", "confusion_matrix"}
    confusion = spark.read.option("header", True).csv(paths["confusion_matrix"])
    assert confusion.count() == 4 and set(confusion.columns) == {"actual", "predicted", "n"}


def test_missing_columns_are_named(spark, lines):
    model = training.fit_model(lines.drop("y", "g"), "LogisticRegression", "c", key=["id"]).model
    with pytest.raises(TrainError, match=r"\['b'\]"):
        model.transform(spark.createDataFrame([(1.0,)], "a double"))


def test_kernel_machines(lines):
    ring = lines.withColumn("c", F.when(F.col("a") ** 2 + F.col("b") ** 2 < 1.2, "in").otherwise("out")).select("id", "a", "b", "c")
    got = metrics.metrics_dict(training.fit_model(ring, "SVC", "c", {"kernel": "rbf", "C": 10.0}, ["id"]).metrics)
    assert got["accuracy"] > 0.9
    svr = metrics.metrics_dict(training.fit_model(lines.drop("c"), "SVR", "y", {"kernel": "linear"}, ["id"]).metrics)
    assert svr["r2_score"] > 0.98
    knn = metrics.metrics_dict(training.fit_model(lines.drop("c"), "KNeighborsRegressor", "y", key=["id"]).metrics)
    assert knn["r2_score"] > 0.8


def test_clusters(spark, rng):
    x = np.concatenate([rng.normal(c, 0.2, size=(60, 2)) for c in (0, 4, 8)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double")
    result = training.fit_model(df, "KMeans", None, {"n_clusters": 3, "n_init": 3}, ["id"])
    got = metrics.metrics_dict(result.metrics)
    assert got["silhouette_squared"] > 0.8 and got["n_clusters"] == 3 and result.comparison.count() == 3


def silhouette(x, c, squared):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = d if squared else np.sqrt(d)
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][c == k].mean() for k in set(c) if k != c[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes_match_brute_force(spark, rng):
    x = np.concatenate([rng.normal(size=(70, 3)), np.zeros((30, 3)), [[9.0, 9.0, 9.0]]])
    c = np.concatenate([rng.integers(0, 3, 100), [7]])
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, c)], "x double, y double, z double, c int")
    exact = cluster_metrics.silhouette(df, ["x", "y", "z"], "c", block_rows=17).first()["value"]
    assert exact == pytest.approx(silhouette(x, c, False))
    assert cluster_metrics.silhouette_squared(df, ["x", "y", "z"], "c").first()["value"] == pytest.approx(silhouette(x, c, True))


def davies_bouldin(x, c):
    names = sorted(set(c))
    m = {k: x[c == k].mean(axis=0) for k in names}
    s = {k: np.sqrt(((x[c == k] - m[k]) ** 2).sum(axis=1)).mean() for k in names}
    return np.mean([max((s[a] + s[b]) / np.sqrt(((m[a] - m[b]) ** 2).sum()) for b in names if b != a) for a in names])


def test_many_clusters_in_blocks_and_tiles(spark, rng):
    x = np.concatenate([rng.normal(size=(120, 3)), np.ones((40, 3)) * 5])
    c = np.concatenate([rng.integers(0, 23, 120), np.full(40, 30)])
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, c)], "x double, y double, z double, c int").repartition(4)
    for block in (3, 2048):
        got = cluster_metrics.davies_bouldin(df, ["x", "y", "z"], "c", block_rows=block).first()["value"]
        assert got == pytest.approx(davies_bouldin(x, c))
    for tile in (4, 512):
        got = cluster_metrics.silhouette_squared(df, ["x", "y", "z"], "c", tile=tile).first()["value"]
        assert got == pytest.approx(silhouette(x, c, True))


def test_candidates_that_share_passes_score_as_separate_fits(spark, lines):
    df = lines.drop("y")
    grid = [{"max_depth": d, "min_samples_split": s, "criterion": g} for d in (None, 2) for s in (2, 30) for g in ("gini", "entropy")]
    together = [r["score"] for r in training.tune(df, "DecisionTree", "c", grid, ["id"]).scores.orderBy("candidate").collect()]
    apart = [training.tune(df, "DecisionTree", "c", [g], ["id"]).scores.first()["score"] for g in grid[:4]]
    assert together[:4] == pytest.approx(apart) and len(set(together)) > 1
    forest = [{"n_estimators": n, "max_depth": d} for n in (3, 5) for d in (None, 3)]
    together = [r["score"] for r in training.tune(df, "RandomForest", "c", forest, ["id"]).scores.orderBy("candidate").collect()]
    apart = [training.tune(df, "RandomForest", "c", [g], ["id"]).scores.first()["score"] for g in forest[:2]]
    assert together[:2] == pytest.approx(apart)


@pytest.mark.parametrize("algorithm,params", [("Ridge", {"alpha": 30.0}), ("LinearRegression", {"fit_intercept": False}), ("Lasso", {"alpha": 0.2})])
def test_linear_candidates_are_solved_from_fold_products(spark, lines, algorithm, params):
    df = lines.select("id", "a", "b", "y")
    result = training.tune(df, algorithm, "y", [params, {"fit_intercept": True}], ["id"])
    train, _ = training.train_test_split(df, seed=42, key=["id"])
    held = training.folds(train, 3, 43, ["id"]).toPandas()
    scores = []
    for f in range(3):
        a, b = held[held["fold"] != f], held[held["fold"] == f]
        x, t = a[["a", "b"]].to_numpy(), a["y"].to_numpy()
        mean, top = (x.mean(axis=0), t.mean()) if params.get("fit_intercept", True) else (np.zeros(2), 0.0)
        x, t = x - mean, t - top
        if algorithm == "Lasso":
            w = np.zeros(2)
            for _ in range(500):
                for j in range(2):
                    pull = x[:, j] @ (t - x @ w + x[:, j] * w[j]) / len(t)
                    w[j] = np.sign(pull) * max(abs(pull) - params["alpha"], 0) / (x[:, j] @ x[:, j] / len(t))
        else:
            w = np.linalg.solve(x.T @ x + params.get("alpha", 0.0) * np.eye(2), x.T @ t)
        left = b["y"].to_numpy() - top - (b[["a", "b"]].to_numpy() - mean) @ w
        scores.append(1 - (left**2).sum() / ((b["y"] - b["y"].mean()) ** 2).sum())
    assert result.scores.orderBy("candidate").first()["score"] == pytest.approx(np.mean(scores), rel=1e-6)


def test_metrics_of_awkward_predictions(spark):
    one = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    got = metrics.metrics_dict(metrics.classification_metrics(one, "y", "p"))
    assert got["accuracy"] == 1 and got["mcc"] == 0 and got["cohen_kappa"] is None
    assert metrics.auc_value(one, F.col("y") == 1, "p") is None
    never = spark.createDataFrame([(0, 0), (1, 0), (2, 3)], "y int, p int")
    m = metrics.confusion_matrix(never, "y", "p")
    assert m.count() == 16 and m.agg(F.sum("n")).first()[0] == 3


def test_auc_with_ties_over_ranges(spark, rng):
    y, p = rng.integers(0, 2, 600), np.round(rng.random(600), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    for ranges in (1, 6):
        assert metrics.auc_value(df, F.col("y") == 1, "p", ranges) == pytest.approx(want)
        curve = metrics.roc_curve(df, F.col("y") == 1, "p", ranges).orderBy("tp", "fp").collect()
        assert curve[-1]["tp"] == len(pos) and curve[-1]["fp"] == len(neg)


def test_registry():
    assert registry.resolve("LogisticRegression", {"C": "0.5", "penalty": "None"})["C"] == 0.5
    assert registry.resolve("RandomForest", {"bootstrap": "false"})["bootstrap"] is False
    with pytest.raises(TrainError, match="not a int"):
        registry.resolve("KMeans", {"n_clusters": "many"})
    with pytest.raises(TrainError, match="not supported"):
        registry.resolve("Nothing", {})
    with pytest.raises(TrainError, match="clustering"):
        registry.grid("KMeans")
    assert len(registry.grid("Ridge")) == 14 and len(registry.grid("RandomForest")) == 324


def test_tuning_prefers_the_better_candidate(lines):
    grid = [{"max_depth": 1}, {"max_depth": 5}]
    result = training.tune(lines.drop("y"), "DecisionTree", "c", grid, ["id"])
    assert result.best_params == {"max_depth": 5} and result.scoring == "accuracy"
    with pytest.raises(TrainError, match="clustering"):
        training.tune(lines, "KMeans", "c")


def test_comparison_isolates_failures(lines, monkeypatch):
    original = training.fit_estimator

    def sometimes(algorithm, *args):
        if algorithm == "SVC":
            raise ValueError("no")
        return original(algorithm, *args)

    monkeypatch.setattr(training, "fit_estimator", sometimes)
    table, curves = training.compare_models(lines.drop("y"), "c", ["id"])
    rows = {r["model"]: r for r in table.collect()}
    assert "no" in rows["SVC"]["error"] and rows["KNN Classifier"]["accuracy"] > 0.8
    assert "Logistic Regression" in curves
    board = metrics.leaderboard(table)
    assert board.count() == 4 and board.where("is_best").count() == 1


def test_comparison_learns_from_every_training_row(spark, monkeypatch):
    df = spark.range(14_000).selectExpr("id", "cast(id % 97 as double) AS a", "CASE WHEN id % 97 > 40 THEN 'x' ELSE 'y' END AS c")
    learned = []

    def counted(algorithm, task, data, *rest):
        learned.append(data.count())
        raise ValueError("enough")

    monkeypatch.setattr(training, "fit_estimator", counted)
    training.compare_models(df, "c", ["id"], names=["Decision Tree"])
    assert learned == [training.train_test_split(df, key=["id"])[0].count()] and learned[0] > 10_000


def test_wide_frames_are_planned_without_derived_facts(spark, rng, monkeypatch):
    """A frame too large to be cached, with dozens of columns: its plans must not fill the driver."""
    from tabloom import session

    seen, original = [], models.materialize
    monkeypatch.setattr(models, "materialize", lambda df: (seen.append(df.sparkSession.conf.get(session.FACTS)), original(df))[1])
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    fit = training.fit_model(df, "KNeighborsRegressor", "y", key=["k"], held_out="k % 5 = 0")
    assert seen and set(seen) == {"false"} and spark.conf.get(session.FACTS) == "true"
    assert fit.metrics.count() > 0
    with session.plain_plans(spark):
        with pytest.raises(ValueError), session.plain_plans(spark):
            raise ValueError
        assert spark.conf.get(session.FACTS) == "false"
    assert spark.conf.get(session.FACTS) == "true"


def test_a_fit_scans_files_in_small_pieces(spark, tmp_path, monkeypatch):
    """A task that scans much reads as many feature vectors in every pass of a fit."""
    path = str(tmp_path / "rows")
    spark.range(200_000).selectExpr("id", "rand(1) AS x").coalesce(1).write.option("parquet.block.size", 1 << 16).parquet(path)
    monkeypatch.setattr(session, "SCAN_BYTES", 1 << 18)
    before = spark.conf.get(session.SCAN)
    pieces = spark.read.parquet(path).rdd.getNumPartitions()
    with session.plain_plans(spark):
        with session.plain_plans(spark):
            assert spark.read.parquet(path).rdd.getNumPartitions() > pieces
        assert spark.read.parquet(path).rdd.getNumPartitions() > pieces
    assert spark.conf.get(session.SCAN) == before
    assert [session._bytes(v) for v in ("128MB", "64m", "1000b", "7")] == [128 << 20, 64 << 20, 1000, 7]


def test_exact_silhouette_keeps_its_digits_far_from_the_origin_and_reports_large_blocks(spark, rng):
    x = rng.normal(size=(60, 3)) * 1e-2 + 1e6
    x[:5] = x[0]
    c = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(*map(float, row), int(k)) for row, k in zip(x, c)], "x double, y double, z double, c int")
    for rows in (None, 7):
        assert cluster_metrics.silhouette(df, ["x", "y", "z"], "c", rows).first()["value"] == pytest.approx(silhouette(x, c, False), abs=1e-6)
    near = rng.normal(size=(2, 50)) + np.zeros((4, 1, 1))
    a = near.reshape(8, 50)
    want = np.sqrt(np.square(a[:, None] - a[None]).sum(2))
    assert np.allclose(cluster_metrics._reach(a, a), want, rtol=1e-9, atol=0)
    # a point is reported once per block: three blocks of the old size are few tasks, a hundred are too many rows
    assert cluster_metrics.LARGE_BLOCK >= 4 * cluster_metrics.BLOCK_ROWS


def test_a_working_copy_has_more_partitions_the_larger_it_is(spark, monkeypatch):
    df = spark.range(50_000).repartition(2)
    cores = spark.sparkContext.defaultParallelism
    with session.working_copy(df) as kept:
        assert kept.rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "COPY_BYTES", 10_000)
    with session.working_copy(df) as kept:
        assert kept.rdd.getNumPartitions() == 40 and kept.count() == 50_000


def test_joined_inputs_are_joined_once(spark, monkeypatch):
    """The estimate of a join is far above its size, and every pass of a fit would join again."""
    from tabloom import session

    monkeypatch.setattr(session, "SMALL_INPUT_BYTES", 1000)
    left = spark.range(400).selectExpr("id AS k", "cast(id % 17 as double) AS a")
    df = left.join(spark.range(400).selectExpr("id AS k", "cast(id % 17 + id % 3 as double) AS y"), "k")
    with session.working_copy(df) as kept:
        assert kept._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
        assert sorted(kept.collect()) == sorted(df.collect())
    with session.working_copy(left.repartition(2)) as kept:  # one table is scanned as it is
        assert "parquet" not in kept._jdf.queryExecution().optimizedPlan().toString().lower()
