"""Kernel machines, their probabilities, and least squares without negative coefficients."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import metrics
from tabloom.plans import dual, linear, registry, training
from tabloom.plans.features import FEATURES
from tabloom.plans.models import LABEL, FittedModel
from tabloom.session import scratch_path


def points(rng, n=140):
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] ** 2 + x[:, 1] + 0.4 * rng.normal(size=n) > 0.8, 1.0, -1.0)
    return x, y


def brute_dual(k, y, p, c, rounds=400_000):
    """Pairs drawn in turn, each moved to its own optimum: slow, and with no working set."""
    n = len(y)
    q = k * np.outer(y, y)
    a, g = np.zeros(n), p.copy()
    rng = np.random.default_rng(0)
    for r in range(rounds):
        i, j = rng.integers(0, n, 2)
        if i == j:
            continue
        bend = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = (-y[i] * g[i] + y[j] * g[j]) / bend
        low = max(-a[i] if y[i] > 0 else a[i] - c[i], a[j] - c[j] if y[j] > 0 else -a[j])
        high = min(c[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c[j] - a[j])
        t = min(max(t, low), high)
        if abs(t) > 1e-15:
            a[i] += y[i] * t
            a[j] -= y[j] * t
            g += q[:, i] * y[i] * t - q[:, j] * y[j] * t
    return a


def objective(k, y, p, a):
    v = y * a
    return 0.5 * v @ k @ v + p @ a


@pytest.mark.parametrize("of", [dual.Kernel("rbf", 0.5), dual.Kernel("linear"), dual.Kernel("poly", 0.3, 2)])
def test_working_sets_reach_the_optimum_of_the_dual(spark, rng, of):
    x, y = points(rng)
    k, c, p = of(x, x), np.full(len(y), 2.0), -np.ones(len(y))
    want = brute_dual(k, y, p, c)
    alpha, grad = dual.solve(of, x, y, c, np.zeros(len(y)), p)
    assert objective(k, y, p, alpha) == pytest.approx(objective(k, y, p, want), rel=1e-3)
    assert abs(y @ alpha) < 1e-9 and ((alpha >= 0) & (alpha <= c)).all()
    rows = [(i, v.tolist(), float(t), -1.0, 2.0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, p double, c double").repartition(3)
    for working, direct in ((140, 1000), (30, 10)):
        vectors, b = dual.fit_dual(df, of, working, direct)
        found = vectors.collect()
        a = np.zeros(len(y))
        for r in found:
            a[r["id"]] = r["coef"] * y[r["id"]]
        assert objective(k, y, p, a) == pytest.approx(objective(k, y, p, want), rel=1e-3)
        margin = k @ (a * y) + b
        free = (a > 1e-6) & (a < 2 - 1e-6)
        assert np.abs(y[free] * margin[free] - 1).max(initial=0) < 5e-3
        assert (y[a == 0] * margin[a == 0] > 1 - 5e-3).all() and (y[a >= 2] * margin[a >= 2] < 1 + 5e-3).all()


def test_working_sets_are_solved_for_in_tasks(spark, rng, monkeypatch):
    """Machines of many pairs of classes would wait for each other on the driver."""
    real = dual.solve

    def inside(*given, **named):
        from pyspark import TaskContext

        assert TaskContext.get() is not None
        return real(*given, **named)

    monkeypatch.setattr(dual, "solve", inside)
    x, y = points(rng, 60)
    rows = [(i, v.tolist(), float(t), -1.0, 2.0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, p double, c double")
    for working, direct in ((60, 100), (20, 10)):
        vectors, _ = dual.fit_dual(df, dual.Kernel("rbf", 0.5), working, direct)
        assert vectors.count()


def frame(spark, rng, n=180, classes=3):
    middle = np.array([[0, 0], [1.5, 0.5], [0.5, 2.0]])[:classes]
    k = rng.integers(0, classes, n)
    x = middle[k] + rng.normal(0, 0.7, size=(n, 2))
    rows = [(i, *map(float, v), f"c{c}") for i, (v, c) in enumerate(zip(x, k))]
    return spark.createDataFrame(rows, "id int, a double, b double, y string").repartition(3)


@pytest.mark.parametrize("classes", [2, 3])
def test_classifier_with_probabilities_is_kept(spark, rng, classes):
    df = frame(spark, rng, classes=classes)
    result = training.fit_model(df, "SVC", "y", {"probability": True}, ["id"])
    got = metrics.metrics_dict(result.metrics)
    assert got["accuracy"] > 0.6 and got["roc_auc"] > 0.75 and 10 < got["n_support_vectors"] <= 180
    assert got["log_loss_val"] < np.log(classes)
    path = scratch_path(spark, "model")
    result.model.save(spark, path)
    loaded = FittedModel.load(spark, path)
    one = {r["id"]: r["prediction"] for r in result.model.transform(df).collect()}
    assert one == {r["id"]: r["prediction"] for r in loaded.transform(df).collect()}
    p = np.array([r["_p"] for r in loaded.raw(df).select("_p").collect()])
    np.testing.assert_allclose(p.sum(1), 1.0)
    plain = metrics.metrics_dict(training.fit_model(df, "SVC", "y", key=["id"]).metrics)
    assert "roc_auc" not in plain and plain["n_support_vectors"] == got["n_support_vectors"]


def test_sigmoid_is_the_likeliest(spark, rng):
    f = rng.normal(size=400)
    y = np.where(rng.random(400) < 1 / (1 + np.exp(-2.5 * f + 0.7)), 1.0, -1.0)
    a, b = dual.sigmoid(spark.createDataFrame(list(zip(f.tolist(), y.tolist())), "f double, y double"))
    plus, minus = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(a * f + b))
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).sum()

    best = loss(a, b)
    assert all(best <= loss(a + u, b + v) + 1e-6 for u in (-0.02, 0, 0.02) for v in (-0.02, 0, 0.02))
    # better than reading the margin itself as the log odds
    assert best < loss(-1.0, 0.0)


def test_coupling_of_consistent_pairs():
    p = np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])
    pairs = list(combinations(range(3), 2))
    r = np.array([[row[a] / (row[a] + row[b]) for a, b in pairs] for row in p])
    margins = np.log(r / (1 - r))
    np.testing.assert_allclose(dual.coupled(margins, np.array([[-1.0, 0.0]] * 3), pairs, 3), p, rtol=1e-6)


def test_regression_tube(spark, rng):
    x = rng.uniform(-2, 2, 150)
    rows = [(i, float(v), float(np.sin(2 * v))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, y double")
    result = training.fit_model(df, "SVR", "y", {"epsilon": 0.05, "C": 10.0, "gamma": 2.0}, ["id"])
    got = metrics.metrics_dict(result.metrics)
    assert got["r2_score"] > 0.95 and 0 < got["n_support_vectors"] < 120
    assert all(abs(r["y"] - r["prediction"]) < 0.2 for r in result.model.transform(df).collect())
    rough = training.fit_model(df, "SVR", "y", {"landmarks": 40, "gamma": 2.0}, ["id"])
    assert "n_support_vectors" not in metrics.metrics_dict(rough.metrics)


def test_nonnegative_least_squares_is_the_best_of_all_subsets(spark, rng):
    for trial in range(4):
        x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)) + 100
        y = x @ np.array([1.5, -2.0, 0.0, 0.7]) + rng.normal(size=80)
        df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], f"x array<double>, {LABEL} double").repartition(3)
        df = df.select(array_to_vector("x").alias(FEATURES), LABEL)
        for intercept in (True, False):
            w = linear.fit_nonnegative(df, LABEL, intercept)
            xs, ys = (x - x.mean(0), y - y.mean()) if intercept else (x, y)
            best = (ys**2).sum()
            for n in range(1, 5):
                for some in combinations(range(4), n):
                    z = np.linalg.lstsq(xs[:, some], ys, rcond=None)[0]
                    if (z >= 0).all():
                        best = min(best, ((ys - xs[:, some] @ z) ** 2).sum())
            assert min(w[:-1]) >= 0 and ((y - x @ w[:-1] - w[-1]) ** 2).sum() == pytest.approx(best, rel=1e-6)


def test_positive_is_a_grid_axis_and_kept(spark, rng):
    assert {"fit_intercept": True, "positive": True} in registry.grid("LinearRegression")
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(x)], "id int, a double, b double, y double")
    result = training.fit_model(df, "LinearRegression", "y", {"positive": "true"}, ["id"])
    path = scratch_path(spark, "model")
    result.model.save(spark, path)
    assert FittedModel.load(spark, path).svr[1] == 0.0 and result.model.svr[0] > 0
    assert df.count() == result.model.transform(df).where(F.col("prediction").isNotNull()).count()


def test_kernel_matrices_are_held_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dual, "BLOCK_NUMBERS", 3000)
    rng = np.random.default_rng(3)
    x, points, coefs = rng.normal(size=(500, 4)), rng.normal(size=(70, 4)), rng.normal(size=(70, 2))
    of, held = dual.Kernel("rbf", 0.3), []

    def seen(a, b):
        held.append(len(a) * len(b))
        return of(a, b)

    got = dual._adding(seen, points, coefs).func(pd.Series(list(x)), pd.Series([np.ones(2)] * 500))
    assert np.allclose(np.stack(got), of(x, points) @ coefs + 1.0)
    assert max(held) <= 3000


def test_start_from_few_coordinates_reaches_the_optimum(spark, rng, monkeypatch):
    """Near-copies of rows make single steps creep; the barrier's start leaves next to nothing to do."""
    monkeypatch.setattr(dual, "STARTED", 50)
    of, taken = dual.Kernel("rbf", 0.2), []
    begin = dual.started
    monkeypatch.setattr(dual, "started", lambda *given: (taken.append(len(given[1].points)), begin(*given))[1])
    x, y = points(rng, 120)
    x = np.vstack([x, x + 1e-4])
    y = np.append(y, y)
    k, c, p = of(x, x), np.full(len(y), 2.0), -np.ones(len(y))
    want, _ = dual.solve(of, x, y, c, np.zeros(len(y)), p, 1e-6)
    rows = [(i, v.tolist(), float(t), -1.0, 2.0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, p double, c double").repartition(3)
    vectors, b = dual.fit_dual(df, of, 300)
    a = np.zeros(len(y))
    for r in vectors.collect():
        a[r["id"]] = r["coef"] * y[r["id"]]
    assert taken and taken[0] < 200
    assert objective(k, y, p, a) == pytest.approx(objective(k, y, p, want), rel=1e-5) and abs(y @ a) < 1e-7
    margin = k @ (a * y) + b
    assert (y[a == 0] * margin[a == 0] > 1 - 5e-3).all() and (y[a >= 2] * margin[a >= 2] < 1 + 5e-3).all()
    assert np.abs(y * margin - 1)[(a > 0) & (a < 2)].max(initial=0) < 5e-3


def test_parts_of_a_problem_reach_its_optimum(rng):
    x, y = points(rng, 400)
    of, c, p = dual.Kernel("rbf", 0.5), np.full(400, 2.0), -np.ones(400)
    want, _ = dual.solve(of, x, y, c, np.zeros(400), p)
    got, grad = dual.solve_by_parts(of, x, y, c, p, 40, 100)
    k = of(x, x)
    assert objective(k, y, p, got) == pytest.approx(objective(k, y, p, want), rel=1e-4) and abs(y @ got) < 1e-9
    np.testing.assert_allclose(grad, p + y * (k @ (y * got)), atol=1e-8)
