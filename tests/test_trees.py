"""Trees next to an exhaustive search for the best cut of every node."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import metrics
from tabloom.plans import training, trees
from tabloom.plans.features import FEATURES
from tabloom.plans.models import LABEL, FittedModel
from tabloom.plans.trees import Rules, fit_trees
from tabloom.session import scratch_path


def impurity(y, rules):
    if rules.task == "regression":
        return ((y - y.mean()) ** 2).sum()
    p = np.array([(y == k).mean() for k in range(rules.classes)])
    if rules.criterion == "gini":
        return len(y) * (1 - (p**2).sum())
    return -len(y) * sum(v * np.log2(v) for v in p if v > 0)


def brute(x, y, rules, depth=0):
    """A nested tree: a value, or (feature, threshold, left, right)."""
    leaf = y.mean() if rules.task == "regression" else [(y == k).mean() for k in range(rules.classes)]
    if (rules.max_depth is not None and depth >= rules.max_depth) or len(y) < max(2, rules.min_samples_split) or len(set(y)) == 1:
        return leaf
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, j] <= t
            if min(low.sum(), (~low).sum()) < rules.min_samples_leaf:
                continue
            cost = impurity(y[low], rules) + impurity(y[~low], rules)
            if best is None or cost < best[0] - 1e-9 * max(1.0, impurity(y, rules)):
                best = (cost, j, t)
    if best is None:
        return leaf
    _, j, t = best
    low = x[:, j] <= t
    return j, t, brute(x[low], y[low], rules, depth + 1), brute(x[~low], y[~low], rules, depth + 1)


def nested(trees, k=0):
    if trees.feature[0][k] < 0:
        v = trees.value[0][k]
        return v[0] if trees.task == "regression" else list(v)
    return int(trees.feature[0][k]), float(trees.threshold[0][k]), nested(trees, trees.left[0][k]), nested(trees, trees.right[0][k])


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return np.allclose(a, b)
    return a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and same(a[2], b[2]) and same(a[3], b[3])


def frame(spark, x, y):
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], f"x array<double>, {LABEL} double").repartition(3)
    return df.select(array_to_vector("x").alias(FEATURES), LABEL)


@pytest.mark.parametrize("local_rows", [100_000, 12])
@pytest.mark.parametrize("rules", [
    Rules("classification", 3), Rules("classification", 3, "entropy", min_samples_split=15), Rules("classification", 3, min_samples_leaf=7, max_depth=4),
    Rules("regression"), Rules("regression", min_samples_split=20, min_samples_leaf=3),
])
def test_tree_equals_an_exhaustive_search(spark, rng, rules, local_rows):
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + 0.3 * rng.normal(size=90) > 0.5) if rules.classes else x[:, 0] * 2 + rng.normal(size=90)
    got = fit_trees(frame(spark, x, y), LABEL, rules, local_rows=local_rows)
    assert same(nested(got), brute(x, y.astype(float), rules))


def test_depth_has_no_limit(spark):
    x = np.arange(45.0)[:, None]
    got = fit_trees(frame(spark, x, 3.0 ** np.arange(45)), LABEL, Rules("regression"), local_rows=10)
    assert got.depth == 44 and np.allclose(got.outputs(x)[:, 0], 3.0 ** np.arange(45))


def test_forest_draws_rows_and_features_alike_wherever_it_grows(spark, rng):
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    rules = Rules("classification", 2, max_features="sqrt", bootstrap=True, max_depth=6)
    df = frame(spark, x, y)
    here = fit_trees(df, LABEL, rules, 7)
    there = fit_trees(df, LABEL, rules, 7, local_rows=60)
    np.testing.assert_allclose(here.outputs(x), there.outputs(x))
    assert here.count == 7 and len({tuple(f[:3]) for f in here.feature}) > 1
    assert (here.outputs(x).argmax(1) == y).mean() > 0.9


def test_regressor_keeps_its_feature_choice_and_its_store(spark, rng):
    x = rng.normal(size=(200, 4))
    rows = [(i, *map(float, v), float(v[0] * 3 + v[1])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double")
    result = training.fit_model(df, "DecisionTreeRegressor", "y", {"max_features": "sqrt", "min_samples_split": 8, "max_depth": 60}, ["id"])
    got = metrics.metrics_dict(result.metrics)
    assert got["r2_score"] > 0.5 and got["tree_depth"] > 3
    path = scratch_path(spark, "model")
    result.model.save(spark, path)
    both = result.model.transform(df).join(FittedModel.load(spark, path).transform(df).select("id", F.col("prediction").alias("q")), "id")
    assert both.where("prediction <> q").count() == 0 and both.count() == 200


def test_leaves_that_a_rule_of_depth_makes_need_no_pass_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, size=(3000, 3)).astype(float)
    y = 3 * x[:, 0] + x[:, 1] * (x[:, 2] > 20) + rng.normal(size=3000)
    data = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, y double")
    data = data.select(array_to_vector("x").alias(FEATURES), "y")
    rules = trees.Rules("regression", max_depth=3)
    here = trees.fit_trees(data, "y", rules)  # in one task
    levels = []
    group_by = type(data).groupBy

    def counted(self, *by):
        if by == ("tree", "node", "cell"):
            levels.append(by)
        return group_by(self, *by)

    monkeypatch.setattr(type(data), "groupBy", counted)
    spread = trees.fit_trees(data, "y", rules, local_rows=100)
    assert len(levels) == 3  # one per level of cuts, none for the leaves
    assert np.allclose(here.outputs(x), spread.outputs(x))
    assert sorted(here.rows[0][here.feature[0] < 0]) == sorted(spread.rows[0][spread.feature[0] < 0])


def test_tasks_without_rows_take_part_in_no_level(spark):
    """Files of few large parts leave most tasks of a scan empty, and the rows of a deep node lie in a few."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(400, 2)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    parts = [[], [(v.tolist(), float(t)) for v, t in zip(x, y)], []]
    held = spark.sparkContext.parallelize(parts, 3).flatMap(lambda part: part)
    data = spark.createDataFrame(held, f"x array<double>, {LABEL} double").select(array_to_vector("x").alias(FEATURES), LABEL)
    rules = Rules("classification", 2, max_depth=4)
    assert same(nested(fit_trees(data, LABEL, rules, local_rows=50)), brute(x, y, rules))
