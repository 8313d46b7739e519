from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.errors import PrepareError
from tabloom.operators import encode, reduce, select, transform
from tabloom.plans.prepare import prepare
from tabloom.plans.steps import FittedPreparation
from tabloom.session import scratch_path


def col_of(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.fixture()
def mixed(spark):
    rows = [(1, 1.0, "b", 10.0), (2, None, "a", 20.0), (3, 3.0, None, 30.0), (4, 4.0, "b", 40.0), (5, 100.0, "c", 50.0)]
    return spark.createDataFrame(rows, "id int, x double, s string, y double")


def test_small_even_quantiles_and_population_spread(spark):
    df = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "id int, x double")
    std = col_of(prepare(df, {"scaling": ["standard"]}, ["x"]).df, "x")
    np.testing.assert_allclose(std, (np.arange(1, 5) - 2.5) / 1.118033988749895)
    robust = col_of(prepare(df, {"scaling": ["robust"]}, ["x"]).df, "x")
    np.testing.assert_allclose(robust, (np.arange(1, 5) - 2.5) / 1.5)


def test_precedence_within_a_step(mixed):
    out = prepare(mixed, {"missing_values": ["mode", "median", "mean"]}, ["x"]).df
    assert col_of(out, "x")[1] == 27.0
    dropped = prepare(mixed, {"missing_values": ["mean", "drop_rows"]}, ["x", "s"]).df
    assert dropped.count() == 3


def test_steps_run_in_fixed_order_and_log_in_given_order(mixed):
    ops = {"scaling": ["minmax"], "missing_values": ["median"]}
    result = prepare(mixed, ops, ["x"])
    assert [s.step for s in result.fitted.steps] == ["missing_values", "scaling"]
    assert [r["step_type"] for r in result.step_log.collect()] == ["scaling", "missing_values"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 3.0)], "id int, x double")
    assert col_of(prepare(df, {"missing_values": ["mean"]}, ["x"]).df, "x") == [1.0, 2.0, 2.0, 3.0]


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 1000])], "id int, x double")
    clipped = col_of(prepare(df, {"outliers": ["iqr"]}, ["x"]).df, "x")
    assert clipped[:5] == [1, 2, 3, 4, 5] and clipped[5] == 8.5
    with_gap = df.unionByName(df.limit(1).select(F.lit(9).alias("id"), F.lit(None).cast("double").alias("x")))
    replaced = col_of(prepare(with_gap, {"outliers": ["replace_median"]}, ["x"]).df, "x")
    assert replaced[5] == 3.5 and replaced[6] == 3.5
    constant = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, x double")
    assert col_of(prepare(constant, {"outliers": ["zscore"]}, ["x"]).df, "x") == [2.0, 2.0]


def test_encodings(mixed):
    enc = lambda op, **k: col_of(prepare(mixed, {"encoding": [op]}, ["s"], **k).df, "s")
    assert enc("label") == [1, 0, 3, 1, 2]  # the missing one sorts as 'nan'
    assert enc("ordinal") == [1, 0, None, 1, 2]
    assert enc("freq") == [0.5, 0.25, 0.0, 0.5, 0.25]
    assert enc("target", target="y") == [25.0, 20.0, 30.0, 25.0, 50.0]
    hot = prepare(mixed, {"encoding": ["onehot"]}, ["s"]).df
    assert hot.columns == ["id", "x", "y", "s_b", "s_c"]
    assert col_of(hot, "s_b") == [1, 0, 0, 1, 0]


def test_ranks_over_many_ranges(spark):
    df = spark.createDataFrame([(f"c{i % 400:04d}",) for i in range(2000)], "s string")
    got = {r["k"]: r["v"] for r in encode.ranked(encode.categories(df, "s"), ranges=6).collect()}
    assert got == {f"c{i:04d}": i for i in range(400)}


def test_unseen_rows_after_saving_and_loading(spark, mixed):
    ops = {"missing_values": ["mode"], "encoding": ["target"]}
    fitted = prepare(mixed, ops, ["s"], target="y").fitted
    path = scratch_path(spark, "prep")
    fitted.save(spark, path)
    later = spark.createDataFrame([(1, "b"), (2, "zzz"), (3, None)], "id int, s string")
    loaded = FittedPreparation.load(spark, path)
    assert col_of(loaded.transform(later), "s") == col_of(fitted.transform(later), "s")
    assert col_of(loaded.transform(later), "s")[1] == 30.0


def test_quoted_names_survive(spark):
    df = spark.createDataFrame([(1, 1.0, "it's"), (2, 3.0, "b`c")], ["id", "a b.c", "t"])
    out = prepare(df, {"scaling": ["minmax"]}, ["a b.c"]).df
    assert [r["a b.c"] for r in out.orderBy("id").collect()] == [0.0, 1.0]
    hot = prepare(df, {"encoding": ["onehot"]}, ["t"]).df
    assert "t_it's" in hot.columns


def test_binning_matches_right_closed_quantiles(spark):
    df = spark.createDataFrame([(i, i * 1.7) for i in range(13)], "id int, x double")
    got = col_of(prepare(df, {"transformations": ["discretization"]}, ["x"]).df, "x")
    edges = np.quantile(np.arange(13) * 1.7, [0.2, 0.4, 0.6, 0.8]).round(10)
    assert got == [float((v > edges).sum()) for v in (np.arange(13) * 1.7).round(12)]


def yeojohnson(x, lam):
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if lam == 0 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if lam == 2 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def test_lambda_is_the_likelihood_maximum(spark, rng):
    x = rng.gamma(2.0, 3.0, 400) - 2
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    found = transform.best_lambda(df, "CAST(x AS DOUBLE)", "yeojohnson")

    def score(lam):
        return -len(x) / 2 * np.log(yeojohnson(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.linspace(found - 0.05, found + 0.05, 4001)
    assert abs(grid[np.argmax([score(g) for g in grid])] - found) < 1e-3
    out = np.array(col_of(prepare(df, {"transformations": ["yeojohnson"]}, ["x"]).df, "x"))
    assert abs(out.mean()) < 1e-9 and abs(out.std() - 1) < 1e-9


def test_selection_rules(spark):
    assert select._keep_best({"a": 1.0, "b": 1.0, "c": None}, ["a", "b", "c"], 1) == ["b"]
    rows = [(float(i), float(2 * i), float(i % 2), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    out = prepare(df, {"feature_selection": ["correlation_threshold"]}, ["a", "b", "c"]).df
    assert out.columns == ["a", "c", "y"]
    with pytest.raises(PrepareError, match="variance"):
        prepare(df.select((F.col("a") * 0).alias("a")), {"feature_selection": ["low_variance"]}, ["a"])
    kept = prepare(df, {"feature_selection": ["tree_importance"]}, ["a", "c"], target="y").df
    assert "c" in kept.columns and "a" not in kept.columns


@pytest.fixture()
def cloud(spark, rng):
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 3
    y = rng.integers(0, 3, 300)
    x[:, 0] += y * 2
    df = spark.createDataFrame([(i, *map(float, r), f"c{c}") for i, (r, c) in enumerate(zip(x, y))], "id int, a double, b double, c double, d double, y string")
    return df, x, y


def test_pca_matches_the_eigenvectors(cloud):
    df, x, _ = cloud
    out = prepare(df, {"data_reduction": ["pca"]}, list("abcd")).df.orderBy("id").toPandas()
    assert [c for c in out.columns if c.startswith("PC")] == ["PC1", "PC2", "PC3"]
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :3]
    got = out[["PC1", "PC2", "PC3"]].to_numpy()
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_discriminant_directions(cloud):
    df, x, y = cloud
    out = prepare(df, {"data_reduction": ["lda"]}, list("abcd"), target="y").df.orderBy("id").toPandas()
    got = out[["LDA1", "LDA2"]].to_numpy()
    within = sum((got[y == c] - got[y == c].mean(axis=0)).T @ (got[y == c] - got[y == c].mean(axis=0)) for c in range(3))
    np.testing.assert_allclose(within / (300 - 3), np.eye(2), atol=1e-8)
    means = np.array([got[y == c].mean(axis=0) for c in range(3)])
    assert means[:, 0].std() > means[:, 1].std()


def test_independent_components_are_uncorrelated(spark, rng):
    s = np.column_stack([rng.uniform(-1, 1, 800), rng.laplace(size=800), rng.normal(size=800)])
    x = s @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out = prepare(df, {"data_reduction": ["ica"]}, list("abc")).df.toPandas().to_numpy()
    assert out.shape == (800, 2)
    np.testing.assert_allclose(np.cov(out.T), np.eye(2), atol=1e-6)


def test_wide_projection_equals_arithmetic(spark, rng):
    x = rng.normal(size=(60, 20))
    names = [f"v{i}" for i in range(20)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    step = reduce.fit_pca(df, names)
    assert len(names) * len(step.projection.names) > 256
    got = step.apply(df).orderBy("id").toPandas()[step.projection.names].to_numpy()
    want = (x - np.array(step.projection.centre)) @ np.array(step.projection.weights)
    np.testing.assert_allclose(got, want, atol=1e-9)


ERRORS = [
    ({}, ["x"], None, "No attributes or operations"),
    ({"scaling": ["minmax"]}, [], None, "No attributes or operations"),
    ({"scaling": ["nope"]}, ["x"], None, "Unknown operation"),
    ({"missing_values": ["mean"]}, ["s"], None, "'s' is not numeric"),
    ({"outliers": ["iqr"]}, ["s"], None, "Attribute is not numeric"),
    ({"encoding": ["freq"]}, ["x"], None, "not categorical"),
    ({"encoding": ["onehot", "label"]}, ["s"], None, "Label encoding requires"),
    ({"encoding": ["target"]}, ["s"], None, "requires a target column"),
    ({"scaling": ["minmax"]}, ["s"], None, "Scaling requires numeric"),
    ({"scaling": ["robust"]}, ["x"], None, "no missing values"),
    ({"transformations": ["yeojohnson"]}, ["x"], None, "Yeo-Johnson requires no missing"),
    ({"transformations": ["binning"]}, ["x"], None, "Binning requires no missing"),
    ({"feature_selection": ["kbest"]}, ["y"], None, "requires a target"),
    ({"feature_selection": ["chi2"]}, ["x"], "s", "no missing values"),
    ({"data_reduction": ["pca"]}, ["y"], None, "at least 2 columns"),
    ({"data_reduction": ["lda"]}, ["y"], None, "requires a target"),
    ({"imbalanced_data": ["smote"]}, ["y"], None, "requires a target column"),
    ({"imbalanced_data": ["smote"]}, ["y"], "s", "missing values"),
    ({"missing_values": ["constant"]}, ["x"], None, "needs a value"),
]


@pytest.mark.parametrize("ops,attrs,target,message", ERRORS)
def test_error_contract(mixed, ops, attrs, target, message):
    with pytest.raises(PrepareError, match=message):
        prepare(mixed, ops, attrs, target)


def test_constant_column_cannot_be_minmax_scaled(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    with pytest.raises(PrepareError, match="zero variance"):
        prepare(df, {"scaling": ["minmax"]}, ["x"])
    assert [r["x"] for r in prepare(df, {"scaling": ["standard"]}, ["x"]).df.collect()] == [0.0, 0.0]


def test_steps_need_no_shuffle_once_fitted(mixed):
    ops = {"missing_values": ["median"], "outliers": ["iqr"], "scaling": ["standard"], "transformations": ["sqrt"]}
    plan = prepare(mixed, ops, ["x"]).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 2 and "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("method", ["boxcox", "yeojohnson"])
def test_likelihoods_of_all_powers_come_from_one_scan(spark, rng, monkeypatch, method):
    x = rng.exponential(size=3000) * 1e4 if method == "boxcox" else rng.normal(size=3000) ** 3
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    form = transform.boxcox_sql if method == "boxcox" else transform.yeojohnson_sql
    jacobian = np.log(x).sum() if method == "boxcox" else (np.sign(x) * np.log1p(np.abs(x))).sum()
    sums = transform.PowerSums(df, "CAST(x AS DOUBLE)", method)
    for lam in (-5.0, -1.3, 0.0, 1e-7, 0.5, 2.0, 5.0, 8.0):
        variance = df.selectExpr(f"var_pop({form('x', lam)}) AS v").first()["v"]
        want = -len(x) / 2 * np.log(variance) + (lam - 1) * jacobian
        assert abs(sums.score(lam) - want) < 1e-6 * max(1.0, abs(want))

    def refused(*_):
        raise AssertionError("a pass of its own")

    monkeypatch.setattr(transform.stats, "one_row", refused)
    found = transform.best_lambda(df, "CAST(x AS DOUBLE)", method)
    assert all(sums.score(found) >= sums.score(found + d) for d in (-1e-3, 1e-3))


def test_a_column_of_zeros_has_the_neutral_power(spark):
    df = spark.createDataFrame([(0.0,)] * 20, "x double")
    assert transform.best_lambda(df, "CAST(x AS DOUBLE)", "yeojohnson") == 1.0
    assert transform.best_lambda(df, "greatest(CAST(x AS DOUBLE), 1e-6)", "boxcox") == 1.0
