from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import stats
from tabloom.operators import plots, profile

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, values, parts=5):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(parts)


@pytest.mark.parametrize("shape", ["spread", "ties", "hot", "tails", "constant", "two"])
def test_narrowing_finds_exact_quantiles(spark, rng, shape):
    n = 4000
    values = {
        "spread": rng.normal(size=n),
        "ties": rng.integers(0, 11, n) / 100,
        "hot": np.where(rng.random(n) < 0.4, 3.25, rng.normal(3, 2, n)),
        "tails": np.concatenate([rng.normal(size=n - 2), [1e300, -1e300]]),
        "constant": np.ones(n),
        "two": np.concatenate([np.zeros(n // 2), np.ones(n // 2)]),
    }[shape]
    got = stats.quantiles(frame(spark, values), {"x": PROBS}, small_rows=10, value_limit=20)["x"]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-12, atol=1e-12)


def test_narrowing_with_nulls_nans_and_few_rows(spark):
    df = frame(spark, [1.0, None, float("nan"), 4.0, 2.0, 3.0])
    for small in (0, 100):
        assert stats.quantiles(df, {"x": [0.25, 0.5]}, small_rows=small)["x"] == [1.75, 2.5]
    empty = frame(spark, [None, None])
    assert stats.quantiles(empty, {"x": [0.5]})["x"] == [None]


def test_partitioning_does_not_matter(spark, rng):
    values = rng.normal(size=3000)
    one = stats.quantiles(frame(spark, values, 1), {"x": PROBS}, small_rows=0, value_limit=50)
    seven = stats.quantiles(frame(spark, values, 7), {"x": PROBS}, small_rows=0, value_limit=50)
    assert one == seven


def test_mode_prefers_the_smallest(spark):
    df = frame(spark, [3, 1, 3, 1, 2])
    assert stats.modes(df, ["x"], True) == {"x": 1.0}
    assert stats.modes(frame(spark, [None]), ["x"], True) == {}


def test_profile_of_awkward_columns(spark):
    rows = [(1.0, 1.0, None), (1.0, float("nan"), None), (1.0, None, None)]
    df = spark.createDataFrame(rows, "konst double, gaps double, empty double")
    got = {r["column_name"]: r for r in profile.eda_numeric(df, df.columns).collect()}
    assert got["konst"]["skewness"] == 0 and got["konst"]["kurtosis"] == 0 and got["konst"]["std"] == 0
    assert got["gaps"]["null_count"] == 2 and got["gaps"]["std"] == 0
    assert got["empty"]["mean"] is None and got["empty"]["null_percent"] == 100
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.correlation_matrix(df, ["konst", "gaps"]).collect()}
    assert corr[("konst", "gaps")] is None
    assert {r["column_name"]: r["outlier_count"] for r in profile.sigma_outliers(df, df.columns).collect()} == dict.fromkeys(df.columns, 0)


def test_correlations_of_many_columns_with_gaps(spark, rng):
    d = 40
    x = rng.normal(size=(300, d)) * 10.0 ** rng.uniform(-3, 6, d) + rng.normal(size=d) * 1e3
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 0.1
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"c{i} double" for i in range(d)))
    got = profile.correlation_pairs(df, df.columns).toPandas()
    want = pdf.corr().to_numpy()
    pairs = np.array([want[int(a[1:]), int(b[1:])] for a, b in zip(got["col_a"], got["col_b"])])
    assert len(got) == d * (d - 1) // 2
    assert np.allclose(got["corr"].to_numpy(dtype=float), pairs, atol=1e-9, equal_nan=True)


def test_empty_table_has_a_profile(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert profile.null_profile(df).count() == 2
    assert {r["unique_count"] for r in profile.unique_counts(df).collect()} == {0}
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 0
    assert profile.eda_numeric(df, ["x"]).count() == 1
    assert plots.box_summary(df, "x").first()["q1"] is None
    assert plots.histogram(df, "x").agg(F.sum("y")).first()[0] == 0


def test_skewness_and_kurtosis_match_pandas(spark, rng):
    values = rng.gamma(2.0, size=200)
    df = frame(spark, values)
    s = pd.Series(values)
    assert profile.skewness(df, ["x"]).first()["skewness"] == pytest.approx(s.skew())
    assert profile.kurtosis(df, ["x"]).first()["kurtosis"] == pytest.approx(s.kurt())


@pytest.mark.parametrize("kind", ["normal", "ties", "constant"])
def test_histogram_matches_numpy(spark, rng, kind):
    values = {"normal": rng.normal(size=2500), "ties": rng.integers(0, 9, 500) / 100.0, "constant": np.full(7, 2.0)}[kind]
    got = plots.histogram(frame(spark, values), "x").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=len(got))
    assert [r["y"] for r in got] == list(counts)
    np.testing.assert_allclose([r["x"] for r in got], (edges[:-1] + edges[1:]) / 2, atol=1e-4)


def test_plots_refuse_text(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError, match="not numeric"):
        plots.histogram(df, "s")
    with pytest.raises(ValueError, match="not found"):
        plots.histogram(df, "t")


def test_ranking_falls_back(spark):
    facts = spark.createDataFrame([("problem_type", "clustering")], "feature string, value string")
    got = [r["algorithm"] for r in profile.algorithm_ranking(facts).orderBy("rank").collect()]
    assert got == profile.FALLBACK_ALGORITHMS


def plan_size(df, ask):
    """The most aggregates in one job of those a function starts."""
    seen, agg = [], type(df).agg
    from pyspark.sql.group import GroupedData

    grouped = GroupedData.agg
    try:
        type(df).agg = lambda self, *a: (seen.append(len(a)), agg(self, *a))[1]
        GroupedData.agg = lambda self, *a: (seen.append(len(a)), grouped(self, *a))[1]
        return ask(), max(seen)
    finally:
        type(df).agg, GroupedData.agg = agg, grouped


def test_wide_tables_need_no_aggregate_per_column(spark, rng):
    x = rng.normal(size=(300, 40))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = np.nan
    names = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(5)
    m, size = plan_size(df, lambda: stats.moments(df, names, [0.5]))
    wanted = {c: [0.25, 0.5] if i % 2 else [0.9] for i, c in enumerate(names)}
    counts = {c: m[c].n for c in names}
    small, size_small = plan_size(df, lambda: stats.quantiles(df, wanted, counts))
    large, size_large = plan_size(df, lambda: stats.quantiles(df, wanted, counts, small_rows=10))
    assert max(size, size_small, size_large) <= 10
    for i, c in enumerate(names):
        v = x[:, i][~np.isnan(x[:, i])]
        assert (m[c].rows, m[c].n) == (300, len(v))
        if not len(v):
            assert m[c].mean is None and small[c] == [None] * len(wanted[c])
            continue
        assert np.allclose([m[c].min, m[c].max, m[c].mean, m[c].std, m[c].var_pop], [v.min(), v.max(), v.mean(), v.std(ddof=1), v.var()])
        assert np.allclose(small[c], np.quantile(v, wanted[c])) and np.allclose(large[c], np.quantile(v, wanted[c]))
    none = stats.moments(df.where("false"), names)
    assert all((s.rows, s.n, s.mean) == (0, 0, None) for s in none.values())
