from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.errors import PrepareError
from tabloom.functions.ordered import running_sums
from tabloom.operators.balance import smote
from tabloom.operators.knn import Metric, classify, nearest, regress
from tabloom.operators.knn_impute import NeighbourFill, impute_knn
from tabloom.operators.neighbour_index import NeighbourIndex, Screen, masked_bound
from tabloom.plans.prepare import prepare
from tabloom.plans.steps import FittedPreparation

def points(spark, x, ident, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{ident} int, vec array<double>").repartition(parts)


def brute(q, t, k, dist):
    out = {}
    for i, a in enumerate(q):
        d = [(dist(a, b), j) for j, b in enumerate(t)]
        out[i] = sorted(d)[:k]
    return out


DISTANCES = {
    "euclidean": (Metric("euclidean"), lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))),
    "manhattan": (Metric("manhattan"), lambda a, b: float(np.abs(a - b).sum())),
    "chebyshev": (Metric("chebyshev"), lambda a, b: float(np.abs(a - b).max())),
    "minkowski": (Metric("minkowski", 3.0), lambda a, b: float((np.abs(a - b) ** 3).sum() ** (1 / 3))),
}


@pytest.mark.parametrize("name", sorted(DISTANCES))
@pytest.mark.parametrize("cell_rows", [25, 4096])
def test_neighbours_match_brute_force(spark, rng, name, cell_rows):
    metric, dist = DISTANCES[name]
    t = np.round(np.concatenate([rng.normal(size=(180, 3)), rng.normal(4, 0.3, size=(90, 3))]), 2)
    q = np.round(rng.normal(1, 2, size=(40, 3)), 2)
    got = nearest(points(spark, q, "qid"), points(spark, t, "tid"), 4, metric, cell_rows=cell_rows)
    found = {}
    for r in got.collect():
        found.setdefault(r["qid"], []).append((r["dist"], r["tid"]))
    for i, want in brute(q, t, 4, dist).items():
        have = sorted(found[i])
        np.testing.assert_allclose([d for d, _ in have], [d for d, _ in want], rtol=1e-9)


def groups(rng, n=2500, dims=64):
    """Rows around 40 centres, as vectors of text or images are."""
    middle = rng.normal(size=(40, dims))
    return middle[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, dims))


@pytest.mark.parametrize("regions", [12, 256])
def test_wide_rows_visit_few_cells(spark, rng, tmp_path, regions):
    x = groups(rng)
    q = np.concatenate([x[:30], rng.normal(size=(2, 64))])
    index = NeighbourIndex.build(points(spark, x, "tid"), cell_rows=50, regions=regions)
    assert index.cut == (regions == 12)
    cells = index.cells.count()
    index.save(f"{tmp_path}/index")
    index = NeighbourIndex.load(spark, f"{tmp_path}/index")
    asked = points(spark, q, "qid")
    found = {}
    for r in index.nearest(asked, 5).collect():
        found.setdefault(r["qid"], []).append((r["dist"], r["tid"]))
    for i, want in brute(q, x, 5, DISTANCES["euclidean"][1]).items():
        assert [j for _, j in sorted(found[i])] == [j for _, j in want]
    visited = {r["qid"]: r["cells"] for r in index.visits(asked, 5).collect()}
    assert cells >= 25 and np.mean([visited[i] for i in range(30)]) < 0.2 * cells


def test_parts_are_searched_apart(spark, rng):
    x = groups(rng, 400, 6)
    part = ["ab"[i % 2] if i % 50 else "rare" for i in range(len(x))]
    rows = [(i, v.tolist(), p) for i, (v, p) in enumerate(zip(x, part))]
    train = spark.createDataFrame(rows, "tid int, vec array<double>, part string").repartition(4)
    asked = spark.createDataFrame([r for r in rows if r[0] % 10 == 0], "qid int, vec array<double>, part string")
    got = {}
    for r in NeighbourIndex.build(train, cell_rows=15, regions=5, flat=1).nearest(asked, 4, skip_self=True).collect():
        got.setdefault(r["qid"], []).append((r["dist"], r["tid"]))
    for i, v, p in rows[::10]:
        own = [(float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in range(len(x)) if j != i and part[j] == p]
        assert [j for _, j in sorted(got[i])] == [j for _, j in sorted(own)[:4]]


def test_bound_over_missing_coordinates_is_never_too_large(rng):
    metric = Metric("nan_euclidean")
    for _ in range(30):
        t = rng.normal(rng.normal(0, 3, 5), 1, size=(20, 5))
        t[rng.random(t.shape) < rng.random()] = np.nan
        q = rng.normal(0, 3, size=(15, 5))
        q[rng.random(q.shape) < 0.4] = np.nan
        here = ~np.isnan(t)
        low, high = np.where(here, t, np.inf).min(0), np.where(here, t, -np.inf).max(0)
        bound = masked_bound(q, low[None], high[None], here.sum(0)[None], np.array([len(t)]))[:, 0]
        dist = metric.pairwise(q, t).min(1)
        assert (bound <= dist * (1 + 1e-12) + 1e-12).all()


def test_a_third_of_all_rows_at_one_point(spark, rng):
    t = np.concatenate([np.zeros((100, 2)), rng.normal(size=(200, 2))])
    got = nearest(points(spark, np.zeros((3, 2)), "qid"), points(spark, t, "tid"), 5, cell_rows=30).collect()
    assert all(r["dist"] == 0 for r in got) and len(got) == 15
    assert sorted(r["tid"] for r in got if r["qid"] == 0) == [0, 1, 2, 3, 4]


def test_weights_count_as_copies(spark):
    train = spark.createDataFrame([(0, [0.0], 3, 10.0), (1, [1.0], 1, 20.0), (2, [5.0], 9, 30.0)], "tid int, vec array<double>, weight bigint, payload double")
    q = spark.createDataFrame([(7, [0.0])], "qid int, vec array<double>")
    got = {r["tid"]: r["taken"] for r in nearest(q, train, 5).collect()}
    assert got == {0: 3, 1: 1, 2: 1}
    assert regress(nearest(q, train, 4)).first()["prediction"] == pytest.approx(12.5)
    assert regress(nearest(q, train, 4), "distance").first()["prediction"] == 10.0
    assert classify(nearest(q, train, 5)).first()["prediction"] == 10.0


def numpy_impute(x, k=5):
    out = x.copy()
    n, d = x.shape
    for i in range(n):
        for j in np.flatnonzero(np.isnan(x[i])):
            near = []
            for o in range(n):
                if np.isnan(x[o, j]):
                    continue
                both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                if both.any():
                    near.append((np.sqrt(d / both.sum() * ((x[i, both] - x[o, both]) ** 2).sum()), x[o, j]))
            near.sort(key=lambda p: p[0])
            out[i, j] = np.mean([v for _, v in near[:k]]) if near else np.nanmean(x[:, j])
    return out


@pytest.mark.parametrize("cell_rows", [20, 4096])
def test_impute_matches_brute_force(spark, rng, cell_rows):
    x = rng.normal(size=(120, 4))
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i_, *[None if np.isnan(v) else float(v) for v in r]) for i_, r in enumerate(x)]
    df = spark.createDataFrame([(str(r[0]), *r[1:]) for r in rows], "k string, a double, b double, c double, d double").repartition(5)
    got = impute_knn(df, cell_rows=cell_rows).toPandas()
    got["k"] = got["k"].astype(int)
    have = got.sort_values("k")[["a", "b", "c", "d"]].to_numpy()
    np.testing.assert_allclose(have, numpy_impute(x), rtol=1e-9)


@pytest.mark.parametrize("cell_rows", [4, 4096])
def test_later_rows_are_filled_from_the_rows_learned(spark, rng, tmp_path, cell_rows):
    x = rng.normal(size=(160, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    schema = "k string, a double, b double, c double, d double"
    rows = [(str(i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    known, later = rows[:110], rows[110:] + [("none", None, None, None, None)]
    fill = NeighbourFill.fit(spark.createDataFrame(known, schema).repartition(3), cell_rows=cell_rows)
    fill.save(spark, f"{tmp_path}/fill")
    out = NeighbourFill.load(spark, f"{tmp_path}/fill").apply(spark.createDataFrame(later, schema).repartition(2)).collect()
    have = {r["k"]: list(r)[1:] for r in out}
    for row in later[:-1]:
        alone = np.concatenate([x[:110], x[int(row[0])][None]])
        # the later row is no donor: it lacks what it asks for
        np.testing.assert_allclose(have[row[0]], numpy_impute(alone)[-1], rtol=1e-9)
    np.testing.assert_allclose(have["none"], np.nanmean(x[:110], axis=0), rtol=1e-9)
    narrow = NeighbourFill.load(spark, f"{tmp_path}/fill").apply(spark.createDataFrame([(None, 1, "x")], "b double, a int, z string"))
    assert narrow.columns == ["b", "a", "z"] and narrow.first()["b"] is not None


def test_a_stored_preparation_fills_and_scales(spark, rng, tmp_path):
    x = rng.normal(5, 2, size=(60, 2))
    rows = [(float(a), None if i % 6 == 0 else float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    done = prepare(df, {"missing_values": ["knn"], "scaling": ["standard"]}, ["a", "b"])
    done.fitted.save(spark, f"{tmp_path}/prepared")
    again = FittedPreparation.load(spark, f"{tmp_path}/prepared").transform(df)
    key = lambda d: sorted((round(r["a"], 9), round(r["b"], 9)) for r in d.collect())
    assert key(again) == key(done.df)


def test_impute_of_an_all_null_row_uses_the_mean(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (None, None)], "a double, b double")
    assert sorted(tuple(r) for r in impute_knn(df).collect()) == [(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)]


def test_smote_balances_and_stays_between_neighbours(spark, rng):
    rows = [(float(a), float(b), "big") for a, b in rng.normal(size=(60, 2))]
    rows += [(float(a), float(b), "small") for a, b in rng.normal(8, 0.5, size=(13, 2))] + [(8.0, 8.0, "small")] * 4
    df = spark.createDataFrame(rows, "a double, b double, y string").repartition(5)
    out = smote(df, ["a", "b"], "y")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"big": 60, "small": 60}
    small = np.array([[r["a"], r["b"]] for r in out.where("y = 'small'").collect()])
    real = np.array([r[:2] for r in rows if r[2] == "small"])
    assert (small >= real.min(axis=0) - 1e-9).all() and (small <= real.max(axis=0) + 1e-9).all()
    again = smote(df.repartition(2), ["a", "b"], "y")
    key = lambda d: sorted((round(r["a"], 9), round(r["b"], 9), r["y"]) for r in d.collect())
    assert key(out) == key(again)


@pytest.mark.parametrize("cell_rows", [3, 4096])
def test_queries_taken_from_the_rows_themselves(spark, cell_rows):
    """Both sides of the search share the columns of one frame."""
    rows = spark.createDataFrame([(str(i), [float(i)], "ab"[i % 2]) for i in range(60)], "tid string, vec array<double>, part string")
    asked = running_sums(rows, "tid", {"upto": F.lit(1)}, by=["part"]).select(F.col("tid").alias("qid"), "vec", "part")
    got = nearest(asked, rows, 1, skip_self=True, cell_rows=cell_rows).collect()
    assert len(got) == 60 and all(r["dist"] == 2.0 for r in got)


def test_smote_errors(spark):
    one = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1)], "a double, y int")
    with pytest.raises(PrepareError, match="at least 2 samples"):
        smote(one, ["a"], "y")
    with pytest.raises(PrepareError, match="categorical target"):
        smote(one.withColumn("y", F.col("y").cast("double")), ["a"], "y")
    with pytest.raises(PrepareError, match="missing values"):
        smote(one.withColumn("y", F.when(F.col("a") > 1, F.col("y"))), ["a"], "y")


@pytest.mark.parametrize("metric", [Metric("euclidean"), Metric("manhattan"), Metric("nan_euclidean")])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_few_rows_of_a_chunk_are_measured_and_the_nearest_are_among_them(rng, metric, offset):
    """Quick distances, also far from the origin and among equal rows, leave few pairs to compute exactly."""
    t, q = rng.normal(size=(5000, 16)) + offset, rng.normal(size=(40, 16)) + offset
    t[:4] = t[0]
    q[0] = t[0]
    if metric.masked:
        t[rng.random(t.shape) < 0.1] = np.nan
        q[rng.random(q.shape) < 0.1] = np.nan
    else:
        t[9, 0], q[5, 1] = np.inf, np.nan
    screen = Screen(metric, t)
    i, j = screen.near(q, 5, np.full(40, -1), ~np.isnan(t))
    assert len(i) < 40 * 200
    dist = screen.exact(q, i, j)
    with np.errstate(all="ignore"):
        whole = metric.pairwise(q, t)
    for r in range(40):
        mine = i == r
        got = sorted((a, b) for a, b in zip(dist[mine], j[mine]) if np.isfinite(a))[:5]
        assert got == sorted((a, b) for b, a in enumerate(whole[r]) if np.isfinite(a))[:5]


@pytest.mark.parametrize("kinds", [0, 1, 5, 300])
def test_quick_distances_over_gaps_stay_within_their_bound(kinds):
    rng = np.random.default_rng(kinds)
    metric = Metric("nan_euclidean")
    t, q = rng.normal(50, 3, (400, 9)), rng.normal(50, 3, (40, 9))
    if kinds:
        masks = rng.random((kinds, 9)) < 0.4
        t[masks[rng.integers(0, kinds, len(t))]] = np.nan
    q[:30][rng.random((30, 9)) < 0.3] = np.nan
    q[0], t[0, 0] = np.nan, np.inf
    screen = Screen(metric, t)
    assert set(screen.usable) == set(range(1, 400))
    # rows that lack the same coordinates are one block each, so that a distance takes one product and thin ones
    assert len(screen.lacking) == np.isnan(t[1:]).any(0).sum()
    value, slack = screen.quick(q)
    want = metric.pairwise(q, t[screen.usable]) ** 2
    assert (np.isinf(value) == np.isinf(want)).all()
    there = np.isfinite(want)
    assert (np.abs(value - want)[there] <= np.broadcast_to(slack[:, None], want.shape)[there]).all()
    need, here = np.where(np.arange(40) % 2, 3, -1), ~np.isnan(t)
    i, j = screen.near(q, 4, need, here)
    for a in range(40):
        far = np.where(here[:, 3] if need[a] >= 0 else True, metric.pairwise(q[a : a + 1], t)[0], np.inf)
        far[0] = np.inf
        assert set(np.flatnonzero(far < np.sort(far)[4])) <= set(j[i == a])
