from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import ordered
from tabloom.functions.lookup import lookup_join
from tabloom.functions.ordered import asof_join, first_per_group, running_sums, split_values
from tabloom.operators import catalog, sampling
from tabloom.operators.metrics import auc_value, roc_curve


def test_running_sums_over_many_ranges(spark, rng):
    order = rng.permutation(500)
    rows = [(int(o), int(o) % 3, int(v)) for o, v in zip(order, rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "o int, g int, v int").repartition(6)
    for by, down in (([], False), ([], True), (["g"], False)):
        got = running_sums(df, "o", {"total": "v"}, by, down, ranges=9).toPandas()
        want = pd.DataFrame(rows, columns=["o", "g", "v"]).sort_values("o", ascending=not down)
        want["total"] = want.groupby("g")["v"].cumsum() if by else want["v"].cumsum()
        both = got.merge(want, on=["o", "g", "v"])
        assert len(both) == 500 and (both["total_x"] == both["total_y"]).all()


def test_more_ranges_than_the_text_holds(spark, rng, monkeypatch):
    monkeypatch.setattr(ordered, "LITERAL_RANGES", 2)
    rows = [(float(o), int(v), i % 2) for i, (o, v) in enumerate(zip(rng.integers(0, 90, 400), rng.integers(0, 2, 400)))]
    df = spark.createDataFrame(rows, "s double, hit int, g int").repartition(5)
    points = roc_curve(df, F.col("hit") == 1, "s", ranges=30).orderBy("fp", "tp").collect()
    hits, threshold = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    want = sorted((int((hits[threshold >= t] == 0).sum()), int((hits[threshold >= t] == 1).sum())) for t in set(threshold.tolist()))
    assert [(r["fp"], r["tp"]) for r in points] == [(0, 0), *want]
    assert auc_value(df, F.col("hit") == 1, "s", ranges=30) == pytest.approx(auc_value(df, F.col("hit") == 1, "s", ranges=2))
    left = spark.createDataFrame([(i, f"k{i % 3}", float(t)) for i, t in enumerate(rng.integers(0, 400, 200))], "id int, k string, t double")
    right = spark.createDataFrame([(f"k{i % 4}", float(t), i) for i, t in enumerate(rng.integers(50, 400, 120))], "k string, t double, v int")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(asof_join(left, right, "t", ["k"], ranges=15)) == key(asof_join(left, right, "t", ["k"], ranges=1))


def test_splits_ignore_copies(spark):
    rows = [(1.0,)] * 5000 + [(float(i),) for i in range(2, 200)]
    df = spark.createDataFrame(rows, "x double")
    splits = split_values(df, "x", 4, len(rows))
    assert len(splits) == 3 and splits == sorted(splits)


def test_asof_join_with_a_hot_key(spark, rng):
    left = [(i, "hot" if i % 3 else "cold", float(t)) for i, t in enumerate(rng.integers(0, 400, 300))]
    right = [("hot" if i % 4 else "cold", float(t), i) for i, t in enumerate(rng.integers(50, 400, 120))]
    left += [(1000, None, 3.0), (1001, "hot", None), (1002, "other", 5.0)]
    l = spark.createDataFrame(left, "id int, k string, t double").repartition(4)
    r = spark.createDataFrame(right, "k string, t double, v int").repartition(3)
    for ranges in (1, 7):
        got = {x["id"]: (x["t_right"], x["v"]) for x in asof_join(l, r, "t", ["k"], ranges=ranges).collect()}
        assert len(got) == len(left)
        for i, k, t in left:
            fits = [(rt, v) for rk, rt, v in right if rk == k and k is not None and t is not None and rt <= t]
            assert got[i] == (max(fits) if fits else (None, None))


def test_first_per_group_of_a_hot_group(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    got = first_per_group(df, ["g"], [F.col("id")], 4, F.col("id"))
    assert sorted(r["id"] for r in got.where("g = 'hot'").collect()) == [0, 3, 6, 9]
    assert got.where("g <> 'hot'").count() == 1333


def test_lookup_join_keeps_all_rows(spark):
    rows = [("hot",)] * 300 + [(f"k{i}",) for i in range(50)] + [(None,)] * 40 + [("unseen",)]
    df = spark.createDataFrame(rows, "k string")
    table = spark.createDataFrame([("hot", 1.0, 300)] + [(f"k{i}", 2.0, 1) for i in range(50)], "key string, v double, w int")
    for small in (True, False):
        out = lookup_join(df, "k", table, "key", "v", F.lit(-1.0), weight="w", small=small, into="out")
        got = {r["out"]: r["n"] for r in out.groupBy("out").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == {1.0: 300, 2.0: 50, -1.0: 41}


def test_breadcrumbs_refuse_a_cycle(spark):
    nodes = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B")], "id string, parent_id string, name string")
    try:
        catalog.breadcrumbs(nodes)
        raise AssertionError("a cycle went unnoticed")
    except ValueError as e:
        assert "cycle" in str(e)


def test_breadcrumbs_of_a_deep_tree(spark):
    # a chain of 70 nodes, 200 children of its end, and a node whose parent is missing
    nodes = [(0, None)] + [(i, i - 1) for i in range(1, 70)] + [(1000 + i, 69) for i in range(200)] + [(5000, 4999)]
    df = spark.createDataFrame([(i, p, f"n{i}") for i, p in nodes], "id int, parent_id int, name string")
    got = {r["id"]: [s["id"] for s in r["path"]] for r in catalog.breadcrumbs(df).collect()}
    chain = list(range(70))
    assert len(got) == len(nodes) and got[5000] == [5000]
    assert all(got[i] == chain[: i + 1] for i in chain)
    assert all(got[1000 + i] == chain + [1000 + i] for i in range(200))


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("copy", F.lit("same"))
    a = sampling.sample_cap(df, 100, key=["id"])
    b = sampling.sample_cap(df.repartition(13), 100, key=["id"])
    assert a.count() == 100 and {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}
    assert sampling.sample_cap(df, 9999).count() == 5000
    # a sample splits like the whole: its draws are independent of those of the split
    for key in (["id"], None):
        train, test = sampling.train_test_split(sampling.sample_cap(df, 500, key=key), key=key)
        assert train.count() + test.count() == 500 and 50 < test.count() < 150
    # copies of one row are split like any others
    copies = df.select("copy")
    assert sampling.sample_cap(copies, 100).count() == 100
    train, test = sampling.train_test_split(copies)
    assert train.count() + test.count() == 5000 and 800 < test.count() < 1200


def test_search_by_day_reaches_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = catalog.search(orders, [], "o_orderdate", day="1995-06-17")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan
    assert np.isfinite(orders.count())
