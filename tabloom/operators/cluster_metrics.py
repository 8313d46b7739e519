"""Quality of a clustering: sizes, centroid-based scores and silhouette."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import stats
from tabloom.session import materialize
from tabloom.types import as_double

BLOCK_ROWS = 2048
LARGE_BLOCK = 16_384  # points of a block of the exact silhouette, and from how many blocks on blocks grow to it
SPREAD_BLOCKS = 16
NUMBERS_AT_ONCE = 4_000_000  # distances held at once
CLOSE = 1e-6  # of the sum of squared norms: below it a matrix product has lost too many digits
PAIRS_AT_ONCE = 100_000
LARGEST = 1e100  # beyond this, squares may overflow
TILE = 512  # clusters that a point is compared with at once
ROWS_PER_TILE = 200_000


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("count"))


def _points(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    return df.select(F.col(cluster).alias("c"), *[as_double(df, x).alias(f"x{i}") for i, x in enumerate(columns)])


def centroids(points: DataFrame, d: int) -> DataFrame:
    """(c, n, m0.., s0..): rows, means and mean squares per cluster, with map-side combining."""
    return points.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)],
        *[F.var_pop(f"x{i}").alias(f"v{i}") for i in range(d)],
    )


def calinski_harabasz(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """(B / (k - 1)) / (W / (n - k)) from per-cluster means and variances."""
    d = len(columns)
    points = _points(df, columns, cluster)
    overall = stats.one_row(points, {i: F.avg(f"x{i}") for i in range(d)})
    gap = lambda i: F.pow(F.col(f"m{i}") - F.lit(overall[i]), F.lit(2))
    between = sum((gap(i) for i in range(1, d)), gap(0))
    within = sum((F.col(f"v{i}") for i in range(1, d)), F.col("v0"))
    got = centroids(points, d).agg(
        F.sum(F.col("n") * between).alias("b"),
        F.sum(F.col("n") * within).alias("w"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
    )
    score = (F.col("b") / F.nullif(F.col("k") - 1.0, F.lit(0.0))) / F.nullif(
        F.col("w") / F.nullif((F.col("n") - F.col("k")).cast("double"), F.lit(0.0)), F.lit(0.0)
    )
    return got.select(F.lit("calinski_harabasz").alias("metric"), score.alias("value"))


def davies_bouldin(df: DataFrame, columns: Sequence[str], cluster: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij. Blocks of centroids meet pairwise; a task
    returns the worst ratio of each of its clusters."""
    d = len(columns)
    points = _points(df, columns, cluster)
    x = F.array(*[F.col(f"x{i}") for i in range(d)])
    middle = materialize(points.groupBy("c").agg(F.array(*[F.avg(f"x{i}") for i in range(d)]).alias("m")))
    gap = F.sqrt(F.aggregate(F.zip_with(x, "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    # how the centroids reach the rows is left to Spark, which knows the size of the kept table
    spread = points.join(middle, "c").groupBy("c").agg(F.first("m").alias("m"), F.avg(gap).alias("s"))
    spread = materialize(spread)
    blocks = -(-spread.count() // block_rows) or 1
    placed = spread.withColumn("b", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = placed.withColumn("o", others)
    right = placed.select(F.col("c"), "m", "s", F.col("b").alias("o")).withColumn("b", others)
    kind = points.schema["c"].dataType.simpleString()

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame(columns=["c", "worst"])
        a, b = np.stack(one["m"].to_numpy()), np.stack(two["m"].to_numpy())
        squared = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            squared += np.square(a[:, j, None] - b[None, :, j])
        both = one["s"].to_numpy()[:, None] + two["s"].to_numpy()[None, :]
        ratio = np.where(squared > 0, both / np.sqrt(np.where(squared > 0, squared, 1.0)), 0.0)
        ratio[one["c"].to_numpy()[:, None] == two["c"].to_numpy()[None, :]] = 0.0
        return pd.DataFrame({"c": one["c"], "worst": ratio.max(axis=1)})

    met = left.groupBy("b", "o").cogroup(right.groupBy("b", "o")).applyInPandas(meet, f"c {kind}, worst double")
    worst = met.groupBy("c").agg(F.max("worst").alias("worst"))
    return worst.agg(F.avg("worst").alias("value")).select(F.lit("davies_bouldin").alias("metric"), "value")


def inertia(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Sum of squared distances to the centroid of the own cluster."""
    d = len(columns)
    within = sum((F.col(f"v{i}") for i in range(1, d)), F.col("v0"))
    got = centroids(_points(df, columns, cluster), d).agg(F.sum(F.col("n") * within).alias("value"))
    return got.select(F.lit("inertia").alias("metric"), "value")


def silhouette_squared(df: DataFrame, columns: Sequence[str], cluster: str, tile: int = TILE) -> DataFrame:
    """Mean silhouette under squared distances, in one pass per row: the mean squared
    distance to a cluster follows from its mean and variance, so cost grows with
    rows x clusters only. This is the form for large data.

    Up to ``tile`` clusters are one short table that every task gets. More of them are cut into
    tiles: every distinct point meets every tile in tasks of bounded size and keeps one number
    per tile."""
    d = len(columns)
    points = _points(df, columns, cluster)
    within = sum((F.col(f"v{i}") for i in range(1, d)), F.col("v0"))
    table = centroids(points, d).select("c", "n", within.alias("v"), F.array(*[F.col(f"m{i}") for i in range(d)]).alias("m"))
    table = materialize(table)
    clusters = table.count()
    x = F.array(*[F.col(f"x{i}") for i in range(d)])

    def apart(s):
        return s["v"] + F.aggregate(F.zip_with("x", s["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)

    def inside(s):
        return apart(s) * s["n"] / F.nullif(s["n"] - 1, F.lit(0))

    one = F.struct("c", "n", "v", "m")
    if clusters <= tile:
        # one row holding one struct per cluster, of which there are `tile` at most
        every = table.agg(F.collect_list(one).alias("all"))
        rows = points.select("c", x.alias("x")).join(F.broadcast(every))
        own = F.get(F.filter("all", lambda s: s["c"] == F.col("c")), F.lit(0))
        other = F.array_min(F.transform(F.filter("all", lambda s: s["c"] != F.col("c")), apart))
        rows = rows.select(own["n"].alias("n"), inside(own).alias("a"), other.alias("b"), F.lit(1).alias("w"))
    else:
        tiles = -(-clusters // tile)
        held = table.withColumn("tile", F.pmod(F.xxhash64("c"), F.lit(tiles)).cast("int"))
        held = held.groupBy("tile").agg(F.collect_list(one).alias("all"))  # about `tile` clusters each
        distinct = materialize(points.groupBy("c", *[f"x{i}" for i in range(d)]).agg(F.count(F.lit(1)).alias("w")).select("c", x.alias("x"), "w"))
        salts = max(1, -(-distinct.count() // ROWS_PER_TILE))
        asked = distinct.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int"))
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = asked.join(held, ["tile", "salt"])
        own = F.get(F.filter("all", lambda s: s["c"] == F.col("c")), F.lit(0))
        other = F.array_min(F.transform(F.filter("all", lambda s: s["c"] != F.col("c")), apart))
        met = met.select("c", "x", "w", own["n"].alias("n"), inside(own).alias("a"), other.alias("b"))
        rows = met.groupBy("c", "x").agg(F.first("w").alias("w"), F.max("n").alias("n"), F.max("a").alias("a"), F.min("b").alias("b"))
    score = F.when(F.col("n") == 1, 0.0).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    )
    mean = F.sum(score * F.col("w")) / F.sum("w")
    return rows.agg(mean.alias("value")).select(F.lit("silhouette_squared").alias("metric"), "value")


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances [a, b] by a matrix product; where it loses digits, pairs close to each other
    for their distance from the origin, coordinate by coordinate."""
    if not max(np.abs(a).max(), np.abs(b).max()) < LARGEST:
        with np.errstate(all="ignore"):
            return np.sqrt(sum(np.square(a[:, j, None] - b[None, :, j]) for j in range(a.shape[1])))
    top = np.square(a).sum(1)[:, None] + np.square(b).sum(1)
    squared = np.maximum(top - 2.0 * (a @ b.T), 0.0)
    i, j = np.nonzero(squared <= CLOSE * top)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        r, c = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
        squared[r, c] = np.square(a[r] - b[c]).sum(1)
    return np.sqrt(squared, out=squared)


def silhouette(df: DataFrame, columns: Sequence[str], cluster: str, block_rows: int | None = None) -> DataFrame:
    """Mean silhouette under plain Euclidean distances.

    The mean of unsquared distances has no closed form, so every point must meet every
    other one: work grows with the square of the rows, which is why evaluation takes a
    held-out split and :func:`silhouette_squared` exists for large data. Points with equal
    coordinates and cluster are combined first. Blocks of bounded size meet pairwise; a
    task adds up distances per point and cluster and never emits a pair.
    """
    d = len(columns)
    # two independent hashes name a distinct point
    content = F.concat(*[F.hex(F.xxhash64("c", *[f"x{i}" for i in range(d)], F.lit(seed))) for seed in (1, 2)])
    points = (
        _points(df, columns, cluster)
        .groupBy("c", *[f"x{i}" for i in range(d)])
        .agg(F.count(F.lit(1)).alias("w"))
        .select(content.alias("k"), F.col("c").cast("string").alias("c"), "w", F.array(*[F.col(f"x{i}") for i in range(d)]).alias("x"))
    )
    points = materialize(points)
    n = points.count()
    # few large blocks, as every point is sent and reported once per block; but enough of them for many tasks
    blocks = -(-n // (block_rows or LARGE_BLOCK)) or 1
    if block_rows is None:
        blocks = max(blocks, min(SPREAD_BLOCKS, -(-n // BLOCK_ROWS)))
    placed = points.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = placed.withColumn("o", others)
    right = placed.withColumnRenamed("b", "o").withColumn("b", others)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["k", "c", "w", "oc", "total", "n"])
        ax, bx = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        b = b.assign(c=b["c"].astype(object))
        at, names = pd.factorize(b["c"])  # rows without a cluster stand in none
        known = at >= 0
        bx, at, weight = bx[known], at[known], b["w"].to_numpy()[known]
        order = np.argsort(at, kind="stable")
        bx, at, weight = bx[order], at[order], weight[order].astype(float)
        if not len(at):
            return pd.DataFrame(columns=["k", "c", "w", "oc", "total", "n"])
        starts = np.searchsorted(at, np.arange(len(names)))
        if max(np.abs(ax).max(), np.abs(bx).max()) < LARGEST:  # all of them numbers
            middle = bx.mean(0)
            ax, bx = ax - middle, bx - middle
        rows = max(1, NUMBERS_AT_ONCE // len(bx))
        sums = [np.add.reduceat(_reach(ax[r : r + rows], bx) * weight, starts, axis=1) for r in range(0, len(ax), rows)]
        size = np.add.reduceat(weight, starts).astype(np.int64)
        # a row per point of this block and cluster of the other one
        times = len(names)
        own = a[["k", "c", "w"]].iloc[np.repeat(np.arange(len(a)), times)].reset_index(drop=True)
        return own.assign(oc=np.tile(np.asarray(names, dtype=object), len(a)), total=np.concatenate(sums).ravel(), n=np.tile(size, len(a)))

    met = left.groupBy("b", "o").cogroup(right.groupBy("b", "o")).applyInPandas(
        meet, "k string, c string, w bigint, oc string, total double, n bigint"
    )
    per = met.groupBy("k", "c", "w", "oc").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("oc") == F.col("c")
    rows = per.groupBy("k", "c", "w").agg(
        F.max(F.when(same, F.col("n"))).alias("n"),
        F.max(F.when(same, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
    )
    score = F.when(F.col("n") == 1, 0.0).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    )
    return rows.agg((F.sum(score * F.col("w")) / F.sum("w")).alias("value")).select(F.lit("silhouette_score").alias("metric"), "value")
