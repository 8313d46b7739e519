"""Balancing classes by synthetic rows or by weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import PrepareError
from tabloom.functions import stats
from tabloom.functions.ordered import running_sums
from tabloom.operators.knn import CELL_ROWS, nearest, vector
from tabloom.operators.profile import class_weights
from tabloom.plans.steps import Step
from tabloom.session import materialize
from tabloom.types import as_double, col, dtype_of, null_safe_text

STEP = "imbalanced_data"
NEIGHBOURS = 5
MAX_CLASSES = 20
COPIES_PER_ROW = 1_000_000


def check_target(df: DataFrame, features: Sequence[str], target: str | None) -> str:
    if not target or target not in df.columns:
        raise PrepareError(STEP, None, "Imbalanced data handling requires a target column.")
    if stats.null_counts(df, [target])[target]:
        raise PrepareError(STEP, None, "Target column contains missing values. Apply imputation first (Step 3).")
    if not features:
        raise PrepareError(STEP, None, "No feature columns available after excluding target column.")
    kind = dtype_of(df, target).simpleString().split("(")[0]
    if kind in ("float", "double", "decimal") or stats.distinct_counts(df, [target])[target] > MAX_CLASSES:
        raise PrepareError(STEP, None, "Imbalanced data handling requires a categorical target column.")
    return target


def smote(df: DataFrame, features: Sequence[str], target: str, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Raise every class to the size of the largest one by points between a row and one
    of its nearest neighbours of the same class. Returns features and target only.

    Rows with equal features count as copies of one point, so that a class made of many
    copies costs one search. All choices derive from hashes of the rows and the seed.
    """
    features = list(features)
    check_target(df, features, target)
    if any(stats.null_counts(df, features).values()):
        raise PrepareError(STEP, "smote", "SMOTE requires no missing values. Apply imputation first (Step 3).")
    rows = df.select(*[as_double(df, c).alias(c) for c in features], col(target).alias(target))
    sizes = {r["_c"]: r["n"] for r in rows.groupBy(null_safe_text(target).alias("_c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    largest, smallest = max(sizes.values()), min(sizes.values())
    k = min(NEIGHBOURS, smallest - 1)
    if k < 1:
        raise PrepareError(STEP, "smote", f"SMOTE requires at least 2 samples in minority class. Found: {smallest}.")
    short = {c: largest - n for c, n in sizes.items() if n < largest}
    if not short:
        return rows
    points = (
        rows.withColumn("part", null_safe_text(target))
        .where(F.col("part").isin(list(short)))
        .groupBy("part", *[col(c) for c in features])
        .agg(F.count(F.lit(1)).alias("weight"), F.first(col(target)).alias("_target"))
        .withColumn("vec", vector([col(c) for c in features]))
    )
    key = F.concat_ws("-", F.hex(F.xxhash64("part", "vec", F.lit(seed))), F.hex(F.xxhash64("part", "vec", F.lit(seed + 1))))
    points = materialize(points.select(key.alias("key"), "part", "vec", "weight", "_target"))
    # every row of a class starts the same number of new rows; the first `rest` rows in
    # key order start one more
    placed = running_sums(points, "key", {"upto": "weight"}, by=["part"])
    share, rest = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for c, gap in short.items():
        share = F.when(F.col("part") == c, F.lit(gap // sizes[c]).cast("bigint")).otherwise(share)
        rest = F.when(F.col("part") == c, F.lit(gap % sizes[c]).cast("bigint")).otherwise(rest)
    extra = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("weight"), rest - (F.col("upto") - F.col("weight"))))
    starts = placed.withColumn("births", F.col("weight") * share + extra).where(F.col("births") > 0)
    found = nearest(
        starts.select(F.col("key").alias("qid"), "vec", "part"),
        points.select(F.col("key").alias("tid"), "vec", "part", "weight", F.col("vec").alias("payload")),
        k,
        skip_self=True,
        cell_rows=cell_rows,
    )
    # at most k neighbours per point, each repeated by its copies
    listed = found.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("dist", "tid", F.col("payload").alias("vec"), F.col("taken").cast("int").alias("taken")))).alias("near")
    ).select("qid", F.flatten(F.transform("near", lambda s: F.array_repeat(s["vec"], s["taken"]))).alias("near"))
    based = starts.join(listed, starts["key"] == listed["qid"])
    # a point with many births is first cut into pieces, so that no task writes them all
    pieces = based.select(
        "key", "_target", "vec", "near", "births",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("births") - 1) / COPIES_PER_ROW))).alias("piece"),
    ).repartition("key", "piece")
    born = pieces.select(
        "key", "_target", "vec", "near",
        F.explode(
            F.sequence(
                F.col("piece") * COPIES_PER_ROW,
                F.least((F.col("piece") + 1) * COPIES_PER_ROW, F.col("births")) - 1,
            )
        ).alias("i"),
    )
    partner = F.get("near", F.pmod(F.xxhash64("key", "i", F.lit(seed)), F.size("near")).cast("int"))
    step = F.pmod(F.xxhash64("i", "key", F.lit(seed + 7)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    moved = F.zip_with("vec", partner, lambda a, b: a + F.col("_u") * (b - a))
    synthetic = born.withColumn("_u", step).withColumn("_new", moved)
    return rows.unionByName(
        synthetic.select(*[F.get("_new", F.lit(i)).alias(c) for i, c in enumerate(features)], F.col("_target").alias(target))
    )


def fit_smote(features: Sequence[str], target: str, seed: int = 42) -> Step:
    return Step(STEP, "smote", rows_only_in_fit=lambda df: smote(df, features, target, seed))

