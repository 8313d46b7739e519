"""k nearest neighbours: joins, votes and means over an exact index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.neighbour_index import CELL_ROWS, Metric, NeighbourIndex


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    metric: Metric = Metric("euclidean"),
    skip_self: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(qid, tid, dist, weight, payload, taken) of the k nearest training rows per query: an index
    that is built and asked once (see ``NeighbourIndex``)."""
    return NeighbourIndex.build(train, metric, cell_rows).nearest(queries, k, skip_self)


def vector(columns: Sequence[Column]) -> Column:
    """Coordinates as one array; missing ones as NaN."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in columns])


def knn_join(
    queries: DataFrame, train: DataFrame, q_id: str, t_id: str, vec: str, k: int, metric: Metric = Metric("euclidean"),
    skip_self: bool = False, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(q_id, rank, t_id as neighbor, dist) for the k nearest rows of ``train``."""
    asked = queries.select(F.col(q_id).alias("qid"), F.col(vec).cast("array<double>").alias("vec"))
    known = train.select(F.col(t_id).alias("tid"), F.col(vec).cast("array<double>").alias("vec"))
    found = nearest(asked, known, k, metric, skip_self, cell_rows)
    order = Window.partitionBy("qid").orderBy("dist", "tid")  # k rows per query
    return found.select(
        F.col("qid").alias(q_id), F.row_number().over(order).cast("bigint").alias("rank"), F.col("tid").alias("neighbor"), "dist"
    )


def votes(found: DataFrame, weights: str = "uniform") -> DataFrame:
    """(qid, label, vote) from neighbours whose payload is the label."""
    return found.groupBy("qid", F.col("payload").alias("label")).agg(F.sum(_vote(weights)).alias("vote"))


def _vote(weights: str) -> Column:
    if weights == "uniform":
        return F.col("taken").cast("double")
    if weights == "distance":
        # a neighbour at distance zero outvotes all others
        return F.col("taken") * F.when(F.col("dist") == 0, F.lit(1e300)).otherwise(1.0 / F.nullif("dist", F.lit(0.0)))
    raise ValueError(f"unknown weights {weights!r}")


def classify(found: DataFrame, weights: str = "uniform") -> DataFrame:
    """(qid, prediction, share): the label with most votes, the smallest one on ties."""
    counted = votes(found, weights)
    best = F.min(F.struct((-F.col("vote")).alias("neg"), F.col("label").alias("label")))
    return counted.groupBy("qid").agg(best.alias("b"), F.sum("vote").alias("total")).select(
        "qid", F.col("b.label").alias("prediction"), (-F.col("b.neg") / F.col("total")).alias("share")
    )


def regress(found: DataFrame, weights: str = "uniform") -> DataFrame:
    """(qid, prediction): the weighted mean of the neighbours' payloads."""
    if weights == "distance":
        exact = F.sum(F.when(F.col("dist") == 0, F.col("taken")))
        at_zero = F.sum(F.when(F.col("dist") == 0, F.col("taken") * F.col("payload"))) / exact
        pull = F.col("taken") / F.nullif("dist", F.lit(0.0))
        return found.groupBy("qid").agg(
            F.coalesce(at_zero, F.sum(pull * F.col("payload")) / F.sum(pull)).alias("prediction")
        )
    return found.groupBy("qid").agg((F.sum(F.col("taken") * F.col("payload")) / F.sum("taken")).alias("prediction"))
