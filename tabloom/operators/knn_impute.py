"""Filling missing numbers from the five nearest rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import stats
from tabloom.functions.lookup import lookup_join
from tabloom.operators.knn import CELL_ROWS, Metric, vector
from tabloom.operators.neighbour_index import NeighbourIndex
from tabloom.session import stored
from tabloom.types import as_double, col, numeric_columns

NEIGHBOURS = 5


def _content_key(columns: Sequence[str]) -> Column:
    """Equal numbers get equal keys; two independent 64-bit hashes keep others apart."""
    cells = [F.coalesce(col(c).cast("string"), F.lit("-")) for c in columns]
    both = [F.hex(F.xxhash64(*cells, F.lit(seed))) for seed in (1, 2)]
    return F.concat_ws("-", *both)


@dataclass
class NeighbourFill:
    """What a neighbour imputation learned: the distinct rows as an index, and the column means.

    A missing value becomes the mean over the nearest rows that have it (distance over the
    coordinates both rows have, scaled up for the missing ones). Where no such row shares a
    coordinate with it, it becomes the column mean. The rows learned from are filled in the same
    way as later ones: a row never counts for a value it lacks."""

    columns: list[str]
    means: dict[str, float | None]
    index: NeighbourIndex
    k: int = NEIGHBOURS

    @classmethod
    def fit(cls, df: DataFrame, k: int = NEIGHBOURS, cell_rows: int = CELL_ROWS) -> NeighbourFill | None:
        """Learn from all numeric columns; None if there are none. Rows with equal numbers are one
        entry of the index and weigh as many copies."""
        columns = numeric_columns(df)
        if not columns:
            return None
        numbers = df.select(*[as_double(df, c).alias(c) for c in columns])
        means = stats.one_row(numbers, {c: F.avg(col(c)) for c in columns})
        distinct = numbers.groupBy(_content_key(columns).alias("tid")).agg(
            F.count(F.lit(1)).alias("weight"), *[F.first(col(c)).alias(c) for c in columns]
        )
        known = stored(distinct.select("tid", "weight", vector([col(c) for c in columns]).alias("vec")), "donors")
        return cls(columns, means, NeighbourIndex.build(known, Metric("nan_euclidean"), cell_rows), k)

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows with their missing numbers filled, those learned from or any others. Fitted columns
        become DOUBLE; one that df lacks counts as missing and is not added."""
        there = [c for c in self.columns if c in df.columns]
        cells = [col(c) if c in there else F.lit(None).cast("double") for c in self.columns]
        as_doubles = df.select(*[as_double(df, c).alias(c) if c in there else col(c) for c in df.columns])
        broken = F.lit(False)
        for c in there:
            broken = broken | col(c).isNull()
        # always true, but it keeps the optimizer from rewriting the condition once per set of renamed columns
        broken = F.when(F.rand(1) >= 0, broken)
        # the rows with gaps, kept: they are searched for and filled
        keyed = stored(as_doubles.where(broken).withColumn("_key", _content_key(there)), "gaps")
        asked = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("w"), F.first(vector(cells)).alias("vec"))
        asked = stored(asked, "asked")
        wanted = F.array(*[F.lit(self.columns.index(c)) for c in there])
        queries = asked.select("_key", "vec", F.explode(F.filter(wanted, lambda j: F.isnan(F.get("vec", j)))).alias("need"))
        queries = queries.select(F.concat_ws("#", "_key", "need").alias("qid"), "vec", "need")
        found = self.index.nearest(queries, self.k)
        means = found.groupBy("qid").agg((F.sum(F.col("taken") * F.col("payload")) / F.sum("taken")).alias("v"))
        per_key = (
            means.select(F.split("qid", "#")[0].alias("k"), F.split("qid", "#")[1].cast("int").alias("need"), "v")
            .groupBy("k")
            .agg(F.map_from_entries(F.collect_list(F.struct("need", "v"))).alias("v"))  # one entry per column
        )
        per_key = stored(per_key.join(asked.select(F.col("_key").alias("k"), "w"), "k"), "fills")
        filled = lookup_join(keyed, "_key", per_key, "k", "v", weight="w", into="_fill")

        def value(c: str) -> Column:
            found = F.try_element_at("_fill", F.lit(self.columns.index(c)))
            return F.coalesce(col(c), found, F.lit(self.means[c]).cast("double")).alias(c)

        return as_doubles.where(~broken).unionByName(filled.select(*[value(c) if c in there else col(c) for c in df.columns]))

    def save(self, spark: SparkSession, path: str) -> None:
        about = json.dumps({"columns": self.columns, "means": self.means, "k": self.k})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{path}/fill")
        self.index.save(f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourFill:
        about = json.loads(spark.read.parquet(f"{path}/fill").first()["about"])
        return cls(about["columns"], about["means"], NeighbourIndex.load(spark, f"{path}/index"), about["k"])


def impute_knn(df: DataFrame, k: int = NEIGHBOURS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Learn a ``NeighbourFill`` from the frame and fill it."""
    columns = numeric_columns(df)
    if not any(stats.null_counts(df, columns).values()):
        return df.select(*[as_double(df, c).alias(c) if c in columns else col(c) for c in df.columns])
    return NeighbourFill.fit(df, k, cell_rows).apply(df)
