"""Fitted steps: what a preparation learned, as SQL expressions and lookup tables.

A step is plain data, so it can be stored next to a model and applied to later
batches or to a stream exactly as it was applied to the data it was fitted on.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.lookup import BROADCAST_ROWS, fits_broadcast, hot_keys, lookup_join
from tabloom.operators.knn_impute import NeighbourFill
from tabloom.session import materialize
from tabloom.types import col, nan_to_null, quoted


def number(value: float) -> str:
    """A DOUBLE literal in SQL text."""
    return f"{float(value)!r}D"


def text(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


ARITHMETIC_TERMS = 256


@dataclass
class LookupTable:
    """(k, v, w): category, its value and its row count. Small tables (checked) are held
    as a local relation and broadcast; large ones are checkpointed and shuffled."""

    frame: DataFrame
    small: bool
    found: list | None = None

    def hot(self) -> list | None:
        """The hottest keys of a large table, looked for once."""
        if self.found is None and not self.small:
            self.found = hot_keys(self.frame, "k", "w")
        return self.found

    @classmethod
    def freeze(cls, frame: DataFrame) -> "LookupTable":
        kept = materialize(frame)
        if not fits_broadcast(kept, "k"):
            return cls(kept, False)
        rows = kept.limit(BROADCAST_ROWS + 1).collect()
        return cls(frame.sparkSession.createDataFrame(rows, frame.schema), True)


@dataclass
class Projection:
    """New columns ``(columns - centre) @ weights``. Small ones are plain arithmetic inside
    generated code; large ones are one matrix product per Arrow batch."""

    columns: list[str]
    centre: list[float]
    weights: list[list[float]]  # one list per input column
    names: list[str]

    def apply(self, df: DataFrame, drop: list[str]) -> DataFrame:
        kept = [col(c) for c in df.columns if c not in drop]
        if len(self.columns) * len(self.names) <= ARITHMETIC_TERMS:
            return df.select(*kept, *[F.expr(sql).alias(name) for name, sql in self.sql(df)])
        centre, weights = np.array(self.centre), np.array(self.weights)

        @F.pandas_udf("array<double>")
        def product(x: pd.DataFrame) -> pd.Series:
            return pd.Series(list((x.to_numpy(dtype=float) - centre) @ weights))

        inputs = F.struct(*[F.expr(sql_double(df, c)).alias(f"x{i}") for i, c in enumerate(self.columns)])
        wide = df.select(*kept, product(inputs).alias("_projected"))
        kept = [col(c) for c in df.columns if c not in drop]
        return wide.select(*kept, *[F.get("_projected", F.lit(k)).alias(n) for k, n in enumerate(self.names)])

    def sql(self, df: DataFrame) -> list[tuple[str, str]]:
        centred = [f"({sql_double(df, c)} - {number(m)})" for c, m in zip(self.columns, self.centre)]
        return [
            (name, " + ".join(f"{x} * {number(row[k])}" for x, row in zip(centred, self.weights)))
            for k, name in enumerate(self.names)
        ]


@dataclass
class Step:
    """One fitted operation.

    ``replace`` and ``add`` map column names to SQL over the incoming columns,
    ``drop`` removes columns, ``where`` keeps matching rows, ``lookups`` replaces
    categories by values, ``projection`` adds linear combinations, ``fill`` takes missing numbers from
    neighbours. ``rows_only_in_fit`` marks changes of the fitted data that must not be repeated on later data
    (de-duplication, synthetic rows).
    """

    step: str
    op: str
    replace: dict[str, str] = field(default_factory=dict)
    add: list[tuple[str, str]] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    where: str | None = None
    lookups: list[tuple[str, LookupTable, float | None, bool]] = field(default_factory=list)
    projection: Projection | None = None
    fill: NeighbourFill | None = None
    rows_only_in_fit: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, df: DataFrame, fitting: bool = False) -> DataFrame:
        if self.rows_only_in_fit is not None:
            return self.rows_only_in_fit(df) if fitting else df
        if self.where:
            df = df.where(self.where)
        for column, table, default, null_text in self.lookups:
            if null_text:
                df = df.withColumn(column, F.coalesce(col(column).cast("string"), F.lit("nan")))
            df = lookup_join(
                df, column, table.frame, "k", "v", None if default is None else F.lit(default), "w", table.small, hot=table.hot()
            )
        if self.fill is not None:
            return self.fill.apply(df)
        if self.projection is not None:
            return self.projection.apply(df, self.drop)
        if self.replace or self.add or self.drop:
            gone = set(self.drop)
            kept = [
                F.expr(self.replace[c]).alias(c) if c in self.replace else col(c) for c in df.columns if c not in gone
            ]
            df = df.select(*kept, *[F.expr(sql).alias(name) for name, sql in self.add])
        return df


@dataclass
class FittedPreparation:
    """All steps in the order they were fitted."""

    steps: list[Step]

    @property
    def asks_neighbours(self) -> bool:
        return any(s.fill is not None for s in self.steps)

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply to later rows: no statistic is recomputed. A stream can be given too, unless a step
        ``asks_neighbours``; those need its batches (see ``prepare_stream``)."""
        df = nan_to_null(df)
        for step in self.steps:
            df = step.apply(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        described = []
        for i, s in enumerate(self.steps):
            if s.rows_only_in_fit is not None:
                continue
            if s.fill is not None:
                s.fill.save(spark, f"{path}/neighbours-{i}")
            tables = []
            for j, (column, table, default, null_text) in enumerate(s.lookups):
                table.frame.write.parquet(f"{path}/lookup-{i}-{j}")
                tables.append([column, f"lookup-{i}-{j}", table.small, default, null_text])
            described.append(
                {"step": s.step, "op": s.op, "replace": s.replace, "add": s.add, "drop": s.drop, "where": s.where, "lookups": tables,
                 "projection": asdict(s.projection) if s.projection else None, "fill": f"neighbours-{i}" if s.fill else None}
            )
        spark.createDataFrame([(json.dumps(described),)], "steps string").coalesce(1).write.parquet(f"{path}/steps")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedPreparation":
        steps = []
        for d in json.loads(spark.read.parquet(f"{path}/steps").first()["steps"]):
            lookups = [
                (column, LookupTable(spark.read.parquet(f"{path}/{where}"), small), default, null_text)
                for column, where, small, default, null_text in d["lookups"]
            ]
            add = [(n, e) for n, e in d["add"]]
            projection = Projection(**d["projection"]) if d["projection"] else None
            fill = NeighbourFill.load(spark, f"{path}/{d['fill']}") if d["fill"] else None
            steps.append(Step(d["step"], d["op"], d["replace"], add, d["drop"], d["where"], lookups, projection, fill))
        return cls(steps)


def sql_double(df: DataFrame, name: str) -> str:
    """SQL for a numeric column as DOUBLE (booleans as 0/1)."""
    if df.schema[name].dataType.simpleString() == "boolean":
        return f"CAST(CAST({quoted(name)} AS INT) AS DOUBLE)"
    return f"CAST({quoted(name)} AS DOUBLE)"
