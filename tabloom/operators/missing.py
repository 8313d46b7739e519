"""Filling or dropping missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tabloom.errors import PrepareError
from tabloom.functions import stats
from tabloom.plans.steps import Step, number, sql_double, text
from tabloom.types import dtype_of, is_numeric, quoted

STEP = "missing_values"


def drop_rows(df: DataFrame, attributes: Sequence[str]) -> Step:
    return Step(STEP, "drop_rows", where=" AND ".join(f"{quoted(a)} IS NOT NULL" for a in attributes) or None)


def _literal(df: DataFrame, column: str, value) -> str:
    dtype = dtype_of(df, column)
    return f"CAST({text(value)} AS {dtype.simpleString()})"


def fit_fill(df: DataFrame, attributes: Sequence[str], op: str, values: Mapping[str, object] | None = None) -> Step:
    """mean, median, mode or constant, all columns from one set of statistics."""
    attributes = list(attributes)
    replace: dict[str, str] = {}
    if op in ("mean", "median"):
        for a in attributes:
            if not is_numeric(dtype_of(df, a)):
                raise PrepareError(STEP, op, f"{op.capitalize()} imputation requires numeric columns. '{a}' is not numeric.")
        if op == "mean":
            m = stats.moments(df, attributes)
            fill = {a: m[a].mean for a in attributes}
        else:
            q = stats.quantiles(df, {a: [0.5] for a in attributes})
            fill = {a: q[a][0] for a in attributes}
        for a, v in fill.items():
            if v is not None:
                replace[a] = f"coalesce({sql_double(df, a)}, {number(v)})"
    elif op == "mode":
        numbers = [a for a in attributes if is_numeric(dtype_of(df, a), with_bool=False)]
        others = [a for a in attributes if a not in numbers]
        found = {**stats.modes(df, numbers, True), **stats.modes(df, others, False)}
        for a, v in found.items():
            replace[a] = f"coalesce({quoted(a)}, {_number_as(df, a, v) if a in numbers else _literal(df, a, v)})"
    elif op == "constant":
        if not values:
            raise PrepareError(STEP, op, "Constant imputation needs a value per column.")
        for a in attributes:
            if a in values:
                replace[a] = f"coalesce({quoted(a)}, {_literal(df, a, values[a])})"
    else:
        raise PrepareError(STEP, op, "Unknown operation.")
    return Step(STEP, op, replace=replace)


def _number_as(df: DataFrame, column: str, value: float) -> str:
    return f"CAST({number(value)} AS {dtype_of(df, column).simpleString()})"
