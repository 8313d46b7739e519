"""Scaling numeric columns by statistics of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabloom.errors import PrepareError
from tabloom.functions import stats
from tabloom.plans.steps import Step, number, sql_double
from tabloom.types import dtype_of, is_numeric

STEP = "scaling"
OPS = ["minmax", "zscore_scale", "standard", "robust", "maxabs"]


def fit_scale(df: DataFrame, attributes: Sequence[str], op: str) -> Step:
    attributes = list(attributes)
    if op not in OPS:
        raise PrepareError(STEP, op, "Unknown operation.")
    for a in attributes:
        if not is_numeric(dtype_of(df, a)):
            raise PrepareError(STEP, op, f"Attribute '{a}' is not numeric. Scaling requires numeric data.")
    m = stats.moments(df, attributes)
    if any(m[a].nulls for a in attributes):
        raise PrepareError(STEP, op, "Scaling requires no missing values. Please apply missing value imputation first.")
    if op == "minmax":
        constant = [a for a in attributes if m[a].n and m[a].min == m[a].max]
        if constant:
            raise PrepareError(STEP, op, f"Columns {constant} have zero variance and cannot be MinMax scaled.")
    centre = {a: 0.0 for a in attributes}
    width = {a: 1.0 for a in attributes}
    known = [a for a in attributes if m[a].n]
    if op == "robust":
        q = stats.quantiles(df, {a: [0.25, 0.5, 0.75] for a in known}, {a: m[a].n for a in known})
    for a in known:
        if op == "minmax":
            centre[a], width[a] = m[a].min, m[a].max - m[a].min
        elif op in ("zscore_scale", "standard"):
            centre[a], width[a] = m[a].mean, m[a].std_pop
        elif op == "robust":
            centre[a], width[a] = q[a][1], q[a][2] - q[a][0]
        else:
            width[a] = max(abs(m[a].min), abs(m[a].max))
    return Step(
        STEP,
        op,
        replace={
            a: f"({sql_double(df, a)} - {number(centre[a])}) / {number(width[a] or 1.0)}" for a in attributes
        },
    )
