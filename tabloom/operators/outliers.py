"""Clipping or replacing outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tabloom.errors import PrepareError
from tabloom.functions import stats
from tabloom.operators.profile import FENCE, Z_LIMIT
from tabloom.plans.steps import Step, number, sql_double
from tabloom.types import dtype_of, is_numeric

STEP = "outliers"
OPS = ["iqr", "zscore", "replace_mean", "replace_median", "replace_mode", "replace_constant"]


def _clip(x: str, low: float, high: float) -> str:
    # greatest and least skip NULLs, hence the guard
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {number(high)}), {number(low)}) END"


def fit_outliers(df: DataFrame, attributes: Sequence[str], op: str, values: Mapping[str, float] | None = None) -> Step:
    attributes = list(attributes)
    if op not in OPS:
        raise PrepareError(STEP, op, "Unknown operation.")
    if any(not is_numeric(dtype_of(df, a)) for a in attributes):
        raise PrepareError(STEP, op, "Attribute is not numeric")
    replace: dict[str, str] = {}
    if op == "zscore":
        m = stats.moments(df, attributes)
        for a in attributes:
            if m[a].std:
                low, high = m[a].mean - Z_LIMIT * m[a].std, m[a].mean + Z_LIMIT * m[a].std
                replace[a] = _clip(sql_double(df, a), low, high)
        return Step(STEP, op, replace=replace)

    q = stats.quantiles(df, {a: [0.25, 0.5, 0.75] for a in attributes})
    fill: dict[str, float] = {}
    if op == "replace_mean":
        fill = {a: s.mean for a, s in stats.moments(df, attributes).items()}
    elif op == "replace_median":
        fill = {a: q[a][1] for a in attributes}
    elif op == "replace_mode":
        fill = stats.modes(df, attributes, as_numbers=True)
    elif op == "replace_constant":
        if not values:
            raise PrepareError(STEP, op, "Replacing by a constant needs a value per column.")
        fill = {a: float(values[a]) for a in attributes if a in values}
    for a in attributes:
        q1, _, q3 = q[a]
        if q1 is None:
            continue
        low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
        x = sql_double(df, a)
        if op == "iqr":
            replace[a] = _clip(x, low, high)
        elif a in fill:
            # missing cells get the same value, except for a plain constant
            missing = "" if op == "replace_constant" else f" OR {x} IS NULL"
            outside = f"{x} < {number(low)} OR {x} > {number(high)}{missing}"
            replace[a] = f"CASE WHEN {outside} THEN {number(fill[a])} ELSE {x} END"
    return Step(STEP, op, replace=replace)
