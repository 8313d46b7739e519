"""From columns to a feature vector, as stages that Spark ML can store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import TrainError
from tabloom.functions import stats
from tabloom.plans.steps import number, sql_double
from tabloom.types import as_double, col, columns_of_kind, nan_to_null, quoted

MAX_CATEGORIES = 100_000
FEATURES = "_features"


def feature_columns(df: DataFrame, target: str | None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) inputs; dates and nested columns are not used."""
    numeric = [c for c in columns_of_kind(df, "numeric") if c != target]
    text = [c for c in columns_of_kind(df, "categorical") if c != target]
    if not numeric and not text:
        raise TrainError("No usable feature columns.")
    return numeric, text


def fit_features(
    train: DataFrame, numeric: Sequence[str], text: Sequence[str], scale: bool = True, drop_first: bool = False
) -> PipelineModel:
    """Median fill and standardisation for numbers, 'missing' and one-hot for text, all
    learned from ``train``. Unseen categories give zeros."""
    numeric, text = list(numeric), list(text)
    rough = stats.one_row(train, {c: F.approx_count_distinct(col(c)) for c in text})
    wide = [c for c in text if rough[c] > MAX_CATEGORIES]
    if wide:
        raise TrainError(f"Columns {wide} have more than {MAX_CATEGORIES} categories; encode or drop them first.")
    exprs = []
    if numeric:
        m = stats.moments(train, numeric)
        q = stats.quantiles(train, {c: [0.5] for c in numeric}, {c: m[c].n for c in numeric})
        filled = train.select(
            *[F.coalesce(as_double(train, c), F.lit(q[c][0] if q[c][0] is not None else 0.0)).alias(c) for c in numeric]
        )
        f = m if not any(m[c].nulls for c in numeric) else stats.moments(filled, numeric)
        for i, c in enumerate(numeric):
            x = f"coalesce(nanvl({sql_double(train, c)}, NULL), {number(q[c][0] or 0.0)})"
            if scale:
                x = f"({x} - {number(f[c].mean or 0.0)}) / {number(f[c].std_pop or 1.0)}"
            exprs.append(f"{x} AS _n{i}")
    exprs += [f"coalesce({quoted(c)}, 'missing') AS _t{i}" for i, c in enumerate(text)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    frame = stages[0].transform(train)
    inputs = [f"_n{i}" for i in range(len(numeric))]
    if text:
        indexer = StringIndexer(
            inputCols=[f"_t{i}" for i in range(len(text))],
            outputCols=[f"_i{i}" for i in range(len(text))],
            stringOrderType="alphabetDesc" if drop_first else "alphabetAsc",
            handleInvalid="error" if drop_first else "keep",
        ).fit(frame)
        stages.append(indexer)
        frame = indexer.transform(frame)
        # the last slot is dropped: normally the one of unseen values, so that k known
        # categories keep k columns; in descending order without it, the first category
        hot = OneHotEncoder(inputCols=indexer.getOutputCols(), outputCols=[f"_h{i}" for i in range(len(text))], dropLast=True).fit(frame)
        stages.append(hot)
        inputs += hot.getOutputCols()
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return PipelineModel(stages)


def internal_columns(df: DataFrame) -> list[str]:
    import re

    return [c for c in df.columns if re.fullmatch(r"_[ntih]\d+", c)]


def with_features(stages: PipelineModel, df: DataFrame) -> DataFrame:
    out = stages.transform(nan_to_null(df))
    return out.drop(*internal_columns(out))
