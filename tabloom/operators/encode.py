"""Encoding categories as numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import PrepareError
from tabloom.functions import stats
from tabloom.functions.ordered import running_sums
from tabloom.plans.steps import LookupTable, Step, text
from tabloom.session import materialize
from tabloom.types import as_double, col, dtype_of, is_numeric, quoted

STEP = "encoding"
MAX_ONEHOT = 1000


def categories(df: DataFrame, column: str) -> DataFrame:
    """(k, w): category as text and its rows. Rows of one category are combined before the shuffle."""
    return (
        df.select(col(column).cast("string").alias("k"))
        .where(F.col("k").isNotNull())
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def ranked(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """(k, v, w) with v the 0-based position of k in code-point order."""
    numbered = running_sums(materialize(counts).withColumn("one", F.lit(1)), "k", {"pos": "one"}, ranges=ranges)
    return numbered.select("k", (F.col("pos") - 1).cast("bigint").alias("v"), "w")


def fit_onehot(df: DataFrame, attributes: Sequence[str], max_categories: int = MAX_ONEHOT) -> Step:
    """0/1 columns ``{column}_{category}`` without the first category; NULL gives zeros.
    Every boolean column of the table becomes an integer as well."""
    add = []
    for a in attributes:
        found = [r["k"] for r in categories(df, a).orderBy("k").limit(max_categories + 1).collect()]
        if len(found) > max_categories:
            raise PrepareError(STEP, "onehot", f"Column '{a}' has more than {max_categories} categories.")
        for c in found[1:]:
            add.append((f"{a}_{c}", f"CAST(coalesce(CAST({quoted(a)} AS STRING) = {text(c)}, false) AS INT)"))
    flags = [
        f.name for f in df.schema.fields if f.dataType.simpleString() == "boolean" and f.name not in attributes
    ]
    return Step(
        STEP, "onehot", replace={c: f"CAST({quoted(c)} AS INT)" for c in flags}, add=add, drop=list(attributes)
    )


def fit_label(df: DataFrame, attributes: Sequence[str]) -> Step:
    """Position of the text in sorted order; a missing value is the category 'nan'."""
    lookups = []
    for a in attributes:
        filled = df.select(F.coalesce(col(a).cast("string"), F.lit("nan")).alias(a))
        lookups.append((a, LookupTable.freeze(ranked(categories(filled, a))), None, True))
    return Step(STEP, "label", lookups=lookups)


def fit_ordinal(df: DataFrame, attributes: Sequence[str]) -> Step:
    """Position of the value in sorted order; a missing value stays missing."""
    lookups = []
    for a in attributes:
        if is_numeric(dtype_of(df, a)):
            counts = (
                df.select(as_double(df, a).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("w"))
            )
        else:
            counts = categories(df, a)
        lookups.append((a, LookupTable.freeze(ranked(counts)), None, False))
    return Step(STEP, "ordinal", lookups=lookups)


def fit_target(df: DataFrame, attributes: Sequence[str], target: str) -> Step:
    """Mean of the target per category; the global mean for missing and unseen ones."""
    if not is_numeric(dtype_of(df, target)):
        raise PrepareError(STEP, "target", f"Target column '{target}' is not numeric.")
    overall = stats.moments(df, [target])[target].mean
    lookups = []
    for a in attributes:
        if a == target:
            continue
        means = (
            df.select(col(a).alias("k"), as_double(df, target).alias("y"))
            .where("k IS NOT NULL")
            .groupBy("k")
            .agg(F.avg("y").alias("v"), F.count(F.lit(1)).alias("w"))
        )
        lookups.append((a, LookupTable.freeze(means.select("k", "v", "w")), overall, False))
    return Step(STEP, "target", lookups=lookups)


def fit_freq(df: DataFrame, attributes: Sequence[str]) -> Step:
    """Share of the non-missing rows; 0 for missing and unseen categories."""
    known = stats.one_row(df, {a: F.count(col(a)) for a in attributes})
    lookups = []
    for a in attributes:
        counts = df.select(col(a).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("w"))
        share = counts.select("k", (F.col("w") / F.lit(max(known[a], 1))).alias("v"), "w")
        lookups.append((a, LookupTable.freeze(share), 0.0, False))
    return Step(STEP, "freq", lookups=lookups)

