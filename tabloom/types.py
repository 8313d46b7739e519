"""Column kinds and the one missing-value convention: NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
TEXT = (T.StringType, T.CharType, T.VarcharType)
NESTED = (T.ArrayType, T.StructType, T.MapType)


def is_numeric(dtype: T.DataType, with_bool: bool = True) -> bool:
    """Numbers; booleans count as numbers for preparation steps, not for profiles."""
    return isinstance(dtype, INTEGRAL + FRACTIONAL) or (with_bool and isinstance(dtype, T.BooleanType))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGRAL + FRACTIONAL):
        return "numeric"
    if isinstance(dtype, TEXT):
        return "categorical"
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, NESTED):
        return "nested"
    return "other"


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "numeric")


def column_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col(quoted(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_double(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE with NaN taken as missing (booleans become 0/1)."""
    dtype = dtype_of(df, name)
    c = col(name)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c.cast("double")
        return F.when(~F.isnan(c), c)
    return c.cast("double")


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN in floating columns becomes NULL; all other columns pass untouched."""
    names = set(df.columns if columns is None else columns)
    floats = {
        f.name
        for f in df.schema.fields
        if f.name in names and isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def null_safe_text(name: str) -> Column:
    """The value as text, for grouping columns of any type under one key."""
    return F.coalesce(col(name).cast("string"), F.lit("null"))
