"""Reading datasets: CSV, JSON, Parquet and workbooks, one missing-value rule for all."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.errors import SourceError
from tabloom.types import col, nan_to_null

# fixed values: texts that mean a missing value in a CSV cell
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sampling_ratio: float = 1.0, multi_line: bool | None = None
) -> DataFrame:
    """Files with a header line. Give a schema for large inputs: it saves the inference
    pass. Line breaks inside quotes force each file into one task, so unless told, the
    reader first looks whether any line leaves a quote open."""
    if multi_line is None:
        multi_line = _has_open_quotes(spark, path)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        texts = T.StructType([T.StructField(f.name, T.StringType()) for f in _struct(spark, schema).fields])
        raw = _missing_texts(reader.schema(texts).csv(path))
        return raw.select(*[_typed(f) for f in _struct(spark, schema).fields])
    # types are inferred with one spelling of missing; others would turn numbers into text
    raw = _missing_texts(reader.csv(path))
    inferred = _infer(raw, sampling_ratio)
    return raw.select(*[_typed(f) for f in inferred.fields])


def _typed(field: T.StructField) -> Column:
    """The cells in the type of their column; a cell that does not fit fails the read."""
    if isinstance(field.dataType, T.StringType):
        return col(field.name).alias(field.name)
    cell = col(field.name)
    value = cell.try_cast(field.dataType)
    if isinstance(field.dataType, T.IntegralType):  # casting '2.5' to an integer would cut it
        value = F.when(F.trim(cell).rlike("^[+-]?[0-9]+$"), value)
    bad = F.concat(F.lit(f"column {field.name}: not a {field.dataType.simpleString()}: "), cell)
    return F.when(cell.isNotNull() & value.isNull(), F.raise_error(bad).cast(field.dataType)).otherwise(value).alias(field.name)


def _has_open_quotes(spark: SparkSession, path: str) -> bool:
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0


def _struct(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def _missing_texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~col(c).isin(NA_TEXTS), col(c)).alias(c) for c in df.columns])


# fixed values: type a text column gets when every present cell can be cast to it, in order
_TRIED = ["bigint", "double", "boolean"]


def _infer(raw: DataFrame, sampling_ratio: float) -> T.StructType:
    """The narrowest of integer, double, boolean and text per column, by one aggregate
    that counts the cells each type cannot hold. Dates stay text."""
    sample = raw if sampling_ratio >= 1.0 else raw.sample(fraction=sampling_ratio, seed=42)
    aggs = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(raw.columns)]
    for i, c in enumerate(raw.columns):
        for t in _TRIED:
            bad = col(c).isNotNull() & F.trim(col(c)).try_cast(t).isNull()
            if t == "boolean":
                bad = col(c).isNotNull() & ~F.lower(col(c)).isin("true", "false")
            if t == "bigint":  # casting '1.5' to an integer truncates instead of failing
                bad = bad | (col(c).isNotNull() & ~F.trim(col(c)).rlike("^[+-]?[0-9]+$"))
            if t == "double":  # suffixes like '1d' are not numbers here
                bad = bad | col(c).rlike("[dDfF]\\s*$")
            aggs.append(F.count_if(bad).alias(f"{t}{i}"))
    got = sample.agg(*aggs).first() if raw.columns else None
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    fields = []
    for i, c in enumerate(raw.columns):
        fits = [t for t in _TRIED if got[f"{t}{i}"] == 0]
        dtype = kinds[fits[0]] if fits and got[f"n{i}"] else T.StringType()
        if got[f"n{i}"] == 0:
            dtype = T.DoubleType()
        fields.append(T.StructField(c, dtype))
    return T.StructType(fields)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files of one object per line, and files that are an array of objects (or one object over
    several lines), told apart file by file: the former have an object on every line that is
    not blank. A record that cannot be read fails the read."""
    line = F.trim("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line")).where("line <> ''")
    odd = F.count_if(~(F.col("line").startswith("{") & F.col("line").endswith("}")))
    files = lines.groupBy("file").agg((odd > 0).alias("whole")).collect()  # one row per file
    reader = (spark.read.schema(schema) if schema is not None else spark.read).option("mode", "FAILFAST")
    parts = []
    for whole in (False, True):
        names = sorted(r["file"] for r in files if r["whole"] == whole)
        if names:
            parts.append(reader.option("multiLine", whole).json(names))
    if not parts:
        return nan_to_null(reader.json(path))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return nan_to_null(both)


def read_parquet(spark: SparkSession, path: str, keep_nan: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df if keep_nan else nan_to_null(df)


def sniff(spark: SparkSession, path: str) -> str:
    """Format of an unknown file by its first bytes: zip means workbook, else CSV."""
    head = spark.read.text(path).limit(1).collect()
    return "xlsx" if head and head[0]["value"].startswith("PK\x03\x04") else "csv"


def format_of(path: str) -> str | None:
    ext = os.path.splitext(path.rstrip("/").rstrip("*").rstrip("."))[1] or os.path.splitext(path)[1]
    return {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".xlsx": "xlsx"}.get(ext.lower())


def load(spark: SparkSession, path: str, fmt: str | None = None, schema=None, strict: bool = False, keep_nan: bool = False) -> DataFrame:
    """Read by format name, extension, or content. Unknown extensions are sniffed, or
    refused when ``strict``."""
    fmt = fmt or format_of(path)
    if fmt is None:
        if strict:
            raise SourceError(f"Unsupported extension: {path}")
        fmt = sniff(spark, path)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "json":
        return read_json(spark, path, schema)
    if fmt == "parquet":
        return read_parquet(spark, path, keep_nan)
    if fmt == "xlsx":
        from tabloom.sources.workbook import read_workbooks

        return read_workbooks(spark, path, schema)
    raise SourceError(f"Unsupported extension: {fmt}")


def inspect(df: DataFrame) -> DataFrame:
    """(column_name, dtype, row_count) of a dataset; counting reads no column data of Parquet."""
    rows = df.count()
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), rows) for f in df.schema.fields], "column_name string, dtype string, row_count bigint"
    )


def header(spark: SparkSession, path: str, fmt: str | None = None) -> list[str]:
    """Column names without reading the data."""
    fmt = fmt or format_of(path) or "csv"
    if fmt == "csv":
        return spark.read.option("header", True).csv(path).columns
    return load(spark, path, fmt).columns


def preview_schema(spark: SparkSession, path: str, fmt: str | None = None, rows: int = 5) -> T.StructType:
    """Types judged by the first few rows only; good enough to show, not to compute with."""
    fmt = fmt or format_of(path) or "csv"
    if fmt == "csv":
        first = spark.read.option("header", True).option("escape", '"').csv(path).limit(rows)
        return _infer(_missing_texts(first), 1.0)
    return load(spark, path, fmt).schema
