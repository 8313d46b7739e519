"""SQL over a dataset. Spark parses, plans and runs it; only naming happens here."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.errors import QueryError
from tabloom.sources.readers import load

VIEWS = ("data", "df")
BLOCKED = ["insert", "update", "delete", "drop", "alter", "create"]
_LITERAL = re.compile(r"'(?:[^']|'')*'")


def run_sql(df: DataFrame, sql: str) -> DataFrame:
    """Run a query that sees the dataset as ``data`` (or ``df``). The result is lazy, so
    filters and column choices of the query reach the scan behind the dataset."""
    spark = df.sparkSession
    for view in VIEWS:
        df.createOrReplaceTempView(view)
    try:
        return spark.sql(sql)
    finally:
        for view in VIEWS:
            spark.catalog.dropTempView(view)


def check_select(sql: str) -> None:
    """Only a SELECT over the placeholder TABLE. Words inside quotes do not count, and
    names like ``created_at`` are no keywords."""
    bare = _LITERAL.sub("''", sql).strip()
    if not re.match(r"(?i)select\b", bare):
        raise QueryError("Only SELECT queries are allowed")
    if not re.search(r"\bTABLE\b", bare):
        raise QueryError("Query must include TABLE placeholder")
    for word in BLOCKED:
        if re.search(rf"(?i)\b{word}\b", bare):
            raise QueryError(f"Keyword '{word}' is not allowed")


def _outside_literals(sql: str, change: Callable[[str], str]) -> str:
    out, at = [], 0
    for m in _LITERAL.finditer(sql):
        out += [change(sql[at : m.start()]), m.group()]
        at = m.end()
    return "".join(out) + change(sql[at:])


def run_select(spark: SparkSession, path: str, sql: str, fmt: str = "csv") -> DataFrame:
    """Run ``SELECT ... FROM TABLE`` over all files of a path or pattern."""
    check_select(sql)
    if fmt not in ("csv", "parquet"):
        raise QueryError("Unsupported file type. Only 'csv' and 'parquet' are supported.")
    view = f"dataset_{uuid.uuid4().hex}"
    load(spark, path, fmt, keep_nan=True).createOrReplaceTempView(view)
    try:
        return spark.sql(_outside_literals(sql, lambda s: re.sub(r"\bTABLE\b", view, s)))
    finally:
        spark.catalog.dropTempView(view)


def qualify(df: DataFrame, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Filter rows by a window expression, as the QUALIFY clause does elsewhere."""
    return df.withColumn("_qualify", value).where(keep(F.col("_qualify"))).drop("_qualify")
