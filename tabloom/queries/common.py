"""Inputs shared by the registered queries, as Spark frames and as SQL of equal meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import tune

QueryMap = dict[str, Callable[[SparkSession, str], DataFrame]]

LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# lineitem with missing prices and blown-up quantities
LINEITEM_X = """(SELECT *,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price_n,
  CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 50 ELSE l_quantity END AS qty_o,
  CAST(1.0 AS DOUBLE) AS konst
  FROM lineitem)"""

# orders with missing priorities
ORDERS_X = """(SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio_n FROM orders)"""

# orders with one order in ten twice
ORDERS_DUP = """(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)"""


def lineitem_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price_n",
        "CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 50 ELSE l_quantity END AS qty_o",
        "CAST(1.0 AS DOUBLE) AS konst",
    )


def orders_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "*", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio_n"
    )


def orders_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.unionByName(orders.where("o_orderkey % 10 = 0"))


def embedding_dims(spark: SparkSession, sf_dir: str, dims: int, *extra: str) -> DataFrame:
    """The first components of every embedding as DOUBLE columns e0, e1, ..."""
    return table(spark, sf_dir, "embeddings").select(
        *extra, *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)]
    )


def embedding_sql(dims: int, *extra: str) -> str:
    cols = list(extra) + [f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(dims)]
    return f"(SELECT {', '.join(cols)} FROM embeddings)"


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label and three size features."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CAST(n_chars AS DOUBLE) AS n_chars",
        "CAST(length(text) AS DOUBLE) AS text_len",
        "CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces",
        "lang",
    )
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


LABELLED_SQL = """(SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) AS DOUBLE) AS text_len,
  CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces, lang, quality, toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the given DOUBLE columns (all of them when none is named)."""
    chosen = set(columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"])
    return df.select(*[F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns])


def union_all(template: str, columns: list[str]) -> str:
    """One SELECT per column; ``{c}`` stands for the column."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)
