"""Neighbour imputation of rows that were not learned from, in batch and as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.plans.prepare import prepare
from tabloom.plans.steps import FittedPreparation
from tabloom.queries.common import QueryMap, embedding_dims, rounded
from tabloom.session import scratch_path
from tabloom.streaming import jobs

WIDE = 64
COMPONENTS = [f"e{i}" for i in range(WIDE)]
GAPS = {0: 7, 5: 5, 63: 11}  # component: missing where this number divides vec_id
LATER = "vec_id % 3 = 0"


def _with_gaps(spark, sf) -> DataFrame:
    df = embedding_dims(spark, sf, WIDE, "vec_id")
    for i, n in GAPS.items():
        df = df.withColumn(f"e{i}", F.when(F.col("vec_id") % n != 0, F.col(f"e{i}")))
    return df


def _learned(spark, df: DataFrame) -> FittedPreparation:
    """Fitted on the earlier rows, stored and read again. The id is a text, so that it takes no part."""
    path = scratch_path(spark, "preparation")
    earlier = df.where(f"NOT {LATER}").withColumn("vec_id", F.col("vec_id").cast("string"))
    prepare(earlier, {"missing_values": ["knn"]}, COMPONENTS).fitted.save(spark, path)
    return FittedPreparation.load(spark, path)


def _later_rows(spark, sf):
    df = _with_gaps(spark, sf)
    return rounded(_learned(spark, df).transform(df.where(LATER)), 6)


def _arriving_rows(spark, sf):
    df = _with_gaps(spark, sf)
    arrivals, out = scratch_path(spark, "arrivals"), scratch_path(spark, "filled")
    df.where(LATER).repartition(4, "vec_id").write.parquet(arrivals)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(arrivals)
    query = jobs.prepare_stream(_learned(spark, df), stream, out, scratch_path(spark, "s"), available_now=True)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"stream failed: {query.exception()}")
    return rounded(spark.read.parquet(out).drop("batch"), 6)


QUERIES: QueryMap = {"impute_knn_later_rows": _later_rows, "stream_impute_knn": _arriving_rows}


def _filled_sql() -> str:
    """All earlier rows by distance from each later one, over the components both have."""
    cells = ", ".join(
        f"CASE WHEN vec_id % {GAPS[i]} <> 0 THEN CAST(embedding[{i + 1}] AS DOUBLE) END" if i in GAPS else f"CAST(embedding[{i + 1}] AS DOUBLE)"
        for i in range(WIDE)
    )
    values = ", ".join(f"round(coalesce(x[{i + 1}], f{i}), 6) AS e{i}" if i in GAPS else f"round(x[{i + 1}], 6) AS e{i}" for i in range(WIDE))
    fills = ", ".join(f"max(v) FILTER (WHERE j = {i + 1}) AS f{i}" for i in GAPS)
    return f"""WITH s AS (SELECT vec_id, {LATER} AS later, [{cells}] AS x FROM embeddings),
      need AS (SELECT vec_id, x, j FROM (SELECT vec_id, x, unnest({[i + 1 for i in GAPS]}) AS j FROM s WHERE later) WHERE x[j] IS NULL),
      gap AS (SELECT a.vec_id, a.j, b.x[a.j] AS v, list_transform(list_zip(a.x, b.x), lambda z: power(z[1] - z[2], 2)) AS g
        FROM need a JOIN s b ON NOT b.later AND b.x[a.j] IS NOT NULL),
      near AS (SELECT vec_id, j, v, row_number() OVER (PARTITION BY vec_id, j ORDER BY list_sum(g) / list_aggregate(g, 'count')) AS k FROM gap),
      fill AS (SELECT vec_id, {fills} FROM (SELECT vec_id, j, avg(v) AS v FROM near WHERE k <= 5 GROUP BY vec_id, j) GROUP BY vec_id)
      SELECT s.vec_id, {values} FROM s LEFT JOIN fill USING (vec_id) WHERE later"""


ORACLES = {"impute_knn_later_rows": _filled_sql(), "stream_impute_knn": _filled_sql()}
