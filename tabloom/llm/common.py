"""Helpers shared by the operators: Arrow batches with appended columns, tables in the shared
folder, state that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import scratch_path, tune

# an Arrow batch holds at most so many rows and so many bytes, whichever comes first
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for texts of very different length: small batches bound the workers' memory."""
    tune(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def map_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    keep: list[str] | None = None,
    needed: object = None,
) -> DataFrame:
    """Append columns computed from the input columns, batch by batch.

    ``make()`` runs once per task and returns the function from the input columns of a batch
    to the new columns. The kept columns (default: all) pass through as Arrow arrays. ``needed``
    names the entry of the worker's store that make() uses."""
    kept = df.columns if keep is None else keep
    at = len(kept)
    narrowed = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*narrowed.schema.fields[:at], *[T.StructField(name, kind, True) for name, kind in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(needed)
        work = make()
        names = [*kept, *[name for name, _ in fields]]
        for batch in batches:
            made = work([batch.column(i) for i in range(at, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(at)], *made], names=names)

    return narrowed.mapInArrow(run, schema)


def small_table(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """A bounded list of number rows as a frame, by way of one text literal."""
    text = ";".join(",".join(map(str, row)) for row in rows)
    cell = F.split("row", ",")
    listed = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("row")).where("row <> ''")
    return listed.select(*[cell[i].cast(kind).alias(name) for i, (name, kind) in enumerate(columns)])


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker. Functions travel by value, so the
    globals of this package start anew in every task; caches of pure functions belong here."""
    module = sys.modules.setdefault("_tabloom_worker_store", types.ModuleType("_tabloom_worker_store"))
    return module.__dict__.setdefault("store", {})


def tidy(needed: object = None) -> None:
    """Give back what this Python worker holds of other work: all entries of the store but the needed one, and
    memory that is free but still the worker's. Workers outlive the stages, so the caches of one would lie
    beside the data of the next."""
    import ctypes
    import gc

    store = worker_store()
    for name in [k for k in store if k != needed]:
        del store[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


# groups of at least this share of all rows are joined by broadcast; there are no more of them
HOT_GROUPS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Rows with the other columns of their group; ``groups`` has one row per key (NULL is one)
    and the number of its rows in ``size``, ``total`` is their sum.

    A group of at least one in HOT_GROUPS of all rows is hot. There are at most HOT_GROUPS such
    groups, so these are broadcast and their rows stay where they are; the others are shuffled."""
    named = groups.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in groups.columns])
    same = [rows[c].eqNullSafe(F.col(f"__{c}")) for c in on]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    hot = F.col(size) * F.lit(HOT_GROUPS) >= F.lit(total)
    few, rest = F.broadcast(named.where(hot)), named.where(~hot)
    out = [*rows.columns, *[c for c in groups.columns if c not in on]]
    own = rows.join(few, condition).select(*out)
    return own.unionByName(rows.join(few, condition, "left_anti").join(rest, condition).select(*out))
