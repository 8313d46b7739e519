"""Session settings, the shared scratch folder and stable materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tabloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


FACTS = "spark.sql.constraintPropagation.enabled"
SCAN = "spark.sql.files.maxPartitionBytes"
SCAN_BYTES = 16 * 1024 * 1024  # of files that a task of a fit scans: feature vectors take many times the room
_plain: dict[str, list] = {}
_plain_lock = Lock()


def _bytes(size: str) -> int:
    """A setting such as 128MB, 64m or 1000b as a number of bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit[:1]]


@contextmanager
def plain_plans(spark: SparkSession) -> Iterator[None]:
    """Jobs planned in here go without the facts that the optimizer derives about columns. Where an
    expression over dozens of columns meets as many renamed ones, the facts double with each of them and
    fill the driver. Files are scanned in smaller pieces, as a task of a fit reads the feature vectors of its
    rows again and again, which are far larger than the compressed columns they come from. Results are
    the same. Threads of a session may be in here together."""
    session = str(spark._jsparkSession.sessionUUID())
    with _plain_lock:
        inside = _plain.setdefault(session, [0, spark.conf.get(FACTS), spark.conf.get(SCAN)])
        inside[0] += 1
        spark.conf.set(FACTS, "false")
        if not inside[0] > 1 and _bytes(inside[2]) > SCAN_BYTES:
            spark.conf.set(SCAN, str(SCAN_BYTES))
    try:
        yield
    finally:
        with _plain_lock:
            inside[0] -= 1
            if not inside[0]:
                spark.conf.set(FACTS, inside[1])
                spark.conf.set(SCAN, inside[2])
                del _plain[session]


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be invisible to the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tabloom-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tabloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so that a lost executor cannot
    change values that depend on row order or on random numbers."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder. Unlike a checkpoint it carries no facts about its
    columns along, which take very long to derive where many columns were renamed."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# inputs the optimizer estimates below this size are held in memory while they are fitted on
SMALL_INPUT_BYTES = 256 * 1024 * 1024
COPY_BYTES = 4 * 1024 * 1024  # of the estimate per partition of such a copy


@contextmanager
def working_copy(df: DataFrame) -> Iterator[DataFrame]:
    """A small input spread over all cores and cached for the passes of a fit, in more partitions the more
    there is of it; a large one as it is, to be scanned again with only the needed columns. What is joined from
    several tables says little about its size beforehand and would be joined anew by every pass: it is written first."""
    plan = df._jdf.queryExecution().optimizedPlan()
    estimate = int(plan.stats().sizeInBytes())
    if estimate > SMALL_INPUT_BYTES and plan.collectLeaves().size() > 1 and not any(f.dataType.typeName() == "void" for f in df.schema.fields):
        df = stored(df, "input")
        estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate > SMALL_INPUT_BYTES:
        yield df
        return
    cores = df.sparkSession.sparkContext.defaultParallelism
    kept = df.repartition(max(cores, -(-estimate // COPY_BYTES))).persist()
    try:
        yield kept
    finally:
        kept.unpersist()
