"""Writing datasets and reports. The format is always explicit."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import SourceError
from tabloom.types import nan_to_null


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        df.write.mode(mode).json(path)
    else:
        raise SourceError(f"Unsupported format: {fmt}")
    return path


def publish(df: DataFrame, root: str, name: str, fmt: str = "parquet", owner: str | None = None) -> str:
    """Store a working copy as a new named dataset; an existing one is never replaced."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")
    clean = re.sub(r"[^\w.-]+", "_", name)
    if not clean.endswith(f".{fmt}"):
        clean += f".{fmt}"
    parts = [root.rstrip("/"), *([owner] if owner else []), "datasets", f"{stamp}_{clean}"]
    return save(df, "/".join(parts), fmt)


def next_version(df: DataFrame, root: str, version: int) -> str:
    """A new version of a working copy beside the old ones."""
    return save(df, f"{root.rstrip('/')}/v{version:05d}")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; missing values appear as null."""
    clean = nan_to_null(df)
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns]), {"ignoreNullFields": "false"}).alias("json"))


def save_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write the small tables of a model report side by side."""
    return {name: save(df.coalesce(1), f"{path.rstrip('/')}/{name}", fmt) for name, df in tables.items()}
