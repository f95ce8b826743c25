"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset, and driver and executors are one process (tests), a
    temporary folder is made."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="gleaner-")
    return _own_dir


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to a table in the shared folder and read again: its rows, and what was computed from their places, stay fixed."""
    path = f"{shared_dir(df.sparkSession)}/gleaner-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
