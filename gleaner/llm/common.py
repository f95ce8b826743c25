"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.shared import shared_dir

#: A word is a run of anything but the six ASCII white-space characters (Java regex).
WORD = r"[^\x20\x09-\x0D]+"

#: Scratch folders of the scopes that are open, innermost last, each to be dropped as its scope ends. The first list is
#: the session's: tables that a result still reads; they go as the driver's process ends.
_scopes: list[list[str]] = [[]]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are dropped at the end, but for those made with ``outer``, which belong to the scope around."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            delete_path(spark, path.rsplit("/", 1)[0])


def scratch_path(spark: SparkSession, tag: str, outer: bool = False) -> str:
    """A fresh path under the shared folder, dropped with its scope."""
    path = f"{shared_dir(spark)}/gleaner-{uuid.uuid4().hex}/{tag}"
    _scopes[max(0, len(_scopes) - 1 - outer)].append(path)
    return path


def materialise(df: DataFrame, tag: str, outer: bool = False) -> DataFrame:
    """Write df to a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and the table survives where cached blocks would not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag, outer)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_rest() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with suppress(Exception):  # the JVM may have gone before
            for path in _scopes[0]:
                delete_path(spark, path.rsplit("/", 1)[0])


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as remainder 1, so they are never held out at 0 or 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus), F.lit(1)).cast("int")


def hash_share(id_col: Column, share: float, seed: int) -> Column:
    """True for a deterministic share of the ids; sampling for fits only."""
    return (F.xxhash64(id_col, F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFF)) < F.lit(int(share * (1 << 28))))


def own_columns(names: list[str], made: tuple[str, ...]) -> list[str]:
    """names, each once; an error where one is also the name of a column that the operator makes."""
    if clash := sorted(set(names) & set(made)):
        raise ValueError(f"columns are named as the result's: {', '.join(clash)}; rename them first")
    return [*dict.fromkeys(names)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim_memory() -> None:
    """Give memory that this Python worker has freed back to the system: workers outlive stages, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
