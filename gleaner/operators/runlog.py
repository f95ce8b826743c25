"""Append-only run logs whose columns may grow, and snapshot fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def next_run(log: DataFrame | None) -> int:
    """One more than the highest run number; 1 without a log or a readable number."""
    if log is None or "run" not in log.columns:
        return 1
    return int(log.agg((F.coalesce(F.max(F.col("run").try_cast("int")), F.lit(0)) + 1)).first()[0])


def numbered(log: DataFrame | None, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """rows with run and timestamp in front."""
    stamp = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return rows.select(F.lit(next_run(log)).alias("run"), stamp.alias("timestamp"), *[c for c in rows.columns if c not in ("run", "timestamp")])


def union_logs(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old rows and new ones; columns of both, the old order first, blanks for what a row lacks. All cells are text."""
    text = lambda df: df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return text(new).fillna("") if old is None else text(old).unionByName(text(new), allowMissingColumns=True).fillna("")


def append_parquet(rows: DataFrame, path: str) -> None:
    """Append without rewriting; readers merge schemas."""
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def runs(log: DataFrame, keep: list[int]) -> DataFrame:
    return log.where(F.col("run").cast("int").isin(*keep))


def detail_lines(rows: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """One text column value, for write.text."""
    return rows.select(F.format_string(pattern, *[F.col(c) for c in columns]).alias("value"))


def snapshot(table: DataFrame, id_col: str = "id", version: str = "version", alive: Column | None = None) -> DataFrame:
    """One row: n, max_id, sum_version of the rows that are alive; 0 where there is none."""
    rows = table if alive is None else table.where(alive)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(id_col), F.lit(0)).alias("max_id"), F.coalesce(F.sum(version), F.lit(0)).alias("sum_version"))


def same_snapshot(before: DataFrame, after: DataFrame) -> bool:
    return before.first() == after.first()
