"""Serving measurements: latency cells from request rows, engine ratios, qualification and choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_cells(nested: DataFrame, dataset_cols: list[str] | None = None) -> DataFrame:
    """dataset -> engine -> [cells] JSON as rows: dataset, engine and the cell's fields. nested holds one map column per dataset."""
    out = None
    for name in dataset_cols or nested.columns:
        one = nested.select(F.lit(name).alias("dataset"), F.explode(name).alias("engine", "cells")).select("dataset", "engine", F.explode("cells").alias("cell")).select("dataset", "engine", "cell.*")
        out = one if out is None else out.unionByName(one)
    return out


def latency_cells(requests: DataFrame, keys: list[str], latency: str = "latency", ok: str = "ok", cosine: str | None = None) -> DataFrame:
    """n, successes, failures, p50, p95, p99 (linear) and, with a cosine column, its minimum."""
    p = F.percentile(latency, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    more = [F.min(cosine).alias("min_cosine")] if cosine else []
    cells = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("successes"), F.count_if(~F.col(ok)).alias("failures"), p.alias("p"), *more)
    return cells.select(*keys, "requests", "successes", "failures", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), *(["min_cosine"] if cosine else []))


def with_rate(cells: DataFrame, seconds: str = "seconds") -> DataFrame:
    return cells.withColumn("requests_per_second", F.try_divide(F.col("successes"), F.col(seconds)))


def engine_ratio(cells: DataFrame, over: str, under: str, value: str = "requests_per_second", at: list[str] | None = None) -> DataFrame:
    """value of one engine over another's in each setting (dataset and concurrency by default), in one pass."""
    at = at or ["dataset", "concurrency"]
    pick = lambda e: F.max(F.when(F.col("engine") == e, F.col(value)))
    return cells.where(F.col("engine").isin(over, under)).groupBy(*at).agg(pick(over).alias("over"), pick(under).alias("under")).withColumn("ratio", F.try_divide(F.col("over"), F.col("under")))


def qualify_engines(cells: DataFrame, least_cosine: float = 0.9999, least_cells: int = 15, engine: str = "engine", cosine: str = "min_cosine") -> DataFrame:
    """engine, cells, failures, cosine_min, qualified: all its cells measured, none failed, vectors as expected."""
    found = cells.groupBy(engine).agg(F.count(F.lit(1)).alias("cells"), F.sum("failures").alias("failures"), F.min(cosine).alias("cosine_min"))
    return found.withColumn("qualified", (F.col("cosine_min") >= least_cosine) & (F.col("cells") >= least_cells) & (F.col("failures") == 0))


def select_engine(qualified: DataFrame, throughput: DataFrame, engine: str = "engine") -> DataFrame:
    """One row: the qualified engine with the highest throughput (ties: the name that sorts first)."""
    both = qualified.where("qualified").join(throughput, engine)
    return both.agg(F.max("throughput").alias("throughput"), F.min_by(engine, F.struct(-F.col("throughput"), engine)).alias(engine)).where("throughput is not null")
