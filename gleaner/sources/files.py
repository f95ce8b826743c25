"""Text files in and out: CSV with explicit all-string schemas, JSON settings, single-file reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import strip

BOM = "﻿"


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    import csv

    return next(csv.reader([first[0][0].removeprefix(BOM)]))


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as text, blanks as '' and not null, a byte-order mark dropped. Names come from the first line."""
    schema = ", ".join(f"`{c}` string" for c in _header(spark, path))
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path).fillna("")


def read_positional_csv(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """_c0.. without the first line; an error if there is no row."""
    schema = ", ".join(f"_c{k} string" for k in range(columns))
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def read_questions(spark: SparkSession, path: str, id_col: str = "id", text_col: str = "question") -> DataFrame:
    """Cells trimmed; rows with a blank id or text dropped."""
    df = read_text_csv(spark, path)
    df = df.select(*[strip(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.where((F.col(id_col) != "") & (F.col(text_col) != ""))


def with_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """The place of a row in its file, taken at the scan, before any shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, bom: bool = True, single: bool = True) -> None:
    """CSV with a header; bom puts a byte-order mark before it. single is for reports, whose size is bounded."""
    out = df.coalesce(1) if single else df
    if bom and df.columns:
        out = out.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    out.write.mode("overwrite").option("header", True).option("escape", "\"").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """One small JSON file as a dict."""
    rows = spark.read.option("wholetext", True).text(path).collect()
    return json.loads(rows[0][0])


def write_once(df: DataFrame, path: str) -> None:
    """Write, or fail if the place is taken: the lock of a one-shot step."""
    df.write.mode("errorifexists").json(path)


def write_lines(lines: list[str], spark: SparkSession, path: str) -> None:
    """A small report as one text file."""
    spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "pos int, value string").coalesce(1).sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)


def file_digest(spark: SparkSession, path: str) -> str:
    """First 16 hex digits of the SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 16)).first()[0]
