"""Tables of texts with their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.models import ModelSpec, embed_column
from gleaner.sources.shared import written


def vector_table(texts: DataFrame, text: str, spec: ModelSpec, name: str) -> DataFrame:
    """texts with vec, embedded once, written to the shared folder and readable in SQL as ``name``; an older view of that
    name is replaced. A null text has a null vector."""
    vec = F.when(F.col(text).isNotNull(), embed_column(F.col(text), spec))
    table = written(texts.withColumn("vec", vec), "vectors")
    table.createOrReplaceTempView(name)
    return table
