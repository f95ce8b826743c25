"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. Stages work on all that is left,
keep the columns of documents (whatever their names) and, but for the last, return
just those. No stage reads another table.

Edge cases: null and empty texts are rejected by the first stage; documents without a
language are judged but not learned from, and where none has one, no text is
rejected for its language; a null source is a source of its own; null ids are the last
choice among copies; repeated rows are copies; an empty table passes every stage empty;
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import scratch_path, scratch_scope
from gleaner.llm.language_filters import UNKNOWN, fit_language_filters, identify_language
from gleaner.llm.mixing_tree import mix_sources, mixture
from gleaner.llm.packing_hilbert import pack_along_curve
from gleaner.llm.quality_repeats import RepeatRules, repeat_quality
from gleaner.llm.queries import tokenizer_path
from gleaner.llm.simhash_texts import keep_one_similar

#: A text is rejected if the best language holds less than this share of its n-grams.
LEAST_LANGUAGE_SHARE = 0.5
#: Near-duplicates: texts whose sets of five-word shingles have at least this Jaccard similarity.
NEAR = Fraction(4, 5)
#: Shorter texts go. Labels of quality say nothing against texts of under 50 words, the operator's default, so they stay.
RULES = RepeatRules(min_words=5)
#: Words that a worker's tokenizer remembers, and characters it takes at a time; the stages before leave executors less memory than the operator has alone.
PACKING_MEMO, PACKING_CHARS = 250_000, 1_500_000


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under neutral names, so that no column clashes with an operator's own."""
    own = {name: f"_c{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are too short or repeat themselves too much."""
    plain, own = _renamed(docs)
    judged = repeat_quality(plain, RULES, id_col=own["doc_id"], text_col=own["text"], carry=tuple(own.values()))
    return judged.where("kept").select(*own.values()).toDF(*own)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language that the filters know."""
    plain, own = _renamed(docs)
    filters = fit_language_filters(plain, lang_col=own["lang"], text_col=own["text"], id_col=own["doc_id"])
    if not filters.languages:
        return docs
    named = identify_language(plain, filters, id_col=own["doc_id"], text_col=own["text"], carry=tuple(own.values()))
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*own.values()).toDF(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of links by similarity."""
    return keep_one_similar(docs, shingle=5, share=NEAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time it takes a document, dealt by shard and shuffled inside."""
    plain, own = _renamed(docs)
    mixed = mix_sources(plain, id_col=own["doc_id"], text_col=own["text"], source_col=own["source"], carry=tuple(own.values()))
    return mixture(mixed).select(*own.values()).toDF(*own)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    pieces = pack_along_curve(docs, tokenizer_path(), end_id=2, length=4096, with_ids=False, memo=PACKING_MEMO, chars=PACKING_CHARS)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has neither the suffix arrays, the filters, the tree's random draws nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result = scratch_path(spark, "pipeline")
    with scratch_scope(spark):  # the stages' results, but for the last one's
        for name, stage in STAGES:
            path = result if name == STAGES[-1][0] else scratch_path(spark, name)
            with scratch_scope(spark):  # what a stage needs while its result is written
                made = stage(spark, docs, sf_dir)
                made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
    return docs
