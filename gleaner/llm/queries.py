"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import license_digests
from gleaner.llm.common import fold, table
from gleaner.llm.language_filters import fit_language_filters, identify_language
from gleaner.llm.mixing_tree import mix_place, mix_sources
from gleaner.llm.packing_hilbert import pack_along_curve
from gleaner.llm.pivot_topk import top_inner_products
from gleaner.llm.quality_cnn import fit_quality, score_quality
from gleaner.llm.quality_repeats import repeat_quality
from gleaner.llm.simhash_gph import near_duplicates
from gleaner.llm.toxicity_pu import fit_toxicity, score_toxicity
from gleaner.llm.warc_merge import capture_histories


def op1_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return capture_histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, limit=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"), F.transform("copies", lambda c: mix_place(F.col("order"), c["epoch"])).alias("places"))


def op4_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    filters = fit_language_filters(docs.where(~held))
    return identify_language(docs, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 5) == 0
    model = fit_toxicity(docs.where(~held), labels.where(~held))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests.licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_inner_products(rows, F.col("id") % 50 == 0, k=5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeat_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_along_curve(docs, tokenizer_path(), end_id=2, length=4096, with_ids=False).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 4) == 2
    model = fit_quality(docs.where(~held), labels.where(~held))
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_merge": op1_warc_merge,
    "op2_simhash_gph": op2_simhash_gph,
    "op3_mixing_tree": op3_mixing_tree,
    "op4_language_filters": op4_language_filters,
    "op5_pu_toxicity": op5_pu_toxicity,
    "op6_license_digests": op6_license_digests,
    "op7_pivot_topk": op7_pivot_topk,
    "op8_suffix_repeats": op8_suffix_repeats,
    "op9_hilbert_packing": op9_hilbert_packing,
    "op10_byte_cnn": op10_byte_cnn,
}

ORACLES: dict[str, str] = {
    "op1_warc_merge": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY digest)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h.digest AS payload_digest,
            CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM h LEFT JOIN f ON h.digest = f.digest AND h.n >= 100""",
    "op6_license_digests": license_digests.oracle_sql(),
    "op7_pivot_topk": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
