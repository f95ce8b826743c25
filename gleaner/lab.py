"""Adapters: the driver's tables as the inputs of retrieval evaluation.

embeddings: vec_id divisible by 10 are queries, the others the corpus; equal labels
are right answers. Labels 0 to 6 are answerable, 7 and 8 not, 9 is borderline; as
intents, labels 0 to 2 are known and others irrelevant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.vectors import chunks, cosine, maxsim
from gleaner.operators import retrieve
from gleaner.operators.labels import split_dev_test


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries_and_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("label").alias("ql"))
    return q, e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), F.col("label").alias("cl"))


def labelled_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """qid, rank, cid, score, ql, cl."""
    q, c = queries_and_corpus(spark, sf_dir)
    return retrieve.top_k(q, c, k).join(q.select("qid", "ql"), "qid").join(c.select("cid", "cl"), "cid")


def with_vectors(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = queries_and_corpus(spark, sf_dir)
    return hits.join(q.select("qid", F.col("vec").alias("qv")), "qid").join(c.select("cid", F.col("vec").alias("cv")), "cid")


def late_score(q: str = "qv", c: str = "cv") -> Column:
    """Late interaction over vectors read as 8 rows of 8."""
    return F.round(maxsim(chunks(F.col(q), 8, 8), chunks(F.col(c), 8, 8)), 6)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.top_k(*queries_and_corpus(spark, sf_dir), 10).select("qid", "rank", F.col("cid").cast("string").alias("faq_id"), F.col("score").alias("similarity"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate as four sentences: the cosines of the vectors' quarters."""
    hits = retrieve.top_k(*queries_and_corpus(spark, sf_dir), 10).select("qid", "cid")
    pairs = with_vectors(hits, spark, sf_dir)
    parts = F.array(*[F.round(cosine(F.slice("qv", 1 + 16 * k, 16), F.slice("cv", 1 + 16 * k, 16)), 6) for k in range(4)])
    return pairs.select("qid", F.col("cid").cast("string").alias("faq_id"), F.posexplode(parts).alias("sentence_idx", "similarity"))


def sentence_labels(sent: DataFrame) -> DataFrame:
    return sent.select("qid", "faq_id", "sentence_idx", F.when((F.col("faq_id").cast("long") + F.col("sentence_idx")) % 3 == 0, "Y").otherwise("N").alias("needed"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, kind, group, final_label, split, gold."""
    q, c = queries_and_corpus(spark, sf_dir)
    gold = q.select("qid", "ql").join(c.select("cid", "cl"), (F.col("ql") == F.col("cl")) & (F.col("cid") % 3 == (F.col("qid") / 10).cast("long") % 3)).groupBy("qid").agg(F.collect_list(F.col("cid").cast("string")).alias("gold"))
    kind = F.when(F.col("ql") <= 6, 1).when(F.col("ql") <= 8, 0).otherwise(-1)
    label = F.when(F.col("ql") <= 6, "ANSWER").when(F.col("ql") <= 8, "NO_ANSWER").otherwise("BORDER")
    base = q.select("qid", kind.alias("kind"), F.concat(F.lit("G"), F.col("ql") % 4).alias("group"), label.alias("final_label"))
    made = split_dev_test(base, strata=("group", "final_label"), id_col="qid")
    return made.join(gold, "qid", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
