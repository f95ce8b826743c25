"""Intent routing by a similarity threshold: sweeps, recalls and failure lists.

cases: qid, question (optional), intents (array of strings; empty: irrelevant).
hits: qid, rank, intent, score, the k best of each case. thresholds: one column t.

A case survives a threshold with the set of intents of which some hit reaches it
(score >= t). Only a case's best score of each intent can matter, so hits are reduced to
that before they meet the thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def threshold_range(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """start, start + step, ... to stop, each rounded to 6 decimals."""
    n = int(round((stop - start) / step)) + 1
    return spark.range(n).select(F.round(F.lit(start) + F.col("id") * F.lit(step), 6).alias("t"))


def threshold_list(spark: SparkSession, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], "t double")


def parse_thresholds(spark: SparkSession, text: str) -> DataFrame:
    """'start:stop:step' or 'a,b,c'."""
    if ":" in text:
        return threshold_range(spark, *(float(x) for x in text.split(":")))
    return threshold_list(spark, [float(x) for x in text.split(",") if x.strip()])


def map_intents(corpus: DataFrame, groups: dict[str, str], intent: str = "intent") -> DataFrame:
    """Replace intent codes by their groups; an unknown code raises."""
    table = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    found = F.try_element_at(table, F.trim(intent))
    return corpus.withColumn(intent, F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown intent: "), F.coalesce(intent, F.lit("null"))))).otherwise(found))


def best_by_intent(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid", "intent").agg(F.max("score").alias("score"))


def survivors(cases: DataFrame, hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """qid, intents, t, predicted (sorted set)."""
    each = cases.select("qid", "intents").join(F.broadcast(thresholds))
    reached = best_by_intent(hits).join(F.broadcast(thresholds), F.col("score") >= F.col("t")).groupBy("qid", "t").agg(F.array_sort(F.collect_set("intent")).alias("predicted"))
    return each.join(reached, ["qid", "t"], "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))


def recall_sweep(survived: DataFrame) -> DataFrame:
    """t, intent, n, n_ok, rate: recall of each intent (a case counts for each of its intents); intent null is the accuracy on irrelevant cases."""
    relevant = survived.where(F.size("intents") > 0).select("t", F.explode("intents").alias("intent"), "predicted")
    ok = relevant.select("t", "intent", F.array_contains("predicted", F.col("intent")).alias("ok"))
    other = survived.where(F.size("intents") == 0).select("t", F.lit(None).cast("string").alias("intent"), (F.size("predicted") == 0).alias("ok"))
    return ok.unionByName(other).groupBy("t", "intent").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok")).withColumn("rate", F.coalesce(F.try_divide(F.col("n_ok"), F.col("n")), F.lit(0.0)))


def bottleneck(sweep: DataFrame) -> DataFrame:
    """t, bottleneck (the lowest recall), irrelevant (accuracy there)."""
    known = F.col("intent").isNotNull()
    return sweep.groupBy("t").agg(F.min(F.when(known, F.col("rate"))).alias("bottleneck"), F.max(F.when(~known, F.col("rate"))).alias("irrelevant"))


def lowest_safe_threshold(bottlenecks: DataFrame) -> DataFrame:
    """One row: the lowest t at which every irrelevant case is refused, and the bottleneck there."""
    safe = F.col("irrelevant") == 1
    return bottlenecks.agg(F.min(F.when(safe, F.col("t"))).alias("t"), F.min_by("bottleneck", F.when(safe, F.col("t"))).alias("bottleneck"))


def recall_failures(survived: DataFrame, hits: DataFrame) -> DataFrame:
    """t, qid, missed intent, best score, reason: no candidate of that intent, or one below the threshold."""
    missed = survived.select("t", "qid", F.explode(F.array_except("intents", "predicted")).alias("intent"))
    best = best_by_intent(hits).withColumnRenamed("score", "best_score")
    reason = F.when(F.col("best_score").isNull(), "no candidate").otherwise("below threshold")
    return missed.join(best, ["qid", "intent"], "left").select("t", "qid", "intent", "best_score", reason.alias("reason"))


def irrelevant_failures(survived: DataFrame) -> DataFrame:
    """t, qid, predicted of irrelevant cases that are let through."""
    return survived.where((F.size("intents") == 0) & (F.size("predicted") > 0)).select("t", "qid", F.array_join("predicted", "+").alias("predicted"))


def candidate_details(cases: DataFrame, hits: DataFrame) -> DataFrame:
    return cases.select("qid", F.coalesce(F.nullif(F.array_join("intents", "+"), F.lit("")), F.lit("무관")).alias("expected")).join(hits.select("qid", "rank", "intent", "score"), "qid", "left")


def keep_answer_intent(questions: DataFrame, intent: Column | None, keep: str = "FAQ_RAG") -> DataFrame:
    """Rows whose intent is absent, blank or the one to keep."""
    return questions if intent is None else questions.where(F.trim(F.coalesce(intent, F.lit(""))).isin("", keep))


def acceptable_or_gold(acceptable: Column, gold: Column) -> Column:
    return F.when(F.size(acceptable) > 0, acceptable).otherwise(gold)
