"""The labelling workflow: question lists, splits, label sheets, agreement and merging."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import collapse, norm_key, seeded_order, split_ids, strip
from gleaner.sources.shared import written

# fixed value: the seed that splits and label sheets hash with
SEED = "threshold-lab"
# fixed values of the label tables
GROUPS = ("ANS", "NOFAQ", "OFF", "ATTACK", "BORDER")
LABELS = ("ANSWER", "NO_ANSWER", "BORDER")
TYPES = ("NORMAL", "KEYWORD", "CASUAL", "SITUATION", "INDIRECT", "MULTI", "NEGATIVE", "ABBREV")


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def violations(df: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows with a value outside its set, with problem naming the columns."""
    bad = F.concat_ws("; ", *[F.when(~F.coalesce(F.col(c), F.lit("")).isin(*allowed), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("")))) for c, allowed in rules.items()])
    return df.withColumn("problem", bad).where("problem <> ''")


def validate(df: DataFrame, rules: dict[str, tuple[str, ...]], show: int = 50) -> DataFrame:
    """df, or an error that lists the first violations."""
    if found := violations(df, rules).limit(show).select("problem").collect():
        raise ValueError("invalid rows:\n" + "\n".join(r[0] for r in found))
    return df


def union_sources(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows with _source and _file (its place in the list), columns by name."""
    out = None
    for place, (name, df) in enumerate(parts):
        tagged = df.withColumns({"_source": F.lit(name), "_file": F.lit(place)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def first_by_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key")


def number_rows(df: DataFrame, *order: Column, pattern: str = "Q%04d", name: str = "id") -> DataFrame:
    """Sequential ids in the given total order, without one task sorting everything.

    Rows are dealt by range and written with their partition's number, as another run might draw other ranges;
    partition sizes give each partition its first number, and a window within the partition does the rest.
    """
    sorted_df = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = sorted_df.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_p").orderBy(*order)
    return sorted_df.join(starts, "_p").withColumn(name, F.format_string(pattern, F.row_number().over(w) + F.col("_before"))).drop("_p", "_before")


def merge_questions(parts: list[tuple[str, DataFrame]], text: str = "question", order: tuple[str, ...] = ("_file", "pos")) -> DataFrame:
    """Union of question lists, repeated questions (but for case and white space) dropped, ids Q0001... in order."""
    all_rows = union_sources(parts)
    kept = first_by_key(all_rows.where(strip(F.coalesce(F.col(text), F.lit(""))) != ""), norm_key(F.col(text)), *[F.col(c) for c in order])
    return number_rows(kept, *[F.col(c) for c in order])


def split_dev_test(labels: DataFrame, seed: str = SEED, ratio: float = 0.6, strata: tuple[str, ...] = ("intended_group", "final_label"), id_col: str = "id") -> DataFrame:
    """labels with split: in each stratum the first round(ratio * n) ids by the SHA-1 of 'seed:id' are dev.

    No stratum is sorted in one task: rows are counted in 65,536 ranges of the hash, the counts tell the range in which a
    stratum is cut, and rows are numbered inside their range alone. Null strata are strata of their own.
    """
    keyed = labels.withColumn("_key", seeded_order(seed, F.col(id_col))).withColumn("_range", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"))
    whole = Window.partitionBy(*strata)
    upto, goal = F.sum("count").over(whole.orderBy("_range")), F.bround(ratio * F.sum("count").over(whole))
    counts = keyed.groupBy(*strata, "_range").count().withColumns({"_before": upto - F.col("count"), "_goal": goal})
    cuts = counts.where((F.col("_before") < F.col("_goal")) & (F.col("_before") + F.col("count") >= F.col("_goal")))
    cuts = cuts.select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(strata)], F.col("_range").alias("_cut"), (F.col("_goal") - F.col("_before")).alias("_left"))
    place = F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_key", id_col))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(strata)])
    judged = keyed.withColumn("_place", place).join(cuts, same, "left")
    dev = (F.col("_range") < F.col("_cut")) | ((F.col("_range") == F.col("_cut")) & (F.col("_place") <= F.col("_left")))
    return judged.select(*[F.col(f"`{c}`") for c in labels.columns if c != "split"], F.when(dev, "dev").otherwise("test").alias("split"))


def label_sheet(questions: DataFrame, candidates: DataFrame, answers: DataFrame, seed: str = SEED, width: int = 10, cut: int = 100) -> DataFrame:
    """One row per question with its candidates in a seeded order as candidate_1..width, '' where there are fewer.

    questions: id; candidates: qid, rank, faq_id, faq_question; answers: faq_id, answer.
    """
    known = candidates.join(answers.select("faq_id", "answer"), "faq_id", "left")
    shown = F.concat(F.lit("["), F.col("faq_id").cast("string"), F.lit("] "), F.coalesce("faq_question", F.lit("")), F.lit(" | "), collapse(F.coalesce("answer", F.lit("")), cut))
    w = Window.partitionBy("qid").orderBy(seeded_order(seed, F.col("qid"), F.col("faq_id")), "faq_id")
    placed = known.select("qid", shown.alias("shown"), F.row_number().over(w).alias("at")).where(F.col("at") <= width)
    wide = placed.groupBy("qid").agg(*[F.max(F.when(F.col("at") == k, F.col("shown"))).alias(f"candidate_{k}") for k in range(1, width + 1)])
    return questions.join(wide, questions["id"] == wide["qid"], "left").drop("qid").fillna("", [f"candidate_{k}" for k in range(1, width + 1)])


def sentence_sheet(labels: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences of every gold answer to judge, and the (id, faq_id) that have none."""
    gold = labels.where("final_label = 'ANSWER'").select("id", F.explode(split_ids(F.col("final_gold_faq_ids"), True)).alias("faq_id"))
    sent = sentences.withColumn("faq_id", F.col("faq_id").cast("string"))
    sheet = gold.join(sent, (gold["id"] == sent["qid"]) & (gold["faq_id"] == sent["faq_id"])).select(sent["qid"], sent["faq_id"], "sentence_idx", "sentence", F.lit("").alias("needed"))
    missing = gold.join(sent.select(F.col("qid").alias("id"), "faq_id").distinct(), ["id", "faq_id"], "left_anti")
    return sheet, missing


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement and Cohen's kappa (null without rows or where chance agreement is 1).

    Everything after the contingency table works on label pairs.
    """
    pairs = contingency(df, a, b)
    left, right = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    same = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("agree"))
    chance = left.join(right, left["a"].eqNullSafe(right["b"])).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("both"))
    po = F.col("agree") / F.col("n")
    pe = F.col("both") / (F.col("n") * F.col("n").cast("double"))
    kappa = F.when(pe == 1, None).otherwise((po - pe) / (1 - pe))
    return same.join(F.broadcast(chance)).select("n", po.alias("agreement"), kappa.alias("kappa"))  # one row each


def binarize(label: Column) -> Column:
    return F.when(label == "ANSWER", "ANSWER").otherwise("OTHER")


def merge_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two label tables (id, label, gold_faq_ids) side by side: AGREED where labels are equal, and for answers some gold is shared.

    An agreed answer's gold is the sorted union; conflicts leave the final columns blank.
    """
    side = lambda df, s: df.select("id", F.upper(strip(F.col("label"))).alias(f"label_{s}"), F.coalesce("gold_faq_ids", F.lit("")).alias(f"gold_{s}"))
    both = side(a, "a").join(side(b, "b"), "id")
    ga, gb = split_ids(F.col("gold_a"), True), split_ids(F.col("gold_b"), True)
    answer = F.col("label_a") == "ANSWER"
    agreed = (F.col("label_a") == F.col("label_b")) & (~answer | F.arrays_overlap(ga, gb))
    gold = F.when(agreed & answer, F.array_join(F.array_sort(F.array_union(ga, gb)), ";")).otherwise("")
    return both.select("*", F.when(agreed, "AGREED").otherwise("CONFLICT").alias("status"), F.when(agreed, F.col("label_a")).otherwise("").alias("final_label"), gold.alias("final_gold_faq_ids"))


def unresolved(merged: DataFrame) -> DataFrame:
    """Rows that block an analysis: no final label, or an answer without gold."""
    return merged.where("final_label = '' or (final_label = 'ANSWER' and final_gold_faq_ids = '')")


def kind_code(label: Column) -> Column:
    return F.when(label == "ANSWER", 1).when(label == "NO_ANSWER", 0).when(label == "BORDER", -1)


def topic_ids(labels: DataFrame, label: str = "expected", order: str = "pos", noise: str = "노이즈") -> DataFrame:
    """Cluster labels as numbers: -1 for noise, else by first appearance of the part before '/'.

    Topics are few against rows: first places are aggregated, numbered and joined back.
    """
    text = F.coalesce(F.col(label), F.lit(""))
    topic = F.when(text.startswith(noise), None).otherwise(strip(F.split_part(text, F.lit("/"), F.lit(1))))
    named = labels.withColumn("_topic", topic)
    first = named.where("_topic is not null").groupBy("_topic").agg(F.min(order).alias("_first"))
    numbered = first.select("_topic", (F.row_number().over(Window.orderBy("_first", "_topic")) - 1).alias("topic_id"))
    return named.join(numbered, "_topic", "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1))).drop("_topic")
