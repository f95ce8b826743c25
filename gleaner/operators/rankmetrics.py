"""Rank metrics: first ranks, hits, reciprocal ranks, hard negatives, summaries, change classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: the name of the row over all categories
OVERALL = "전체"


def first_rank(ranked: DataFrame, targets: str = "targets", name: str = "target_rank") -> DataFrame:
    """qid and the smallest rank of any target id, null if none is ranked. ranked: qid, rank, cid and an array of targets."""
    hit = F.array_contains(F.col(targets).cast("array<string>"), F.col("cid").cast("string"))
    return ranked.groupBy("qid").agg(F.min(F.when(hit, F.col("rank"))).alias(name))


def count_better(scored: DataFrame, target: DataFrame, name: str = "target_rank") -> DataFrame:
    """First rank without a full sort: one more than the rows that beat the query's best target.

    scored: qid, cid, score; target: qid, cid. The best target is found by a maximum, then rows are counted, so
    a query's rows are never sorted and both passes combine before the shuffle.
    """
    order = F.struct(F.col("score"), (-F.col("cid")).alias("c"))
    best = scored.join(target, ["qid", "cid"], "left_semi").groupBy("qid").agg(F.max(order).alias("best"))
    return scored.join(best, "qid").groupBy("qid").agg((F.count_if(order > F.col("best")) + 1).cast("int").alias(name))


def hit_at(rank: Column, k: int | Column) -> Column:
    return F.coalesce(rank <= k, F.lit(False))


def reciprocal_rank(rank: Column, cut: int | Column | None = None) -> Column:
    """1 / rank; 0 where there is none or it is beyond the cut."""
    ok = rank.isNotNull() if cut is None else F.coalesce(rank <= cut, F.lit(False))
    return F.when(ok, 1.0 / rank).otherwise(0.0)


def hard_negative_pass(gold: Column, negative: Column, has_negatives: Column) -> Column:
    """True without negatives; else the gold is found and no negative is before it."""
    return ~has_negatives | (gold.isNotNull() & (negative.isNull() | (gold < negative)))


def add_metrics(ranks: DataFrame, rank: str = "gt_rank") -> DataFrame:
    r = F.col(rank)
    return ranks.withColumns({"top1": hit_at(r, 1), "top3": hit_at(r, 3), "top5": hit_at(r, 5), "rr": reciprocal_rank(r)})


def summarize(detail: DataFrame, keys: tuple[str, ...] = ("model",), category: str = "category", extra: dict[str, Column] | None = None, digits: int | None = 3) -> DataFrame:
    """One row for all categories (named OVERALL) and one for each, by one GROUPING SETS pass."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    found = {"n": F.count(F.lit(1)), "top1": rate("top1"), "top3": rate("top3"), "top5": rate("top5"), "mrr": F.avg("rr")}
    if "hard_neg_pass" in detail.columns:
        found["hard_negative_acc"] = rate("hard_neg_pass")
    found |= extra or {}
    sets = [[F.col(k) for k in keys], [*(F.col(k) for k in keys), F.col(category)]]
    out = detail.groupingSets(sets, *[F.col(k) for k in keys], F.col(category)).agg(F.grouping(category).alias("_all"), *[v.alias(k) for k, v in found.items()])
    name = F.when(F.col("_all") == 1, OVERALL).otherwise(F.col(category))
    shown = [F.col("n") if k == "n" else (F.bround(k, digits).alias(k) if digits is not None and k not in (extra or {}) else F.col(k)) for k in found]
    return out.select(*keys, name.alias(category), *shown)


def warm_latency(calls: DataFrame, key: str = "model", order: str = "call", latency: str = "latency") -> DataFrame:
    """Mean latency without each key's first call (where it has more than one), its throughput and nearest-rank p95 of the same calls."""
    firsts = calls.groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    warm = calls.join(firsts, key).where((F.col("_n") == 1) | (F.col(order) > F.col("_first")))
    return warm.groupBy(key).agg(F.avg(latency).alias("avg_latency"), F.try_divide(F.lit(1.0), F.avg(latency)).alias("throughput"), p95(latency).alias("p95_latency"))


def p95(c: str) -> Column:
    """Nearest rank: the value at place ceil(0.95 n) of the sorted values."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")


def change_class(base: Column, new: Column, k: int | Column) -> Column:
    """How re-ranking the first k moved the gold: missed before, error, improved, worsened or same."""
    return F.when(base.isNull() | (base > k), "stage1_miss").when(new.isNull(), "error").when(new < base, "improved").when(new > base, "worsened").otherwise("same")


def change_class_buffer(base: Column, new: Column, k: int | Column, window: int | Column) -> Column:
    """The same for a window wider than the final k: moves that cross k are entries and drops; those outside it are same."""
    missed = base.isNull() | (base > window)
    was, now = base <= k, F.coalesce(new <= k, F.lit(False))
    return (
        F.when(missed, "stage1_miss").when(was & ~now, "worsened_out").when(~was & now, "improved_in")
        .when(was & now & (new < base), "improved_up").when(was & now & (new > base), "worsened_down").otherwise("same")
    )


def change_counts(detail: DataFrame, keys: list[str], change: str = "change") -> DataFrame:
    c = F.col(change)
    return detail.groupBy(*keys).agg(
        F.count_if(c.startswith("improved")).alias("n_improved"), F.count_if(c.startswith("worsened")).alias("n_worsened"),
        F.count_if(c == "same").alias("n_unchanged"), F.count_if(c == "stage1_miss").alias("n_stage1_miss"),
    )


def pivot_categories(summary: DataFrame, row: str = "model", category: str = "category", value: str = "top1", values: list[str] | None = None) -> DataFrame:
    """Rows by model, a column for each category; missing ones '-'."""
    wide = summary.groupBy(row).pivot(category, values).agg(F.first(value))
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")).alias(c) for c in wide.columns if c != row])
