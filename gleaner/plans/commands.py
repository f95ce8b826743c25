"""The command line: label workflow, threshold analysis, intent analysis, model and re-ranking comparisons, clustering.

    python -m gleaner.plans.commands <command> [options]

Inputs and outputs are paths that Spark reaches. Each command is a plan of operators; only
small results (reports) are formatted on the driver.
"""

from __future__ import annotations

import argparse
import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.models import REGISTRY, ModelSpec, embed_column, encode_column, evaluate_models, score_column, select_models, timed_score_column, try_embed_column
from gleaner.functions.text import norm_key, parse_double, split_ids, split_intents
from gleaner.functions.vectors import cosine, strict_cosine
from gleaner.operators import cluster, intents, labels, rankmetrics, retrieve, runlog, thresholds
from gleaner.sources import files, sheets
from gleaner.sources.shared import written
from gleaner.sources.vectors import vector_table

REQUIRED = ("group", "expression_type", "question")


def _session() -> SparkSession:
    return SparkSession.builder.appName("gleaner").getOrCreate()


def merge_questions(spark: SparkSession, inputs: list[str], out: str) -> DataFrame:
    """Question lists into one: validated, repeated questions dropped, ids Q0001..."""
    parts = []
    for path in inputs:
        df = labels.require_columns(files.with_position(files.read_text_csv(spark, path)), REQUIRED)
        df = df.withColumns({c: F.upper(F.trim(c)) for c in ("group", "expression_type")}).where(norm_key(F.col("question")) != "")
        parts.append((path, labels.validate(df, {"group": labels.GROUPS, "expression_type": labels.TYPES})))
    merged = labels.merge_questions(parts)
    rows = merged.select("id", "group", "expression_type", "question", *([] if "writer" not in merged.columns else ["writer"]))
    files.write_csv(rows, out)
    return rows


def label_sheet(spark: SparkSession, questions: str, data: str, out: str, seed: str = labels.SEED) -> DataFrame:
    """questions.csv and a folder with candidates.csv and faq_catalog.csv into a sheet to label."""
    q = files.read_text_csv(spark, questions)
    cands = files.read_text_csv(spark, f"{data}/candidates.csv")
    sheet = labels.label_sheet(q.select("id", "question", F.col("group").alias("intended_group"), "expression_type"), cands.select("qid", "rank", "faq_id", "faq_question"), files.read_text_csv(spark, f"{data}/faq_catalog.csv").select("faq_id", "answer"), seed)
    sheet = sheet.withColumns({c: F.lit("") for c in ("label", "gold_faq_ids", "gold_outside", "note")})
    files.write_csv(sheet, out)
    return sheet


def merge_labels(spark: SparkSession, a: str, b: str, out: str, warn=print) -> DataFrame:
    left, right = files.read_text_csv(spark, a), files.read_text_csv(spark, b)
    for df in (left, right):
        labels.validate(df.withColumn("label", F.upper(F.trim("label"))), {"label": labels.LABELS})
    merged = labels.merge_labels(left, right).join(left.select("id", "question", "intended_group", "expression_type"), "id", "left")
    rate = labels.agreement(merged, "label_a", "label_b").first()
    two = merged.select(labels.binarize(F.col("label_a")).alias("x"), labels.binarize(F.col("label_b")).alias("y"))
    binary = labels.agreement(two, "x", "y").first()
    if rate["kappa"] is not None and rate["kappa"] < 0.6:
        warn(f"kappa {rate['kappa']:.3f} is below 0.6")
    warn(f"agreement {rate['agreement']}, kappa {rate['kappa']}, binary kappa {binary['kappa']}")
    files.write_csv(merged, out)
    return merged


def sentence_sheet(spark: SparkSession, label_path: str, data: str, out: str, warn=print) -> DataFrame:
    sheet, missing = labels.sentence_sheet(files.read_text_csv(spark, label_path), files.read_text_csv(spark, f"{data}/sentences.csv").withColumn("sentence_idx", F.col("sentence_idx").cast("int")))
    for r in missing.limit(50).collect():
        warn(f"no sentences: {r['id']} {r['faq_id']}")
    files.write_csv(sheet, out)
    return sheet


def load_dataset(spark: SparkSession, label_path: str, data: str, sentence_labels: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(dataset, labels, sentences, sentence labels); rows without a final label are an error."""
    lab = files.read_text_csv(spark, label_path)
    if bad := labels.unresolved(lab).limit(10).select("id").collect():
        raise ValueError("unresolved: " + ", ".join(r[0] for r in bad))
    lab = labels.split_dev_test(lab).select(F.col("id").alias("qid"), labels.kind_code(F.col("final_label")).alias("kind"), F.col("intended_group").alias("group"), "split", split_ids(F.col("final_gold_faq_ids"), True).alias("gold"))
    cand = files.read_text_csv(spark, f"{data}/candidates.csv").select("qid", F.col("rank").cast("int").alias("rank"), "faq_id", parse_double(F.col("similarity")).alias("similarity"))
    sent = files.read_text_csv(spark, f"{data}/sentences.csv").select("qid", "faq_id", F.col("sentence_idx").cast("int").alias("sentence_idx"), parse_double(F.col("similarity")).alias("similarity"))
    need = None if not sentence_labels else files.read_text_csv(spark, sentence_labels).select("qid", "faq_id", F.col("sentence_idx").cast("int").alias("sentence_idx"), "needed")
    return thresholds.build_dataset(lab, cand, sent, need), lab, sent, need


def dev(spark: SparkSession, label_path: str, data: str, out: str, sentence_labels: str | None = None, weights: str | None = None, prior: float = 0.75, draws: int = 1000, seed: int = 20261019, t1: tuple[float, float, float] = (0.5, 0.9, 0.01), t2: tuple[float, float, float] = (0.4, 0.9, 0.01), caps: tuple[float, float] = (0.05, 0.15)) -> DataFrame:
    """Grid analysis on the dev questions: grid_dev, t1_view, t2_view, dev_report and the picked pairs (returned)."""
    dataset, lab, sent, need = load_dataset(spark, label_path, data, sentence_labels)
    part = thresholds.check_classes(dataset.where("split = 'dev'")).persist()
    loss = files.read_json(spark, weights) if weights else thresholds.WEIGHTS
    g1, g2 = thresholds.grid_values(spark, *t1, "t1"), thresholds.grid_values(spark, *t2, "t2")
    cells = thresholds.grid_loss(part, g1, g2, loss, prior).join(thresholds.loss_intervals(part, thresholds.grid(g1, g2), loss, prior, draws, seed), ["t1", "t2"]).persist()
    picks = thresholds.pick_candidates(thresholds.smooth(cells, ["loss", "loss_p90", "false_pass", "noans"]), *caps).persist()
    files.write_csv(cells.orderBy("t1", "t2"), f"{out}/grid_dev")
    files.write_csv(thresholds.t1_view(part, g1).orderBy("t1"), f"{out}/t1_view")
    rows = thresholds.gold_sentences(lab.where("split = 'dev'"), sent, need)
    files.write_csv(thresholds.t2_view(rows, g2).orderBy("t2"), f"{out}/t2_view")
    picks.coalesce(1).write.mode("overwrite").json(f"{out}/dev_candidates")
    limits, border, false_pass = thresholds.gold_rank_limits(part).first(), thresholds.border_report(part, picks).collect(), thresholds.group_false_pass(part, picks).collect()
    report = ["# Threshold analysis (dev)", "", f"Answerable questions: {limits['n']}; gold beyond rank 3: {limits['beyond_3']:.3f}, beyond 10: {limits['beyond_10']:.3f}", "", "| profile | T1 | T2 |", "|---|---|---|"]
    report += [f"| {r['profile']} | {r['t1']} | {r['t2']} |" for r in picks.collect()]
    report += ["", *[f"- border passes at ({r['t1']}, {r['t2']}): {r['rate']:.3f}" for r in border], *[f"- {r['group']} at ({r['t1']}, {r['t2']}): {r['passed']} of {r['total']} pass" for r in false_pass]]
    files.write_lines(report, spark, f"{out}/dev_report")
    return picks


def final(spark: SparkSession, label_path: str, data: str, out: str, pairs: list[tuple[float, float]] | None = None, candidates: str | None = None, force: bool = False, **more) -> DataFrame:
    """At most four pairs on the test questions, once: the written result is the lock."""
    keep = {k: more.pop(k) for k in ("sentence_labels",) if k in more}
    dataset, *_ = load_dataset(spark, label_path, data, **keep)
    dataset = dataset.persist()
    chosen = spark.createDataFrame(pairs, "t1 double, t2 double") if pairs else spark.read.json(candidates).select("t1", "t2")
    loss = files.read_json(spark, more.pop("weights")) if more.get("weights") else thresholds.WEIGHTS
    more.pop("weights", None)
    scores = thresholds.final_scores(dataset, chosen, loss, **more)
    if force:
        scores.write.mode("overwrite").json(f"{out}/final_scores")
    else:
        files.write_once(scores, f"{out}/final_scores")
    scores = spark.read.json(f"{out}/final_scores")
    found = {(r["split"], r["t1"], r["t2"]): r for r in scores.collect()}
    test = dataset.where("split = 'test'")
    border = {(r["t1"], r["t2"]): r["rate"] for r in thresholds.border_report(test, chosen).collect()}
    n = {r[0]: r[1] for r in test.select("qid", "kind").distinct().groupBy("kind").count().collect()}
    show = lambda v, form: "-" if v is None else format(v, form)
    report = ["# Threshold analysis (test)", "", f"Answerable questions: {n.get(1, 0)}; unanswerable: {n.get(0, 0)}; border: {n.get(-1, 0)}", ""]
    report += ["| T1 | T2 | loss test (90 % interval) | loss dev | correct | incomplete | wrong | no answer | false pass (90 % interval) | border passes |", "|---|---|---|---|---|---|---|---|---|---|"]
    for (split, t1, t2), r in sorted(found.items()):
        if split == "test":
            before = found.get(("dev", t1, t2))
            cells = [f"{t1:.2f}", f"{t2:.2f}", f"{show(r['loss'], '.3f')} ({show(r['loss_lo'], '.3f')} to {show(r['loss_hi'], '.3f')})", show(before and before["loss"], ".3f")]
            cells += [show(r[c], ".1%") for c in ("correct", "incomplete", "wrong", "noans")]
            cells += [f"{show(r['false_pass'], '.1%')} ({show(r['fp_lo'], '.1%')} to {show(r['fp_hi'], '.1%')})", show(border.get((t1, t2)), ".1%")]
            report.append("| " + " | ".join(cells) + " |")
    report += ["", "A loss well above the dev loss says that the pick was lucky. Pairs whose intervals overlap widely can't be told apart. Don't pick again after this."]
    files.write_lines(report, spark, f"{out}/final_report")
    return scores


def intent_analysis(spark: SparkSession, corpus: str, tests: str, out: str, groups: dict[str, str], k: int = 3, sweep: str = "0.30:0.90:0.02", spec: ModelSpec = ModelSpec("hashed"), rerank: bool = False, window: int = 10, prefilter: int = 50, alpha: float | None = 0.6, late: bool = False) -> DataFrame:
    """Hits of each case, recall by threshold, and both failure lists under out; returns the recalls.

    Stages: the ``prefilter`` best by dense vectors, hybrid scores (alpha None: dense alone), then re-ranking by the
    cross-encoder or by late interaction over ``window``.
    """
    c = intents.map_intents(files.read_positional_csv(spark, corpus).select(F.col("_c0").alias("text"), F.col("_c1").alias("intent")), groups)
    c = files.with_position(c, "cid")
    t = files.with_position(files.read_positional_csv(spark, tests).select(F.col("_c0").alias("question"), split_intents(F.col("_c1")).alias("intents")), "qid")
    q = written(t.select("qid", F.col("question").alias("text"), encode_column(F.col("question"), spec, "query", late).alias("enc")), "queries")
    rows = written(c.select("cid", "intent", "text", encode_column(F.col("text"), spec, "passage", late).alias("enc")), "corpus")
    found = retrieve.search(q, rows, k, prefilter, alpha, score_column if rerank else None, late, window)
    hits = found.join(rows.select("cid", "intent", "text"), "cid").persist()
    survived = intents.survivors(t.select("qid", "intents"), hits, intents.parse_thresholds(spark, sweep)).persist()
    recalls = intents.recall_sweep(survived)
    for name, df in (("candidates", intents.candidate_details(t, hits)), ("summary", recalls), ("recall_failures", intents.recall_failures(survived, hits)), ("irrelevant_failures", intents.irrelevant_failures(survived))):
        files.write_csv(df, f"{out}/{name}")
    return recalls


def method_name(rerank: bool, late: bool, alpha: float | None) -> str:
    return ("dense" if alpha is None else "hybrid") + ("+rerank" if rerank else "+late" if late else "")


def _holds(ids: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which of the ids in ``one`` (a row) each list of ids (a column) holds."""
    return np.array([np.isin(one[0], [] if own is None else list(own)) for own in ids[:, 0]])


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    """The run log there, if any."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return runlog.read_log(spark, path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def _corpus_and_tests(spark: SparkSession, workbook: str, faq_sheet: str, query_sheets: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    raw = sheets.read_xlsx(spark, workbook, faq_sheet, 8, 1)
    tests = sheets.query_workbook(spark, workbook, query_sheets)
    if tests is None:
        raise ValueError("no query sheet")
    return sheets.faq_corpus(raw.select(F.col("c0").alias("faq_id"), F.col("c2").alias("question"), "pos")), tests


def model_benchmark(spark: SparkSession, workbook: str, out: str, specs: list[ModelSpec], faq_sheet: str, query_sheets: dict[str, str], models: list[str] | None = None) -> DataFrame | None:
    """Each model over all query sheets: summary rows by category, appended to out as one numbered run.

    The row over all categories also has the latencies of embedding a query, without the first call. Each query's ranks
    go to ``<out>_detail`` under the same run.
    """
    faq, tests = _corpus_and_tests(spark, workbook, faq_sheet, query_sheets)
    details: dict[str, DataFrame] = {}

    def evaluate(spec: ModelSpec) -> DataFrame:
        timed = written(tests.select(F.col("test_id").alias("qid"), "category", "pos", try_embed_column(F.col("query"), spec, "query").alias("e")), "timed")
        if bad := timed.where("e.error is not null").select("e.error").first():
            raise RuntimeError(bad[0])
        q = timed.select("qid", F.col("e.vec").alias("vec"))
        c = written(faq.select(F.col("pos").alias("cid"), F.col("faq_id").cast("string").alias("tag"), embed_column(F.col("question"), spec).alias("vec")), "corpus")
        # a query's tag is a list of ids, a corpus row's its id
        wanted = {n: q.join(tests.select(F.col("test_id").alias("qid"), F.col(a).cast("array<string>").alias("tag")), "qid") for n, a in (("gt_rank", "gt_ids"), ("acceptable_rank", "acceptable_ids"), ("neg_rank", "hard_neg_ids"))}
        first = tests.select(F.col("test_id").alias("qid"), "category", "query", "hard_neg_ids")
        for name, asked in wanted.items():
            first = first.join(retrieve.first_ranks(asked, c, {name: _holds}), "qid", "left")
        detail = rankmetrics.add_metrics(first).withColumn("hard_neg_pass", rankmetrics.hard_negative_pass(F.col("gt_rank"), F.col("neg_rank"), F.size("hard_neg_ids") > 0))
        details[spec.name] = detail = written(detail.withColumn("model", F.lit(spec.name)), "detail")
        calls = timed.select(F.lit(spec.name).alias("model"), F.struct("category", "pos").alias("call"), F.col("e.sec").alias("latency"))
        speed = rankmetrics.warm_latency(calls).withColumn("category", F.lit(rankmetrics.OVERALL))
        return rankmetrics.summarize(detail).join(F.broadcast(speed), ["model", "category"], "left")

    result = evaluate_models(select_models(specs, models), evaluate)
    if result is not None:
        result = runlog.numbered(_log(spark, out), result)
        run, stamp = result.select("run", "timestamp").first()
        done = [r[0] for r in result.select("model").distinct().collect()]
        for name in done:
            rows = details[name].select(F.lit(run).alias("run"), F.lit(stamp).alias("timestamp"), "model", "qid", "category", "query", "gt_rank", "acceptable_rank", "neg_rank", "hard_neg_pass", "rr")
            runlog.append_parquet(rows, f"{out}_detail")
        runlog.append_parquet(result, out)
    return result


def rerank_detail(hits: DataFrame, gold: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """final_k, window, qid, category, query, base, new, change, rerank_sec of each question.

    hits: qid, rank, cid, tag, rerank_score, sec, for the widest window at least; gold: qid, category, query, gt_ids. base and
    new are the gold's ranks before and after. Where the window is final_k, changes are of plain re-ranking, else of a buffer.
    """
    has = F.array_contains(F.col("gt_ids").cast("array<string>"), F.col("tag"))
    base = hits.join(gold.select("qid", "gt_ids"), "qid").groupBy("qid").agg(F.min(F.when(has, F.col("rank"))).alias("base"))
    swept = retrieve.rerank_sweep(hits, F.col("rerank_score"), windows).join(gold.select("qid", "gt_ids"), "qid")
    new = swept.groupBy("qid", "final_k", "window").agg(F.min(F.when(has, F.col("rank"))).alias("new"))
    grid = hits.sparkSession.createDataFrame(windows, "window int, final_k int")
    spent = hits.join(F.broadcast(grid), F.col("rank") <= F.col("window")).groupBy("qid", "final_k", "window").agg(F.sum("sec").alias("rerank_sec"))
    plain = rankmetrics.change_class(F.col("base"), F.col("new"), F.col("final_k"))
    change = F.when(F.col("window") == F.col("final_k"), plain).otherwise(rankmetrics.change_class_buffer(F.col("base"), F.col("new"), F.col("final_k"), F.col("window")))
    each = new.join(base, "qid").join(spent, ["qid", "final_k", "window"]).join(gold.select("qid", "category", "query"), "qid")
    return each.select("final_k", "window", "qid", "category", "query", "base", "new", change.alias("change"), "rerank_sec")


def rerank_summary(detail: DataFrame) -> DataFrame:
    """By reranker, final_k, window and category (and over all): n, hits and reciprocal ranks before and after, change counts; the
    mean seconds of re-ranking a question on the row over all."""
    keys, c, k = ("reranker", "final_k", "window"), F.col("change"), F.col("final_k")
    rate = lambda x: F.bround(F.avg(x.cast("double")), 3)
    out = detail.groupingSets([[F.col(x) for x in keys], [*(F.col(x) for x in keys), F.col("category")]], *[F.col(x) for x in keys], F.col("category")).agg(
        F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("n"),
        rate(rankmetrics.hit_at(F.col("base"), 1)).alias("baseline_top1"), rate(rankmetrics.hit_at(F.col("new"), 1)).alias("reranked_top1"),
        rate(rankmetrics.reciprocal_rank(F.col("base"), k)).alias("baseline_mrr"), rate(rankmetrics.reciprocal_rank(F.col("new"), k)).alias("reranked_mrr"),
        F.count_if(c.startswith("improved")).alias("n_improved"), F.count_if(c.startswith("worsened")).alias("n_worsened"),
        F.count_if(c == "same").alias("n_unchanged"), F.count_if(c == "stage1_miss").alias("n_stage1_miss"), F.bround(F.avg("rerank_sec"), 5).alias("_sec"),
    )
    name = F.when(F.col("_all") == 1, rankmetrics.OVERALL).otherwise(F.col("category")).alias("category")
    shown = [x for x in out.columns if x not in (*keys, "category", "_all", "_sec")]
    return out.select(*keys, name, *shown, F.when(F.col("_all") == 1, F.col("_sec")).alias("avg_rerank_latency_sec"))


def rerankers(spark: SparkSession, workbook: str, out: str, windows: list[tuple[int, int]], faq_sheet: str, query_sheets: dict[str, str], spec: ModelSpec = ModelSpec("hashed"), scorers: list[ModelSpec] | None = None, names: list[str] | None = None) -> DataFrame | None:
    """Cross-encoders over the first ranks of a dense search, for each (window, final k): summaries appended to out as one
    numbered run, a line for each question to ``<out>_log``."""
    faq, tests = _corpus_and_tests(spark, workbook, faq_sheet, query_sheets)
    timed = written(tests.select(F.col("test_id").alias("qid"), try_embed_column(F.col("query"), spec, "query").alias("e")), "timed")
    if bad := timed.where("e.error is not null").select("e.error").first():
        raise RuntimeError(bad[0])
    embed_sec = timed.agg(F.bround(F.avg("e.sec"), 5)).first()[0]
    passages = faq.select(F.col("pos").alias("cid"), F.col("faq_id").cast("string").alias("tag"), "question", embed_column(F.col("question"), spec).alias("vec"))
    start = datetime.datetime.now()
    passages = written(passages, "corpus")
    corpus_sec = round((datetime.datetime.now() - start).total_seconds(), 3)
    gold = tests.select(F.col("test_id").alias("qid"), "category", "query", "gt_ids")
    hits = retrieve.top_k(timed.select("qid", F.col("e.vec").alias("vec")), passages, max(w for w, _ in windows))
    hits = written(hits.join(passages.select("cid", "tag", "question"), "cid").join(gold.select("qid", "query"), "qid"), "hits")
    details: dict[str, DataFrame] = {}

    def evaluate(scorer: ModelSpec) -> DataFrame:
        scored = written(hits.withColumn("s", timed_score_column(F.col("query"), F.col("question"), scorer)).select("qid", "rank", "cid", "tag", F.col("s.score").alias("rerank_score"), F.col("s.sec").alias("sec")), "scored")
        details[scorer.name] = detail = written(rerank_detail(scored, gold, windows).withColumn("reranker", F.lit(scorer.name)), "detail")
        whole = F.col("category") == rankmetrics.OVERALL
        return rerank_summary(detail).withColumns({"avg_embed_latency_sec": F.when(whole, F.lit(embed_sec)), "faq_corpus_embed_time_sec": F.when(whole, F.lit(corpus_sec))})

    result = evaluate_models(select_models(scorers or [ModelSpec("lexical", "lexical")], names), evaluate)
    if result is not None:
        result = runlog.numbered(_log(spark, out), result)
        run, stamp = result.select("run", "timestamp").first()
        rank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
        for name in [r[0] for r in result.select("reranker").distinct().collect()]:
            rows = details[name].select("reranker", "final_k", "window", "change", "qid", "category", "query", rank("base"), rank("new"))
            runlog.detail_lines(rows, f"run {run} | {stamp} | %s, k %d of %d | [%s] %s (%s) %s -> %s | %s", "reranker", "final_k", "window", "change", "qid", "category", "base", "new", "query").write.mode("append").text(f"{out}_log")
        runlog.append_parquet(result, out)
    return result


def cluster_questions(spark: SparkSession, workbook: str, sheet: str, out: str, sizes: list[int], spec: ModelSpec = ModelSpec("hashed")) -> DataFrame:
    """HDBSCAN of a labelled sheet for each minimum cluster size: quality and counts by setting."""
    rows = sheets.read_xlsx(spark, workbook, sheet, 8, 1).where("c1 is not null").select("pos", F.col("c1").alias("question"), F.col("c2").alias("expected"))
    points = labels.topic_ids(rows).select("pos", "topic_id", embed_column(F.col("question"), spec).alias("vec")).persist()
    total = None
    for size in sizes:
        found = cluster.hdbscan(points.select(F.lit(size).alias("grp"), F.col("pos").alias("id"), "vec"), size)
        own = found.join(points.select(F.col("pos").alias("id"), "topic_id"), "id").withColumnRenamed("grp", "min_cluster_size")
        total = own if total is None else total.unionByName(own)
    by = ("min_cluster_size",)
    total = written(total, "clusters")
    result = cluster.cluster_quality(total, by=by).join(cluster.cluster_counts(total, by), [*by])
    result = runlog.numbered(_log(spark, out), result)
    run = result.first()["run"]
    members = cluster.cluster_listing(total, by).join(rows.select(F.col("pos").alias("id"), "question", "expected"), "id")
    runlog.append_parquet(members.withColumn("run", F.lit(run)), f"{out}_members")
    runlog.append_parquet(result, out)
    return result


def collect_scores(spark: SparkSession, questions: str, faqs: DataFrame, out: str, spec: ModelSpec = ModelSpec("hashed"), k: int = 10, alive: str | None = None, warn=print) -> DataFrame:
    """The inputs of the threshold analysis: candidates, sentences, faq_catalog, errors and meta under out; returns the candidates.

    faqs: faq_id, variant_id, intent, question, variant_question, answer, version; ``alive`` is a condition on rows that count.
    Each question gets its k best FAQs, an FAQ by its best variant, and a score for each sentence of their answers. A
    question whose embedding fails is listed in errors and the others go on. Snapshots are taken before and after.
    """
    asked = files.read_questions(spark, questions)
    if asked.isEmpty():
        raise ValueError(f"no questions: {questions}")
    living = faqs.where(alive) if alive else faqs
    started, before = datetime.datetime.now(), runlog.snapshot(living, "faq_id", "version").first()
    q = written(asked.select(F.col("id").alias("qid"), try_embed_column(F.col("question"), spec, "query").alias("e")), "questions")
    fine = q.where("e.error is null").select("qid", F.col("e.vec").alias("vec"))
    table = vector_table(living.withColumn("cid", F.struct("faq_id", "variant_id").cast("string")), "variant_question", spec, "faq_vectors")
    most = table.groupBy("faq_id").count().agg(F.max("count")).first()[0] or 1
    hits = retrieve.top_k(fine, table, k * most).join(table.drop("vec"), "cid")  # k * most hits hold the k best FAQs
    best = written(retrieve.best_variant(hits, "faq_id", k), "best")
    rows = best.select("qid", "rank", "faq_id", "variant_id", F.col("score").alias("similarity"), "intent", F.col("question").alias("faq_question"), "variant_question")
    files.write_csv(rows, f"{out}/candidates.csv", False, False)
    parts = F.filter(F.split("answer", r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x) != "")
    cut = best.select("qid", "faq_id", F.posexplode(parts).alias("sentence_idx", "sentence")).withColumn("sv", embed_column(F.col("sentence"), spec))
    sentences = cut.join(fine, "qid").select("qid", "faq_id", "sentence_idx", F.round(cosine(F.col("vec"), F.col("sv")), 6).alias("similarity"), "sentence")
    files.write_csv(sentences, f"{out}/sentences.csv", False, False)
    catalog = best.groupBy("faq_id").agg(*[F.min_by(c, "variant_id").alias(c) for c in ("intent", "question", "answer")])
    files.write_csv(catalog, f"{out}/faq_catalog.csv", False, False)
    errors = q.where("e.error is not null").select("qid", F.col("e.error").alias("error"))
    files.write_csv(errors, f"{out}/errors.csv", False)
    n, failed = q.count(), errors.count()
    after, ended = runlog.snapshot(living, "faq_id", "version").first(), datetime.datetime.now()
    meta = [f"started={started}", f"ended={ended}", f"seconds={(ended - started).total_seconds():.0f}", f"questions={questions}", f"n={n}, ok={n - failed}, failed={failed}", f"k={k}", f"model={spec.name}", f"backend={spec.backend}"]
    meta += [f"{w}: n={r['n']}, max_id={r['max_id']}, sum_version={r['sum_version']}" for w, r in (("before", before), ("after", after))]
    meta.append(f"changed={'no' if before == after else 'yes, collect again'}")
    files.write_lines(meta, spark, f"{out}/meta")
    if before != after:
        warn("the FAQs changed meanwhile")
    if failed:
        warn(f"{failed} questions failed")
    return rows


def pair_similarity(spark: SparkSession, text1: str, text2: str, spec: ModelSpec = ModelSpec("hashed")) -> float:
    df = spark.createDataFrame([(text1, text2)], "a string, b string")
    v = df.select(embed_column(F.col("a"), spec).alias("a"), embed_column(F.col("b"), spec).alias("b"))
    return v.select(strict_cosine(F.col("a"), F.col("b"))).first()[0]


def _triple(text: str) -> tuple[float, float, float]:
    lo, hi, step = (float(x) for x in text.split(":"))
    return lo, hi, step


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gleaner")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: _options(sub.add_parser(name), args)
    add("mergequestions", ("inputs", {"nargs": "+"}), ("--out", {"required": True}))
    add("labelsheet", ("--questions", {"required": True}), ("--data", {"required": True}), ("--out", {"required": True}), ("--seed", {"default": labels.SEED}))
    add("merge", ("--a", {"required": True}), ("--b", {"required": True}), ("--out", {"required": True}))
    add("sentencesheet", ("--labels", {"required": True}), ("--data", {"required": True}), ("--out", {"required": True}))
    common = (("--labels", {"required": True}), ("--data", {"required": True}), ("--out", {"required": True}), ("--sentence-labels", {}), ("--weights", {}), ("--prior", {"type": float, "default": 0.75}), ("--draws", {"type": int, "default": 1000}))
    add("dev", *common, ("--seed", {"type": int, "default": 20261019}), ("--t1", {"type": _triple, "default": (0.5, 0.9, 0.01)}), ("--t2", {"type": _triple, "default": (0.4, 0.9, 0.01)}), ("--fp-cap-conservative", {"type": float, "default": 0.05}), ("--fp-cap-responsive", {"type": float, "default": 0.15}))
    add("final", *common, ("--pairs", {"nargs": "*"}), ("--candidates-json", {}), ("--force-rerun", {"action": "store_true"}))
    add("similarity", ("text1", {}), ("text2", {}), ("--model", {"default": "hashed"}))
    book = (("--xlsx", {"required": True}), ("--faq-sheet", {"default": "FAQ"}), ("--query-sheet", {"action": "append", "required": True, "help": "sheet=category"}), ("--output", {"required": True}))
    add("intents", ("--corpus", {"default": "faq_intent_corpus.csv"}), ("--test-set", {"default": "intent_test_set.csv"}), ("--output-dir", {"default": "intent-analysis-output"}), ("--groups", {"required": True, "help": "JSON: intent code to group"}), ("--method-name", {}), ("--k", {"type": int, "default": 3}), ("--prefilter-n", {"type": int, "default": 50}), ("--embed-model", {"default": "hashed"}), ("--no-hybrid", {"action": "store_true"}), ("--hybrid-alpha", {"type": float, "default": 0.6}), ("--rerank", {"action": "store_true"}), ("--rerank-window", {"type": int, "default": 10}), ("--colbert", {"action": "store_true"}), ("--colbert-window", {"type": int, "default": 10}), ("--thresholds", {"default": "0.30:0.90:0.02"}))
    add("benchmark", *book, ("--models", {"type": _names}))
    add("rerank", *book, ("--top-k", {"type": _ints, "default": [3, 5, 10, 15, 20]}), ("--rerankers", {"type": _names}), ("--embed-model", {"default": "hashed"}))
    add("rerankbuffer", *book, ("--final-k", {"type": _ints, "default": [5, 10]}), ("--buffer", {"type": _ints, "default": [0, 5, 10, 15]}), ("--rerankers", {"type": _names}), ("--embed-model", {"default": "hashed"}))
    add("cluster", ("--xlsx", {"required": True}), ("--sheet", {"required": True}), ("--min-cluster-size", {"type": _ints, "default": [2, 3, 4, 5, 6]}), ("--output", {"required": True}), ("--embed-model", {"default": "hashed"}))
    add("collect", ("--questions", {"required": True}), ("--faqs", {"required": True, "help": "Parquet"}), ("--out", {"required": True}), ("--k", {"type": int, "default": 10}), ("--alive", {"help": "SQL condition on FAQs that count"}), ("--embed-model", {"default": "hashed"}))
    return top


def _ints(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _spec(name: str) -> ModelSpec:
    """A model of the registry, or the built-in one."""
    return select_models([ModelSpec("hashed"), *REGISTRY], [name])[0]


def _options(p: argparse.ArgumentParser, args: tuple) -> argparse.ArgumentParser:
    for name, more in args:
        p.add_argument(name, **more)
    return p


def main(argv: list[str] | None = None) -> None:
    a, spark = parser().parse_args(argv), _session()
    if a.command == "mergequestions":
        merge_questions(spark, a.inputs, a.out)
    elif a.command == "labelsheet":
        label_sheet(spark, a.questions, a.data, a.out, a.seed)
    elif a.command == "merge":
        merge_labels(spark, a.a, a.b, a.out)
    elif a.command == "sentencesheet":
        sentence_sheet(spark, a.labels, a.data, a.out)
    elif a.command == "dev":
        dev(spark, a.labels, a.data, a.out, a.sentence_labels, a.weights, a.prior, a.draws, a.seed, a.t1, a.t2, (a.fp_cap_conservative, a.fp_cap_responsive)).show()
    elif a.command == "final":
        if bool(a.pairs) == bool(a.candidates_json):
            raise SystemExit("give either --pairs or --candidates-json")
        pairs = [(float(x), float(y)) for x, y in (p.split(",") for p in a.pairs)] if a.pairs else None
        final(spark, a.labels, a.data, a.out, pairs, a.candidates_json, a.force_rerun, sentence_labels=a.sentence_labels, weights=a.weights, prior=a.prior, draws=a.draws).show()
    elif a.command == "intents":
        if a.rerank and a.colbert:
            raise SystemExit("give either --rerank or --colbert")
        alpha = None if a.no_hybrid else a.hybrid_alpha
        out = f"{a.output_dir}/{a.method_name or method_name(a.rerank, a.colbert, alpha)}"
        intent_analysis(spark, a.corpus, a.test_set, out, files.read_json(spark, a.groups), a.k, a.thresholds, _spec(a.embed_model), a.rerank, a.colbert_window if a.colbert else a.rerank_window, a.prefilter_n, alpha, a.colbert).show()
    elif a.command in ("benchmark", "rerank", "rerankbuffer"):
        own = (a.faq_sheet, dict(x.split("=", 1) for x in a.query_sheet))
        if a.command == "benchmark":
            found = model_benchmark(spark, a.xlsx, a.output, [ModelSpec("hashed"), *REGISTRY], *own, a.models)
        else:
            windows = [(k, k) for k in a.top_k] if a.command == "rerank" else [(k + n, k) for k in a.final_k for n in a.buffer]
            found = rerankers(spark, a.xlsx, a.output, windows, *own, spec=_spec(a.embed_model), names=a.rerankers)
        if found is None:
            raise SystemExit("no model ran")
        found.show(200, False)
    elif a.command == "cluster":
        cluster_questions(spark, a.xlsx, a.sheet, a.output, a.min_cluster_size, _spec(a.embed_model)).show()
    elif a.command == "collect":
        collect_scores(spark, a.questions, spark.read.parquet(a.faqs), a.out, _spec(a.embed_model), a.k, a.alive).show()
    else:
        print(pair_similarity(spark, a.text1, a.text2, _spec(a.model)))


if __name__ == "__main__":
    main()
