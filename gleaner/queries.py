"""The catalogue: each operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import lab
from gleaner.functions import text as tx
from gleaner.functions import vectors as vx
from gleaner.functions.models import ModelSpec, embed_column
from gleaner.operators import cluster, intents, labels, rankmetrics, retrieve, runlog, serving, thresholds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# pieces that the SQL texts share
_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_QC = _V + ", q AS (SELECT vec_id AS qid, label AS ql, e AS qe FROM v WHERE vec_id % 10 = 0), c AS (SELECT vec_id AS cid, label AS cl, e AS ce FROM v WHERE vec_id % 10 <> 0)"
_S = _QC + ", s AS (SELECT qid, cid, ql, cl, qe, ce, round(list_cosine_similarity(qe, ce), 6) AS score FROM q, c)"
_HITS = _S + ", hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM s)"
_FIRST = _HITS + ", f AS (SELECT qid, ql, min(CASE WHEN cl = ql THEN rank END) AS gt_rank, min(CASE WHEN cl = (ql + 1) % 10 THEN rank END) AS neg_rank FROM hits GROUP BY qid, ql)"
_METRICS = """count(*) AS n, avg(CAST(coalesce(gt_rank <= 1, false) AS DOUBLE)) AS top1, avg(CAST(coalesce(gt_rank <= 3, false) AS DOUBLE)) AS top3,
    avg(CAST(coalesce(gt_rank <= 5, false) AS DOUBLE)) AS top5, avg(CASE WHEN gt_rank IS NULL THEN 0 ELSE 1.0 / gt_rank END) AS mrr"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("__SEED__", labels.SEED)
        return f

    return add


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


# --- vectors and retrieval


@query(f"WITH {_HITS} SELECT qid, CAST(rank AS INTEGER) AS rank, cid, score FROM hits WHERE rank <= 3")
def vec_topk(spark, sf):
    return retrieve.top_k(*lab.queries_and_corpus(spark, sf), 3).select("qid", "rank", "cid", "score")


@query(f"WITH {_V} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def vec_cosine_strict(spark, sf):
    e = lab.table(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vx.strict_cosine(F.col("x"), F.col("y")), 6).alias("score"))


@query(f"WITH {_V} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e[1:48], b.e[1:48]) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e[1:48], b.e[1:48]))), 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def vec_cosine_lenient(spark, sf):
    e = lab.table(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.slice("embedding", 1, 48).alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vx.cosine(F.col("x"), F.col("y")), 6).alias("score"))


@query(f"WITH {_V}, n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v), u AS (SELECT vec_id, unnest(e) / n AS value, unnest(range(64)) AS dim FROM n) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM u")
def vec_l2norm(spark, sf):
    e = lab.table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(vx.l2_normalize(F.col("embedding"))).alias("dim", "value")).select("vec_id", "dim", *_r("value"))


@query(f"WITH {_HITS} SELECT qid, cid, score, CASE WHEN score > 0.8 THEN 'very similar' WHEN score > 0.5 THEN 'somewhat similar' ELSE 'low similarity' END AS band FROM hits WHERE rank <= 5")
def similarity_bands(spark, sf):
    hits = retrieve.top_k(*lab.queries_and_corpus(spark, sf), 5)
    return hits.select("qid", "cid", "score", vx.similarity_band(F.col("score")).alias("band"))


@query(f"WITH {_HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY qid, cl ORDER BY score DESC, cid) AS r FROM hits WHERE rank <= 30) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS INTEGER) AS rank, cl, cid, score FROM b WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) <= 3")
def best_variant(spark, sf):
    return retrieve.best_variant(lab.labelled_hits(spark, sf, 30), "cl", 3).select("qid", "rank", "cl", "cid", "score")


def _tokens(table: str, id_col: str, name: str) -> str:
    return f"""{name}_w AS (SELECT {id_col} AS id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM {table}),
    {name}_n AS (SELECT id, term, count(*) AS n FROM {name}_w WHERE term <> '' GROUP BY id, term),
    {name} AS (SELECT id, term, round(n / sum(n) OVER (PARTITION BY id), 9) AS weight FROM {name}_n)"""


@query(f"WITH {_tokens('benchmark', 'item_id', 'a')}, {_tokens('documents', 'doc_id', 'b')}, s AS (SELECT a.id AS qid, b.id AS cid, round(sum(a.weight * b.weight), 6) AS score FROM a JOIN b ON a.term = b.term GROUP BY a.id, b.id) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS INTEGER) AS rank, cid, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) <= 5")
def sparse_overlap(spark, sf):
    q = tx.token_table(lab.table(spark, sf, "benchmark").withColumnRenamed("item_id", "qid"), "qid", "text")
    c = tx.token_table(lab.table(spark, sf, "documents").withColumnRenamed("doc_id", "cid"), "cid", "text")
    return retrieve.sparse_top_k(q, c, 5).select("qid", "rank", "cid", "score")


@query(f"""WITH {_HITS}, {_tokens('documents', 'doc_id', 'w')}, p AS (SELECT * FROM hits WHERE rank <= 20),
    o AS (SELECT p.qid, p.cid, sum(x.weight * y.weight) AS lex FROM p JOIN w x ON x.id = p.qid JOIN w y ON y.id = p.cid AND x.term = y.term GROUP BY p.qid, p.cid),
    m AS (SELECT p.qid, p.cid, p.rank, round(0.6 * p.score + (1 - 0.6) * coalesce(lex, 0), 6) AS score FROM p LEFT JOIN o ON o.qid = p.qid AND o.cid = p.cid)
    SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS INTEGER) AS rank, cid, score FROM m""")
def hybrid_rank(spark, sf):
    hits = retrieve.top_k(*lab.queries_and_corpus(spark, sf), 20)
    met = hits.select(F.explode(F.array("qid", "cid")).alias("doc_id")).distinct()
    tokens = tx.token_table(lab.table(spark, sf, "documents").select("doc_id", "text").join(met, "doc_id", "left_semi"), "doc_id", "text")
    mixed = retrieve.lexical_overlap(hits, tokens.withColumnRenamed("doc_id", "qid"), tokens.withColumnRenamed("doc_id", "cid"))
    return retrieve.hybrid(mixed, F.col("score"), F.col("lexical")).select("qid", "rank", "cid", "score")


_LATE_HITS = _HITS + f""", p AS (SELECT * FROM hits WHERE rank <= 20),
    x AS (SELECT qid, cid, ql, cl, rank, i, max(list_cosine_similarity(qe[CAST(1 + 8 * i AS BIGINT) : CAST(8 + 8 * i AS BIGINT)], ce[CAST(1 + 8 * j AS BIGINT) : CAST(8 + 8 * j AS BIGINT)])) AS m FROM p, range(8) a(i), range(8) b(j) GROUP BY ALL),
    late AS (SELECT qid, cid, ql, cl, rank AS base_rank, round(avg(m), 6) AS late FROM x GROUP BY ALL)"""


@query(f"WITH {_LATE_HITS} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY late DESC, base_rank) AS INTEGER) AS rank, cid, late AS score FROM late WHERE base_rank <= 10 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY late DESC, base_rank) <= 3")
def maxsim_rerank(spark, sf):
    hits = lab.with_vectors(retrieve.top_k(*lab.queries_and_corpus(spark, sf), 10), spark, sf)
    return retrieve.rerank(hits, lab.late_score(), window=10, k=3).select("qid", "rank", "cid", "score")


# --- rank metrics


def _gold_ranks(spark, sf):
    """qid, ql, gt_rank (same label) and neg_rank (the next label) over the full ranking, by counting better rows."""
    q, c = lab.queries_and_corpus(spark, sf)
    targets = {"gt_rank": lambda x, y: x == y, "neg_rank": lambda x, y: (x + 1) % 10 == y}
    found = retrieve.first_ranks(q.withColumnRenamed("ql", "tag"), c.withColumnRenamed("cl", "tag"), targets)
    return found.join(q.select("qid", "ql"), "qid")


@query(f"WITH {_FIRST} SELECT CAST(qid AS BIGINT) AS qid, CAST(gt_rank AS INTEGER) AS gt_rank, CASE WHEN gt_rank IS NULL THEN 0 ELSE round(1.0 / gt_rank, 6) END AS rr, coalesce(gt_rank <= 1, false) AS top1, coalesce(gt_rank <= 3, false) AS top3, coalesce(gt_rank <= 5, false) AS top5 FROM f")
def rank_metrics(spark, sf):
    return rankmetrics.add_metrics(_gold_ranks(spark, sf)).select("qid", "gt_rank", *_r("rr"), "top1", "top3", "top5")


@query(f"WITH {_FIRST}, g AS (SELECT coalesce(CAST(ql AS VARCHAR), '-') AS category, gt_rank FROM f) SELECT 'cosine' AS model, coalesce(category, '전체') AS category, n, round(top1, 6) AS top1, round(top3, 6) AS top3, round(top5, 6) AS top5, round(mrr, 6) AS mrr FROM (SELECT category, {_METRICS} FROM g GROUP BY GROUPING SETS ((), (category)))")
def rank_metrics_by_label(spark, sf):
    detail = rankmetrics.add_metrics(_gold_ranks(spark, sf)).select(F.lit("cosine").alias("model"), F.col("ql").cast("string").alias("category"), "top1", "top3", "top5", "rr")
    out = rankmetrics.summarize(detail, digits=None)
    return out.select("model", "category", "n", *_r("top1", "top3", "top5", "mrr"))


@query(f"WITH {_S}, t AS (SELECT qid, cid, score FROM s WHERE cl = ql AND cid % 5 = 1), b AS (SELECT qid, score, cid FROM t QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) = 1) SELECT b.qid, CAST(1 + count(s.cid) AS INTEGER) AS target_rank FROM b LEFT JOIN s ON s.qid = b.qid AND (s.score > b.score OR (s.score = b.score AND s.cid < b.cid)) GROUP BY b.qid")
def first_rank_by_count(spark, sf):
    q, c = lab.queries_and_corpus(spark, sf)
    wanted = c.withColumn("tag", F.when(F.col("cid") % 5 == 1, F.col("cl")).otherwise(-1))
    found = retrieve.first_ranks(q.withColumnRenamed("ql", "tag"), wanted, {"target_rank": lambda x, y: x == y})
    return found.where("target_rank is not null")


@query(f"WITH {_FIRST} SELECT qid, CAST(gt_rank AS INTEGER) AS gt_rank, CAST(neg_rank AS INTEGER) AS neg_rank, (ql % 3 = 0) OR (gt_rank IS NOT NULL AND (neg_rank IS NULL OR gt_rank < neg_rank)) AS hard_neg_pass FROM f")
def hard_negative(spark, sf):
    r = _gold_ranks(spark, sf)
    return r.select("qid", "gt_rank", "neg_rank", rankmetrics.hard_negative_pass(F.col("gt_rank"), F.col("neg_rank"), F.col("ql") % 3 != 0).alias("hard_neg_pass"))


@query(f"WITH {_FIRST}, k AS (SELECT unnest([1, 3, 5, 10]) AS k) SELECT CAST(k AS INTEGER) AS k, round(avg(CAST(coalesce(gt_rank <= k, false) AS DOUBLE)), 6) AS hit, round(avg(CASE WHEN gt_rank <= k THEN 1.0 / gt_rank ELSE 0 END), 6) AS mrr FROM f, k GROUP BY k")
def hit_at_k_grid(spark, sf):
    ks = spark.createDataFrame([(1,), (3,), (5,), (10,)], "k int")
    each = _gold_ranks(spark, sf).join(F.broadcast(ks))
    r, k = F.col("gt_rank"), F.col("k")
    return each.groupBy("k").agg(F.round(F.avg(rankmetrics.hit_at(r, k).cast("double")), 6).alias("hit"), F.round(F.avg(rankmetrics.reciprocal_rank(r, k)), 6).alias("mrr"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def p95_nearest_rank(spark, sf):
    return lab.table(spark, sf, "events").groupBy("event_type").agg(rankmetrics.p95("value").alias("p95"))


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type AS model, round(avg(value), 6) AS avg_latency, round(1 / avg(value), 6) AS throughput, quantile_disc(value, 0.95) AS p95_latency FROM w WHERE r > 1 OR n = 1 GROUP BY event_type""")
def warm_latency(spark, sf):
    calls = lab.table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("call"), F.col("value").alias("latency"))
    return rankmetrics.warm_latency(calls).select("model", *_r("avg_latency", "throughput"), "p95_latency")


_CHANGE = f"""WITH {_LATE_HITS}, fr AS (SELECT qid, min(CASE WHEN cl = ql THEN rank END) AS base FROM hits GROUP BY qid), """


@query(_CHANGE + """g AS (SELECT unnest([3, 5, 10, 15, 20]) AS k), r AS (SELECT g.k, qid, ql, cl, row_number() OVER (PARTITION BY g.k, qid ORDER BY late DESC, base_rank) AS rank FROM late, g WHERE base_rank <= g.k),
    n AS (SELECT k, qid, min(CASE WHEN cl = ql THEN rank END) AS new FROM r GROUP BY k, qid),
    ch AS (SELECT n.k, CASE WHEN base IS NULL OR base > n.k THEN 'stage1_miss' WHEN new IS NULL THEN 'error' WHEN new < base THEN 'improved' WHEN new > base THEN 'worsened' ELSE 'same' END AS change FROM n JOIN fr USING (qid))
    SELECT CAST(k AS INTEGER) AS top_k, count(*) FILTER (change = 'improved') AS n_improved, count(*) FILTER (change = 'worsened') AS n_worsened, count(*) FILTER (change = 'same') AS n_unchanged, count(*) FILTER (change = 'stage1_miss') AS n_stage1_miss FROM ch GROUP BY k""")
def rerank_change_topk(spark, sf):
    base = _gold_ranks(spark, sf).select("qid", F.col("gt_rank").alias("base"))
    hits = lab.with_vectors(lab.labelled_hits(spark, sf, 20), spark, sf)
    swept = retrieve.rerank_sweep(hits, lab.late_score(), [(k, k) for k in (3, 5, 10, 15, 20)])
    new = swept.groupBy("qid", "final_k").agg(F.min(F.when(F.col("cl") == F.col("ql"), F.col("rank"))).alias("new"))
    detail = new.join(base, "qid").withColumn("change", rankmetrics.change_class(F.col("base"), F.col("new"), F.col("final_k")))
    return rankmetrics.change_counts(detail.withColumnRenamed("final_k", "top_k"), ["top_k"])


@query(_CHANGE + """g AS (SELECT f AS final_k, b AS buffer, f + b AS w FROM (SELECT unnest([5, 10]) AS f), (SELECT unnest([0, 5, 10]) AS b)),
    r AS (SELECT g.final_k, g.w, qid, ql, cl, row_number() OVER (PARTITION BY g.final_k, g.w, qid ORDER BY late DESC, base_rank) AS rank FROM late, g WHERE base_rank <= g.w),
    n AS (SELECT final_k, w, qid, min(CASE WHEN cl = ql AND rank <= final_k THEN rank END) AS new FROM r GROUP BY final_k, w, qid),
    ch AS (SELECT n.final_k, n.w, CASE WHEN base IS NULL OR base > n.w THEN 'stage1_miss' WHEN base <= final_k AND NOT coalesce(new <= final_k, false) THEN 'worsened' WHEN base > final_k AND coalesce(new <= final_k, false) THEN 'improved'
        WHEN base <= final_k AND new < base THEN 'improved' WHEN base <= final_k AND new > base THEN 'worsened' ELSE 'same' END AS change FROM n JOIN fr USING (qid))
    SELECT CAST(final_k AS INTEGER) AS final_k, CAST(w AS INTEGER) AS rerank_window, count(*) FILTER (change = 'improved') AS n_improved, count(*) FILTER (change = 'worsened') AS n_worsened, count(*) FILTER (change = 'same') AS n_unchanged, count(*) FILTER (change = 'stage1_miss') AS n_stage1_miss FROM ch GROUP BY final_k, w""")
def rerank_change_buffer(spark, sf):
    base = _gold_ranks(spark, sf).select("qid", F.col("gt_rank").alias("base"))
    hits = lab.with_vectors(lab.labelled_hits(spark, sf, 20), spark, sf)
    swept = retrieve.rerank_sweep(hits, lab.late_score(), [(f + b, f) for f in (5, 10) for b in (0, 5, 10)])
    new = swept.groupBy("qid", "final_k", "window").agg(F.min(F.when(F.col("cl") == F.col("ql"), F.col("rank"))).alias("new"))
    change = rankmetrics.change_class_buffer(F.col("base"), F.col("new"), F.col("final_k"), F.col("window"))
    return rankmetrics.change_counts(new.join(base, "qid").withColumn("change", change).withColumnRenamed("window", "rerank_window"), ["final_k", "rerank_window"])


@query(f"WITH {_FIRST} SELECT 'cosine' AS model, " + ", ".join(f"coalesce(CAST(round(avg(CAST(gt_rank <= 1 AS DOUBLE)) FILTER (ql = {k}), 4) AS VARCHAR), '-') AS c{k}" for k in range(10)) + " FROM f")
def pivot_categories(spark, sf):
    per = _gold_ranks(spark, sf).groupBy(F.lit("cosine").alias("model"), F.concat(F.lit("c"), F.col("ql")).alias("category")).agg(F.round(F.avg((F.col("gt_rank") <= 1).cast("double")), 4).alias("top1"))
    return rankmetrics.pivot_categories(per, values=[f"c{k}" for k in range(10)])


# --- intents

_CASES = _HITS.replace("FROM q, c)", "FROM q, c WHERE cl <= 2)") + """, cases AS (SELECT qid, CASE WHEN ql <= 2 THEN ['I' || ql] WHEN ql = 3 THEN ['I0', 'I1'] ELSE [] END AS intents FROM q),
    best AS (SELECT qid, 'I' || cl AS intent, max(score) AS score FROM hits WHERE rank <= 3 GROUP BY qid, cl), th AS (SELECT round(0.1 + i * 0.02, 6) AS t FROM range(21) r(i)),
    sv AS (SELECT c.qid, c.intents, th.t, list_filter([b0, b1, b2], lambda x: x IS NOT NULL) AS predicted FROM (SELECT cases.*, th.t, (SELECT intent FROM best b WHERE b.qid = cases.qid AND b.intent = 'I0' AND b.score >= th.t) AS b0, (SELECT intent FROM best b WHERE b.qid = cases.qid AND b.intent = 'I1' AND b.score >= th.t) AS b1,
        (SELECT intent FROM best b WHERE b.qid = cases.qid AND b.intent = 'I2' AND b.score >= th.t) AS b2 FROM cases, th) c JOIN th ON th.t = c.t),
    sweep AS (SELECT t, intent, count(*) AS n, count(*) FILTER (ok) AS n_ok, avg(CAST(ok AS DOUBLE)) AS rate FROM (SELECT t, i AS intent, list_contains(predicted, i) AS ok FROM (SELECT t, predicted, unnest(intents) AS i FROM sv WHERE len(intents) > 0)
        UNION ALL SELECT t, NULL, len(predicted) = 0 FROM sv WHERE len(intents) = 0) GROUP BY t, intent)"""


def _intent_inputs(spark, sf):
    q, c = lab.queries_and_corpus(spark, sf)
    hits = retrieve.top_k(q, c.where("cl <= 2"), 3).join(c.select("cid", F.concat(F.lit("I"), F.col("cl")).alias("intent")), "cid").select("qid", "rank", "intent", "score")
    one = F.array(F.concat(F.lit("I"), F.col("ql")))
    cases = q.select("qid", F.when(F.col("ql") <= 2, one).when(F.col("ql") == 3, F.array(F.lit("I0"), F.lit("I1"))).otherwise(F.array().cast("array<string>")).alias("intents"))
    return cases, hits, intents.survivors(cases, hits, intents.threshold_range(spark, 0.1, 0.5, 0.02))


@query(f"WITH {_CASES} SELECT t, coalesce(intent, '-') AS intent, n, n_ok, round(rate, 6) AS rate FROM sweep")
def intent_recall_sweep(spark, sf):
    out = intents.recall_sweep(_intent_inputs(spark, sf)[2])
    return out.select("t", F.coalesce("intent", F.lit("-")).alias("intent"), "n", "n_ok", *_r("rate"))


@query(f"WITH {_CASES} SELECT t, round(min(rate) FILTER (intent IS NOT NULL), 6) AS bottleneck, round(max(rate) FILTER (intent IS NULL), 6) AS irrelevant FROM sweep GROUP BY t")
def bottleneck_recall(spark, sf):
    return intents.bottleneck(intents.recall_sweep(_intent_inputs(spark, sf)[2])).select("t", *_r("bottleneck", "irrelevant"))


@query(f"WITH {_CASES}, b AS (SELECT t, min(rate) FILTER (intent IS NOT NULL) AS bottleneck, max(rate) FILTER (intent IS NULL) AS irrelevant FROM sweep GROUP BY t) SELECT min(t) AS t, round(arg_min(bottleneck, t), 6) AS bottleneck FROM b WHERE irrelevant = 1")
def bottleneck_threshold(spark, sf):
    found = intents.lowest_safe_threshold(intents.bottleneck(intents.recall_sweep(_intent_inputs(spark, sf)[2])))
    return found.select("t", *_r("bottleneck"))


@query(f"WITH {_CASES} SELECT x.t, x.qid, x.intent, b.score AS best_score, CASE WHEN b.score IS NULL THEN 'no candidate' ELSE 'below threshold' END AS reason FROM (SELECT t, qid, unnest(list_filter(intents, lambda i: NOT list_contains(predicted, i))) AS intent FROM sv) x LEFT JOIN best b ON b.qid = x.qid AND b.intent = x.intent")
def recall_failures(spark, sf):
    _, hits, survived = _intent_inputs(spark, sf)
    return intents.recall_failures(survived, hits)


@query(f"WITH {_CASES} SELECT t, qid, array_to_string(predicted, '+') AS predicted FROM sv WHERE len(intents) = 0 AND len(predicted) > 0")
def irrelevant_failures(spark, sf):
    return intents.irrelevant_failures(_intent_inputs(spark, sf)[2])


@query(f"WITH {_CASES} SELECT c.qid, CASE WHEN len(intents) = 0 THEN '무관' ELSE array_to_string(intents, '+') END AS expected, CAST(h.rank AS INTEGER) AS rank, 'I' || cl AS intent, score FROM cases c LEFT JOIN hits h ON h.qid = c.qid AND h.rank <= 3")
def intent_candidates(spark, sf):
    cases, hits, _ = _intent_inputs(spark, sf)
    return intents.candidate_details(cases, hits)


@query("""WITH p AS (SELECT conv_id, turn, role || '+' || ' ' || CASE WHEN turn % 2 = 0 THEN role ELSE 'extra' END || '+' AS c FROM conversations)
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(c, '+'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS intents FROM p""")
def parse_intents(spark, sf):
    c = lab.table(spark, sf, "conversations")
    raw = F.concat("role", F.lit("+ "), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("extra"), F.lit("+"))
    return c.select("conv_id", "turn", F.array_join(tx.split_intents(raw), "|").alias("intents"))


# --- two thresholds

_LABELS = """, lb AS (SELECT qid, ql, CASE WHEN ql <= 6 THEN 1 WHEN ql <= 8 THEN 0 ELSE -1 END AS kind, 'G' || (ql % 4) AS grp, CASE WHEN ql <= 6 THEN 'ANSWER' WHEN ql <= 8 THEN 'NO_ANSWER' ELSE 'BORDER' END AS final_label FROM q),
    sp AS (SELECT *, CASE WHEN row_number() OVER w <= round_even(0.6 * count(*) OVER (PARTITION BY grp, final_label), 0) THEN 'dev' ELSE 'test' END AS split FROM lb WINDOW w AS (PARTITION BY grp, final_label ORDER BY sha1('__SEED__:' || qid), qid))"""
_GOLD = """, gold AS (SELECT q.qid, c.cid FROM q JOIN c ON ql = cl AND cid % 3 = (qid // 10) % 3)"""
_SENT = """, cand AS (SELECT qid, cid, rank, score, qe, ce FROM hits WHERE rank <= 10),
    sent AS (SELECT qid, cid, rank, score, i AS idx, round(list_cosine_similarity(qe[CAST(1 + 16 * i AS BIGINT) : CAST(16 + 16 * i AS BIGINT)], ce[CAST(1 + 16 * i AS BIGINT) : CAST(16 + 16 * i AS BIGINT)]), 6) AS sim, (cid + i) % 3 = 0 AS need FROM cand, range(4) r(i))"""
_DATA = _HITS + _LABELS + _GOLD + _SENT + """, agg AS (SELECT qid, cid, max(sim) AS max_s, min(sim) FILTER (need) AS need_min FROM sent GROUP BY qid, cid),
    fact AS (SELECT cand.qid, min(rank) FILTER (gold.cid IS NOT NULL AND lb.kind = 1) AS gr, arg_min(score, rank) AS top1 FROM cand JOIN lb ON lb.qid = cand.qid LEFT JOIN gold ON gold.qid = cand.qid AND gold.cid = cand.cid GROUP BY cand.qid),
    ds AS (SELECT sp.qid, sp.kind, sp.grp, sp.split, coalesce(gr, 99) AS gold_rank, top1 AS top1_sim, k.rank, cand.score AS sim, agg.max_s, CASE WHEN gold.cid IS NOT NULL AND sp.kind = 1 THEN need_min END AS req_min, coalesce(gold.cid IS NOT NULL AND sp.kind = 1, false) AS is_gold
        FROM sp, (SELECT unnest([1, 2, 3]) AS rank) k LEFT JOIN fact ON fact.qid = sp.qid LEFT JOIN cand ON cand.qid = sp.qid AND cand.rank = k.rank LEFT JOIN agg ON agg.qid = cand.qid AND agg.cid = cand.cid LEFT JOIN gold ON gold.qid = cand.qid AND gold.cid = cand.cid)"""
_GRID = """, g AS (SELECT round(0.2 + i * 0.02, 4) AS t1, round(0.2 + j * 0.05, 4) AS t2 FROM range(11) a(i), range(9) b(j)),
    ok AS (SELECT ds.qid, ds.kind, ds.grp, ds.split, g.t1, g.t2, count(*) FILTER (sim >= t1 AND max_s >= t2) AS n, bool_or(coalesce(sim >= t1 AND max_s >= t2 AND is_gold, false)) AS gd, bool_or(coalesce(sim >= t1 AND max_s >= t2 AND is_gold AND coalesce(req_min >= t2, true), false)) AS cm FROM ds, g GROUP BY ALL),
    oc AS (SELECT *, CASE WHEN kind = -1 THEN -1 WHEN kind = 1 THEN CASE WHEN n = 0 THEN 3 WHEN NOT gd THEN 2 WHEN cm THEN 0 ELSE 1 END ELSE CASE WHEN n > 0 THEN 5 ELSE 4 END END AS cat FROM ok),
    gl AS (SELECT t1, t2, avg([0, 2, 5, 1, 0, 5][cat + 1]) FILTER (kind = 1) AS loss_a, avg(CAST(cat = 0 AS DOUBLE)) FILTER (kind = 1) AS correct, avg(CAST(cat = 1 AS DOUBLE)) FILTER (kind = 1) AS incomplete, avg(CAST(cat = 2 AS DOUBLE)) FILTER (kind = 1) AS wrong,
        avg(CAST(cat = 3 AS DOUBLE)) FILTER (kind = 1) AS noans, avg([0, 2, 5, 1, 0, 5][cat + 1]) FILTER (kind = 0) AS loss_u, avg(CAST(cat = 5 AS DOUBLE)) FILTER (kind = 0) AS false_pass FROM oc WHERE kind <> -1 GROUP BY t1, t2),
    gg AS (SELECT *, 0.75 * loss_a + 0.25 * loss_u AS loss, dense_rank() OVER (ORDER BY t1) AS i, dense_rank() OVER (ORDER BY t2) AS j FROM gl),
    sm AS (SELECT a.t1, a.t2, a.i, a.j, sum(b.loss) / 9 AS sm_loss, sum(b.false_pass) / 9 AS sm_false_pass, sum(b.noans) / 9 AS sm_noans FROM gg a, range(-1, 2) x(di), range(-1, 2) y(dj) JOIN gg b ON b.i = greatest(1, least(11, a.i + di)) AND b.j = greatest(1, least(9, a.j + dj)) GROUP BY ALL)"""
_LOSSES = ("loss_a", "correct", "incomplete", "wrong", "noans", "loss_u", "false_pass", "loss")


def _dataset(spark, sf):
    sent = lab.sentences(spark, sf)
    return thresholds.build_dataset(lab.questions(spark, sf), lab.candidates(spark, sf), sent, lab.sentence_labels(sent))


def _grid(spark):
    return thresholds.grid_values(spark, 0.2, 0.4, 0.02, "t1"), thresholds.grid_values(spark, 0.2, 0.6, 0.05, "t2")


@query(f"WITH {_QC + _LABELS} SELECT qid, grp AS \"group\", final_label, split FROM sp")
def split_dev_test(spark, sf):
    return lab.questions(spark, sf).select("qid", "group", "final_label", "split")


@query("""WITH lb AS (SELECT doc_id, lang, CAST(quality AS VARCHAR) AS final_label FROM labels JOIN documents USING (doc_id))
    SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang, final_label ORDER BY sha1('__SEED__:' || doc_id), doc_id) <= round_even(0.6 * count(*) OVER (PARTITION BY lang, final_label), 0) THEN 'dev' ELSE 'test' END AS split FROM lb""")
def split_documents(spark, sf):
    d = lab.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("final_label")).join(lab.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return labels.split_dev_test(d, strata=("lang", "final_label"), id_col="doc_id").select("doc_id", "split")


@query(f"WITH {_DATA} SELECT qid, kind, grp AS \"group\", split, CAST(gold_rank AS INTEGER) AS gold_rank, top1_sim, CAST(rank AS INTEGER) AS rank, sim, max_s, req_min, is_gold FROM ds")
def dataset_build(spark, sf):
    return _dataset(spark, sf).select("qid", "kind", "group", "split", "gold_rank", "top1_sim", "rank", "sim", "max_s", "req_min", "is_gold")


@query(f"WITH {_DATA + _GRID} SELECT qid, t1, t2, CAST(cat AS INTEGER) AS cat, CAST(n AS INTEGER) AS n_passed FROM oc")
def simulate_grid(spark, sf):
    return thresholds.outcomes(_dataset(spark, sf), thresholds.grid(*_grid(spark))).select("qid", "t1", "t2", "cat", "n_passed")


@query(f"WITH {_DATA + _GRID} SELECT t1, t2, " + ", ".join(f"round({m}, 6) AS {m}" for m in _LOSSES) + " FROM gg")
def grid_loss(spark, sf):
    return thresholds.grid_loss(_dataset(spark, sf), *_grid(spark)).select("t1", "t2", *_r(*_LOSSES))


@query(f"WITH {_DATA + _GRID} SELECT t1, t2, round(sm_loss, 6) AS sm_loss, round(sm_false_pass, 6) AS sm_false_pass, round(sm_noans, 6) AS sm_noans FROM sm")
def grid_smooth(spark, sf):
    cells = thresholds.grid_loss(_dataset(spark, sf), *_grid(spark))
    return thresholds.smooth(cells, ["loss", "false_pass", "noans"]).select("t1", "t2", *_r("sm_loss", "sm_false_pass", "sm_noans"))


@query(f"""WITH {_DATA + _GRID}, r AS (SELECT t1, t2, i, j, round(sm_loss, 12) AS l, round(sm_false_pass, 12) AS fp, round(sm_noans + 1e-6 * sm_loss, 12) AS na, sm_false_pass FROM sm)
    SELECT 'balanced' AS profile, t1, t2 FROM (SELECT * FROM r ORDER BY l, i, j LIMIT 1)
    UNION ALL SELECT 'conservative', t1, t2 FROM (SELECT * FROM r ORDER BY CASE WHEN sm_false_pass <= 0.05 THEN 0 ELSE 1 END, CASE WHEN sm_false_pass <= 0.05 THEN l ELSE fp END, i, j LIMIT 1)
    UNION ALL SELECT 'responsive', t1, t2 FROM (SELECT * FROM r ORDER BY CASE WHEN sm_false_pass <= 0.15 THEN 0 ELSE 1 END, CASE WHEN sm_false_pass <= 0.15 THEN na ELSE fp END, i, j LIMIT 1)""")
def pick_candidates(spark, sf):
    cells = thresholds.grid_loss(_dataset(spark, sf), *_grid(spark))
    return thresholds.pick_candidates(thresholds.smooth(cells, ["loss", "false_pass", "noans"]), balanced="sm_loss")


@query(f"""WITH {_DATA}, t AS (SELECT round(0.2 + i * 0.02, 4) AS t1 FROM range(11) a(i)), w AS (SELECT qid, kind, max(sim) FILTER (is_gold) AS gs, max(sim) FILTER (rank = 1) AS f, bool_or(is_gold) FILTER (rank = 1) AS fg FROM ds GROUP BY qid, kind)
    SELECT t1, round(avg(CAST(coalesce(gs >= t1, false) AS DOUBLE)) FILTER (kind = 1), 6) AS gold_top3, round(avg(CAST(coalesce(fg AND f >= t1, false) AS DOUBLE)) FILTER (kind = 1), 6) AS gold_top1, round(avg(CAST(coalesce(NOT fg AND f >= t1, false) AS DOUBLE)) FILTER (kind = 1), 6) AS wrong_top1,
        round(avg(CAST(coalesce(f >= t1, false) AS DOUBLE)) FILTER (kind = 0), 6) AS any_pass_unanswerable, round(avg(CAST(coalesce(f < t1, true) AS DOUBLE)) FILTER (kind <> -1), 6) AS below FROM w, t GROUP BY t1""")
def t1_view(spark, sf):
    return thresholds.t1_view(_dataset(spark, sf), _grid(spark)[0]).select("t1", *_r("gold_top3", "gold_top1", "wrong_top1", "any_pass_unanswerable", "below"))


@query(f"""WITH {_HITS + _LABELS + _GOLD + _SENT}, gs AS (SELECT sent.* FROM sent JOIN gold ON gold.qid = sent.qid AND gold.cid = sent.cid JOIN lb ON lb.qid = sent.qid WHERE kind = 1), t AS (SELECT round(0.2 + j * 0.05, 4) AS t2 FROM range(9) b(j)), m AS (SELECT qid, cid, min(sim) AS m FROM gs WHERE need GROUP BY qid, cid)
    SELECT a.*, round(b.all_kept, 6) AS all_kept FROM (SELECT t2, round(avg(CAST(sim >= t2 AS DOUBLE)) FILTER (need), 6) AS needed_kept, round(avg(CAST(sim >= t2 AS DOUBLE)) FILTER (NOT need), 6) AS other_kept, round(avg(CAST(need AS DOUBLE)) FILTER (sim >= t2), 6) AS precision FROM gs, t GROUP BY t2) a
    LEFT JOIN (SELECT t2, avg(CAST(m >= t2 AS DOUBLE)) AS all_kept FROM m, t GROUP BY t2) b ON a.t2 = b.t2""")
def t2_view(spark, sf):
    sent = lab.sentences(spark, sf)
    rows = thresholds.gold_sentences(lab.questions(spark, sf), sent, lab.sentence_labels(sent))
    return thresholds.t2_view(rows, _grid(spark)[1]).select("t2", *_r("needed_kept", "other_kept", "precision", "all_kept"))


@query(f"WITH {_DATA + _GRID} SELECT t1, t2, round(avg(CAST(n > 0 AS DOUBLE)), 6) AS rate FROM ok WHERE kind = -1 GROUP BY t1, t2")
def border_report(spark, sf):
    return thresholds.border_report(_dataset(spark, sf), thresholds.grid(*_grid(spark))).select("t1", "t2", *_r("rate"))


@query(f"WITH {_DATA + _GRID} SELECT t1, t2, grp AS \"group\", count(*) FILTER (n > 0) AS passed, count(*) AS total FROM ok WHERE kind = 0 GROUP BY t1, t2, grp")
def group_false_pass(spark, sf):
    return thresholds.group_false_pass(_dataset(spark, sf), thresholds.grid(*_grid(spark)))


@query(f"WITH {_DATA} SELECT round(avg(CAST(gold_rank > 3 AS DOUBLE)), 6) AS beyond_3, round(avg(CAST(gold_rank > 10 AS DOUBLE)), 6) AS beyond_10, count(*) AS n FROM ds WHERE kind = 1 AND rank = 1")
def gold_rank_limits(spark, sf):
    return thresholds.gold_rank_limits(_dataset(spark, sf)).select(*_r("beyond_3", "beyond_10"), "n")


@query(f"""WITH {_DATA}, x AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS at, CAST(gold_rank <= 3 AS DOUBLE) AS v FROM ds WHERE kind = 1 AND rank = 1), n AS (SELECT count(*) AS n FROM x),
    p AS (SELECT d, CAST('0x' || substr(md5('boot:' || d || ':' || p), 1, 8) AS BIGINT) % n.n AS at FROM n, range(100) a(d), range(1000000) b(p) WHERE p < n.n), m AS (SELECT d, avg(v) AS mean FROM p JOIN x ON x.at = p.at GROUP BY d)
    SELECT round(quantile_cont(mean, 0.05), 6) AS lo, round(quantile_cont(mean, 0.9), 6) AS p90, round(quantile_cont(mean, 0.95), 6) AS hi FROM m""")
def bootstrap_ci(spark, sf):
    rows = _dataset(spark, sf).where("kind = 1 and rank = 1").select("qid", (F.col("gold_rank") <= 3).cast("double").alias("v"))
    return thresholds.interval(thresholds.rank_bootstrap(rows, "v", 100)).select(*_r("lo", "p90", "hi"))


@query()
def loss_intervals(spark, sf):
    return thresholds.loss_intervals(_dataset(spark, sf), thresholds.grid(*_grid(spark)), draws=200)


@query()
def final_scores(spark, sf):
    pairs = spark.createDataFrame([(0.3, 0.35), (0.34, 0.4)], "t1 double, t2 double")
    return thresholds.final_scores(_dataset(spark, sf), pairs, draws=200)


@query(f"WITH {_HITS} SELECT CAST(least(40, floor((score - 0.0) / 0.025) + 1) AS BIGINT) AS bin, count(*) AS n FROM hits WHERE rank = 1 AND score BETWEEN 0 AND 1 GROUP BY 1")
def score_histogram(spark, sf):
    top = retrieve.top_k(*lab.queries_and_corpus(spark, sf), 1)
    return thresholds.histogram(top, "score", 0.0, 1.0)


# --- labels


@query("""WITH a AS (SELECT 0 AS f, conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT 1, conv_id, turn, text FROM conversations WHERE role <> 'user'),
    k AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(text), '\\s+', '', 'g') ORDER BY f, conv_id, turn) AS r FROM a WHERE trim(text) <> '')
    SELECT printf('Q%04d', row_number() OVER (ORDER BY f, conv_id, turn)) AS id, CASE f WHEN 0 THEN 'user' ELSE 'other' END AS source, conv_id, turn FROM k WHERE r = 1""")
def merge_questions(spark, sf):
    c = lab.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"))
    merged = labels.merge_questions([("user", c.where("role = 'user'")), ("other", c.where("role <> 'user'"))], order=("_file", "conv_id", "turn"))
    return merged.select("id", F.col("_source").alias("source"), "conv_id", "turn")


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def group_sizes(spark, sf):
    return lab.table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, 'role=' || role AS problem FROM conversations WHERE role NOT IN ('user', 'assistant')")
def enum_violations(spark, sf):
    return labels.violations(lab.table(spark, sf, "conversations"), {"role": ("user", "assistant")}).select("conv_id", "turn", "problem")


@query("""WITH t AS (SELECT quality AS a, 1 - toxic AS b FROM labels), n AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po FROM t), p AS (SELECT sum(x.c * y.c) AS s FROM (SELECT a, count(*) AS c FROM t GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM t GROUP BY b) y ON x.a = y.b)
    SELECT n, round(po, 6) AS agreement, round(CASE WHEN s / (n * CAST(n AS DOUBLE)) = 1 THEN NULL ELSE (po - s / (n * CAST(n AS DOUBLE))) / (1 - s / (n * CAST(n AS DOUBLE))) END, 6) AS kappa FROM n, p""")
def label_kappa(spark, sf):
    t = lab.table(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return labels.agreement(t, "a", "b").select("n", *_r("agreement", "kappa"))


_SIDES = """WITH s AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'ANSWER' ELSE 'NO_ANSWER' END AS label_a, CASE WHEN quality = 1 THEN (doc_id % 7) || ';' || (doc_id % 5) ELSE '' END AS gold_a,
        CASE WHEN toxic = 0 THEN 'ANSWER' ELSE 'NO_ANSWER' END AS label_b, CASE WHEN toxic = 0 THEN (doc_id % 5) || ', ' || (doc_id % 3) ELSE '' END AS gold_b FROM labels),
    l AS (SELECT *, list_filter([trim(x) FOR x IN regexp_split_to_array(gold_a, '[;,]')], lambda x: x <> '') AS ga, list_filter([trim(x) FOR x IN regexp_split_to_array(gold_b, '[;,]')], lambda x: x <> '') AS gb FROM s),
    m AS (SELECT *, label_a = label_b AND (label_a <> 'ANSWER' OR list_has_any(ga, gb)) AS agreed FROM l)"""


@query(_SIDES + " SELECT id, label_a, gold_a, label_b, gold_b, CASE WHEN agreed THEN 'AGREED' ELSE 'CONFLICT' END AS status, CASE WHEN agreed THEN label_a ELSE '' END AS final_label, CASE WHEN agreed AND label_a = 'ANSWER' THEN array_to_string(list_sort(list_distinct(list_concat(ga, gb))), ';') ELSE '' END AS final_gold_faq_ids FROM m")
def label_merge(spark, sf):
    t, i = lab.table(spark, sf, "labels"), F.col("doc_id")
    text = lambda c: c.cast("string")
    a = t.select(i.alias("id"), F.when(F.col("quality") == 1, " answer ").otherwise("NO_ANSWER").alias("label"), F.when(F.col("quality") == 1, F.concat(text(i % 7), F.lit(";"), text(i % 5))).otherwise("").alias("gold_faq_ids"))
    b = t.select(i.alias("id"), F.when(F.col("toxic") == 0, "ANSWER").otherwise("no_answer").alias("label"), F.when(F.col("toxic") == 0, F.concat(text(i % 5), F.lit(", "), text(i % 3))).otherwise("").alias("gold_faq_ids"))
    return labels.merge_labels(a, b)


@query(f"""WITH {_HITS}, k AS (SELECT qid, cid, '[' || cid || '] v' || cid || ' | ' || substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 100) AS shown, row_number() OVER (PARTITION BY qid ORDER BY sha1('__SEED__:' || qid || ':' || cid), cid) AS spot FROM hits LEFT JOIN documents ON doc_id = cid WHERE rank <= 4)
    SELECT qid AS id, """ + ", ".join(f"coalesce(max(shown) FILTER (spot = {k}), '') AS candidate_{k}" for k in range(1, 6)) + " FROM k GROUP BY qid")
def label_sheet(spark, sf):
    q, c = lab.queries_and_corpus(spark, sf)
    found = retrieve.top_k(q, c, 4).select("qid", "rank", F.col("cid").alias("faq_id"), F.concat(F.lit("v"), F.col("cid")).alias("faq_question"))
    answers = lab.table(spark, sf, "documents").select(F.col("doc_id").alias("faq_id"), F.col("text").alias("answer"))
    return labels.label_sheet(q.select(F.col("qid").alias("id")), found, answers, width=5)


@query(f"WITH {_HITS + _LABELS + _GOLD + _SENT} SELECT sent.qid, CAST(sent.cid AS VARCHAR) AS faq_id, CAST(idx AS INTEGER) AS sentence_idx, CAST(sim AS VARCHAR) AS sentence, '' AS needed FROM sent JOIN gold ON gold.qid = sent.qid AND gold.cid = sent.cid JOIN lb ON lb.qid = sent.qid WHERE kind = 1")
def sentence_sheet(spark, sf):
    q = lab.questions(spark, sf).select(F.col("qid").alias("id"), "final_label", F.array_join("gold", ";").alias("final_gold_faq_ids"))
    sent = lab.sentences(spark, sf).select("qid", "faq_id", "sentence_idx", F.col("similarity").cast("string").alias("sentence"))
    return labels.sentence_sheet(q, sent)[0]


@query(f"WITH {_HITS + _LABELS + _GOLD} SELECT gold.qid AS id, CAST(gold.cid AS VARCHAR) AS faq_id FROM gold JOIN lb ON lb.qid = gold.qid WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = gold.qid AND h.cid = gold.cid AND rank <= 10)")
def missing_sentences(spark, sf):
    q = lab.questions(spark, sf).select(F.col("qid").alias("id"), "final_label", F.array_join("gold", ";").alias("final_gold_faq_ids"))
    return labels.sentence_sheet(q, lab.sentences(spark, sf).withColumn("sentence", F.lit("")))[1]


@query("""WITH t AS (SELECT vec_id, CASE WHEN label = 9 THEN NULL ELSE 'topic' || label END AS topic FROM embeddings), f AS (SELECT topic, row_number() OVER (ORDER BY min(vec_id), topic) - 1 AS id FROM t WHERE topic IS NOT NULL GROUP BY topic)
    SELECT vec_id, CAST(coalesce(f.id, -1) AS INTEGER) AS topic_id FROM t LEFT JOIN f ON f.topic = t.topic""")
def topic_ids(spark, sf):
    e = lab.table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") == 9, "노이즈(무관)").otherwise(F.concat(F.lit("topic"), F.col("label"), F.lit(" / more"))).alias("expected"))
    return labels.topic_ids(e, order="vec_id").select("vec_id", "topic_id")


# --- clustering

_GROUPED = _V + ", p AS (SELECT 0 AS grp, vec_id AS id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v), d AS (SELECT x.grp, x.id AS a, y.id AS b, round(list_distance(x.u, y.u), 6) AS dist FROM p x JOIN p y ON x.grp = y.grp)"
_CORES = _GROUPED + ", co AS (SELECT grp, a AS id, dist AS core FROM d QUALIFY row_number() OVER (PARTITION BY grp, a ORDER BY dist, b) = 4)"


def _grouped(spark, sf):
    """All vectors as one group."""
    return lab.table(spark, sf, "embeddings").select(F.lit(0).alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(f"WITH {_CORES} SELECT grp, id, core FROM co")
def core_distance(spark, sf):
    return cluster.core_distances(_grouped(spark, sf), 4)


@query(f"WITH {_CORES} SELECT d.grp, a, b, greatest(dist, x.core, y.core) AS reach FROM d JOIN co x ON x.grp = d.grp AND x.id = a JOIN co y ON y.grp = d.grp AND y.id = b WHERE a < b")
def mutual_reachability(spark, sf):
    points = _grouped(spark, sf)
    return cluster.mutual_reachability(points, cluster.core_distances(points, 4))


@query()
def hdbscan_labels(spark, sf):
    return cluster.hdbscan(_grouped(spark, sf), min_cluster_size=3)


@query(f"WITH {_GROUPED} SELECT a, b, dist FROM d WHERE a < b")
def pairwise_distance(spark, sf):
    return cluster.pairwise_distances(_grouped(spark, sf)).select("a", "b", "dist")


@query("WITH t AS (SELECT label - 1 AS cluster, vec_id AS id, (vec_id % 10) / 10.0 AS p FROM embeddings) SELECT cluster, id, p AS probability, count(*) OVER (PARTITION BY cluster) AS n, round(avg(p) OVER (PARTITION BY cluster), 6) AS avg_probability FROM t")
def cluster_listing(spark, sf):
    t = lab.table(spark, sf, "embeddings").select((F.col("label") - 1).alias("cluster"), F.col("vec_id").alias("id"), ((F.col("vec_id") % 10) / 10).alias("probability"))
    return cluster.cluster_listing(t).select("cluster", "id", "probability", "n", *_r("avg_probability"))


_QUALITY = """cells AS (SELECT label AS t, vec_id % 7 AS p, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1, 2), tt AS (SELECT t, sum(n) AS n FROM cells GROUP BY t), pp AS (SELECT p, sum(n) AS n FROM cells GROUP BY p),
    x AS (SELECT sum(n) AS total, sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS e FROM cells), xt AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS e FROM tt), xp AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS e FROM pp),
    h AS (SELECT ln(total) - xt.e / total AS ht, ln(total) - xp.e / total AS hp, ln(total) - x.e / total AS htp, x.s AS s, xt.s AS st, xp.s AS sp, xt.s * xp.s / (total * (total - 1) / 2) AS ex FROM x, xt, xp),
    r AS (SELECT (s - ex) / ((st + sp) / 2 - ex) AS ari, 1 - (htp - hp) / ht AS homogeneity, 1 - (htp - ht) / hp AS completeness FROM h)"""


@query(f"WITH {_QUALITY} SELECT round(ari, 6) AS ari, round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS nmi, round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness FROM r")
def cluster_quality(spark, sf):
    t = lab.table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 7).alias("cluster"))
    return cluster.cluster_quality(t, "label").select(*_r("ari", "nmi", "homogeneity", "completeness"))


@query("SELECT count(DISTINCT c) FILTER (c >= 0) AS n_clusters, count(*) FILTER (c < 0) AS n_noise, round(avg(p) FILTER (c >= 0), 6) AS avg_probability FROM (SELECT label - 2 AS c, (vec_id % 10) / 10.0 AS p FROM embeddings)")
def cluster_counts(spark, sf):
    t = lab.table(spark, sf, "embeddings").select((F.col("label") - 2).alias("cluster"), ((F.col("vec_id") % 10) / 10).alias("probability"))
    return cluster.cluster_counts(t).select("n_clusters", "n_noise", *_r("avg_probability"))


# each profile's questions one by one, the groups so far as a list of their sums
_ARRIVALS = """WITH RECURSIVE e AS (SELECT vec_id % 5 AS profile, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY vec_id % 5 ORDER BY vec_id) AS pos FROM embeddings),
    g AS (SELECT profile, pos, id, [v] AS sums, 0 AS group_id, CAST(1 AS DOUBLE) AS similarity, false AS joined FROM e WHERE pos = 1
        UNION ALL SELECT profile, pos, id, CASE WHEN best >= 0.3 THEN list_transform(sums, lambda s, i: CASE WHEN i = spot THEN list_transform(list_zip(s, v), lambda z: z[1] + z[2]) ELSE s END) ELSE list_append(sums, v) END,
            CASE WHEN best >= 0.3 THEN spot - 1 ELSE len(sums) END, CASE WHEN best >= 0.3 THEN best ELSE 1 END, best >= 0.3
        FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS spot FROM (SELECT e.profile, e.pos, e.id, e.v, g.sums, list_transform(g.sums, lambda s: list_cosine_similarity(s, e.v)) AS sims FROM g JOIN e ON e.profile = g.profile AND e.pos = g.pos + 1)))
    SELECT profile, id, CAST(group_id AS INTEGER) AS group_id, round(similarity, 6) AS similarity, joined FROM g"""


@query(_ARRIVALS)
def nearest_centroid_groups(spark, sf):
    from gleaner.streaming.grouping import group_in_order

    e = lab.table(spark, sf, "embeddings").select((F.col("vec_id") % 5).alias("profile"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return group_in_order(e, threshold=0.3).withColumn("similarity", F.round("similarity", 6))


# --- serving, run logs, models

_CELLS = "cells AS (SELECT 'd' || (user_id % 2) AS dataset, event_type AS engine, CAST(user_id % 4 AS INTEGER) AS concurrency, value, value > 5 AS ok, 1 - value / 1e6 AS cs FROM events)"


def _requests(spark, sf):
    return lab.table(spark, sf, "events").select(F.concat(F.lit("d"), F.col("user_id") % 2).alias("dataset"), F.col("event_type").alias("engine"), (F.col("user_id") % 4).cast("int").alias("concurrency"), F.col("value").alias("latency"), (F.col("value") > 5).alias("ok"), (1 - F.col("value") / 1e6).alias("cosine"))


@query(f"WITH {_CELLS} SELECT dataset, engine, concurrency, count(*) AS requests, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(min(cs), 9) AS min_cosine FROM cells GROUP BY ALL")
def serving_cells(spark, sf):
    out = serving.latency_cells(_requests(spark, sf), ["dataset", "engine", "concurrency"], cosine="cosine")
    return out.select("dataset", "engine", "concurrency", "requests", "successes", "failures", *_r("p50", "p95", "p99"), *_r("min_cosine", digits=9))


@query(f"WITH {_CELLS}, g AS (SELECT dataset, engine, concurrency, count(*) FILTER (ok) / sum(value) AS r FROM cells GROUP BY ALL) SELECT dataset, concurrency, round(max(r) FILTER (engine = 'click') / max(r) FILTER (engine = 'view'), 6) AS ratio FROM g WHERE engine IN ('click', 'view') GROUP BY ALL")
def serving_ratio(spark, sf):
    cells = _requests(spark, sf).groupBy("dataset", "engine", "concurrency").agg(F.count_if("ok").alias("successes"), F.sum("latency").alias("seconds"))
    return serving.engine_ratio(serving.with_rate(cells), "click", "view").select("dataset", "concurrency", *_r("ratio"))


@query(f"WITH {_CELLS}, g AS (SELECT dataset, engine, concurrency, count(*) FILTER (value < 0) AS failures, min(cs) AS cs FROM cells GROUP BY ALL) SELECT engine, count(*) AS cells, CAST(sum(failures) AS BIGINT) AS failures, round(min(cs), 9) AS cosine_min, min(cs) >= 0.9995 AND count(*) >= 4 AND sum(failures) = 0 AS qualified FROM g GROUP BY engine")
def engine_qualify(spark, sf):
    cells = _requests(spark, sf).groupBy("dataset", "engine", "concurrency").agg(F.count_if(F.col("latency") < 0).alias("failures"), F.min("cosine").alias("min_cosine"))
    return serving.qualify_engines(cells, 0.9995, 4).select("engine", "cells", "failures", *_r("cosine_min", digits=9), "qualified")


@query("WITH t AS (SELECT event_type AS engine, round(count(*) / sum(value), 9) AS throughput FROM events WHERE event_type <> 'error' GROUP BY event_type) SELECT max(throughput) AS throughput, arg_max(engine, throughput) AS engine FROM t")
def engine_select(spark, sf):
    e = lab.table(spark, sf, "events").groupBy(F.col("event_type").alias("engine")).agg(F.round(F.count(F.lit(1)) / F.sum("value"), 9).alias("throughput"))
    return serving.select_engine(e.select("engine", (F.col("engine") != "error").alias("qualified")), e)


@query("SELECT count(*) AS n, coalesce(max(o_orderkey), 0) AS max_id, coalesce(sum(o_custkey), 0)::BIGINT AS sum_version FROM orders WHERE o_orderkey % 3 <> 0")
def snapshot_fingerprint(spark, sf):
    o = lab.table(spark, sf, "orders")
    return runlog.snapshot(o, "o_orderkey", "o_custkey", F.col("o_orderkey") % 3 != 0)


@query("SELECT '1' AS run, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, '' AS extra FROM nation UNION ALL SELECT '2', CAST(r_regionkey AS VARCHAR), '', r_name FROM region")
def runlog_union(spark, sf):
    old = lab.table(spark, sf, "nation").select(F.lit(1).alias("run"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    new = lab.table(spark, sf, "region").select(F.lit(runlog.next_run(old)).alias("run"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("extra"))
    return runlog.union_logs(old, new)


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents")
def content_hash(spark, sf):
    return lab.table(spark, sf, "documents").select("doc_id", tx.short_hash(F.col("text")).alias("digest"))


@query()
def model_evaluation(spark, sf):
    """The first words of each benchmark passage are looked up among the passages, by the built-in model and ranked in full."""
    spec = ModelSpec("hashed-256")
    b = lab.table(spark, sf, "benchmark").withColumn("tag", F.col("item_id"))
    start = F.array_join(F.slice(F.split("text", " "), 1, 12), " ")
    q = b.select(F.col("item_id").alias("qid"), "tag", embed_column(start, spec, "query").alias("vec"))
    c = b.select(F.col("item_id").alias("cid"), "tag", embed_column(F.col("text"), spec).alias("vec"))
    ranks = retrieve.first_ranks(q, c, {"gt_rank": lambda x, y: x == y})
    detail = rankmetrics.add_metrics(ranks).withColumns({"model": F.lit(spec.name), "category": (F.col("qid") % 2).cast("string")})
    return rankmetrics.summarize(detail)


@query("""WITH f AS (SELECT CAST(vec_id % 100 AS BIGINT) AS faq_id, vec_id AS pos, 'q' || vec_id AS question FROM embeddings) SELECT faq_id, min(pos) AS pos, arg_max(question, pos) AS question FROM f GROUP BY faq_id""")
def faq_corpus(spark, sf):
    from gleaner.sources.sheets import faq_corpus as corpus

    rows = lab.table(spark, sf, "embeddings").select((F.col("vec_id") % 100).alias("faq_id"), F.col("vec_id").alias("pos"), F.concat(F.lit("q"), F.col("vec_id")).alias("question"))
    return corpus(rows)


@query(_ARRIVALS)
def nearest_centroid_stream(spark, sf):
    """The grouping as a stream over the same rows, run until it has read them all."""
    import uuid

    from gleaner.sources.shared import shared_dir
    from gleaner.streaming.grouping import group_stream

    root = f"{shared_dir(spark)}/gleaner-stream-{uuid.uuid4().hex}"
    path = f"{sf}/embeddings.parquet"
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/embeddings.parquet*").select((F.col("vec_id") % 5).alias("profile"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))
    grouped = group_stream(e, threshold=0.3)
    grouped.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(grouped.schema).parquet(f"{root}/out").withColumn("similarity", F.round("similarity", 6))
