import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import models
from gleaner.functions import text as tx
from gleaner.functions import vectors as vx
from gleaner.functions.models import HashedEmbedder, ModelSpec, build_embedder, embed_column, evaluate_models, prompted, score_column, select_models
from gleaner.operators import cluster, intents, labels, rankmetrics, retrieve, runlog, serving, thresholds
from gleaner.streaming.grouping import group_in_order


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- vectors, text


def test_cosines(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0, 9.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(25 / (5 * np.sqrt(106))) and got[1] == 0.0
    for bad in range(2):
        with pytest.raises(Exception, match="differ|norm 0"):
            df.limit(bad + 1).select(vx.strict_cosine(F.col("a"), F.col("b"))).collect()


def test_maxsim_and_normalize(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 1.0], [1.0, 1.0, 0.0, 2.0])], "q array<double>, d array<double>")
    q, d = vx.chunks(F.col("q"), 2, 2), vx.chunks(F.col("d"), 2, 2)
    assert df.select(vx.maxsim(q, d)).first()[0] == pytest.approx((np.sqrt(0.5) + 1) / 2)
    assert df.select(vx.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_text(spark):
    df = spark.createDataFrame([(" A　b\x1cC\t", "1; 2,, 1 ", "x + y+x+")], "t string, ids string, i string")
    r = df.select(tx.norm_key(F.col("t")), tx.split_ids(F.col("ids")), tx.split_ids(F.col("ids"), True), tx.split_intents(F.col("i")), tx.split_intents(F.lit(" 무관 ")), tx.parse_double(F.lit("NaN")), tx.parse_double(F.lit("x")), tx.parse_double(F.lit("1.5")), tx.collapse(F.lit(" a  b\n c "), 4)).first()
    assert tuple(r) == ("abc", ["1", "2", "1"], ["1", "2"], ["x", "y"], [], None, None, 1.5, "a b ")


# --- retrieval and metrics


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    return [(k, rng.normal(size=5).tolist(), int(rng.integers(3))) for k in range(n)]


def brute(q, c, k):
    out = {}
    for i, v, _ in q:
        s = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w, _ in c]
        out[i] = [(r + 1, j, -x) for r, (x, j) in enumerate(sorted(s)[:k])]
    return {(i, r, j, x) for i, own in out.items() for r, j, x in own}


@pytest.mark.parametrize("small", [4096, 3])
def test_top_k_either_way(spark, small):
    q, c = vectors(9, 1), vectors(70, 2) + [(100, [1.0] * 5, 0), (101, [2.0] * 5, 0)]
    qd, cd = spark.createDataFrame(q + [(50, None, 0)], "qid long, vec array<double>, x int"), spark.createDataFrame(c + [(200, None, 1)], "cid long, vec array<double>, x int")
    got = retrieve.top_k(qd, cd, 4, small=small)
    assert {(r.qid, r["rank"], r.cid, r.score) for r in got.collect()} == brute(q, c, 4)


@pytest.mark.parametrize("small", [4096, 3])
def test_first_ranks_either_way(spark, small):
    q, c = vectors(7, 3), vectors(40, 4)
    qd, cd = spark.createDataFrame(q, "qid long, vec array<double>, tag int"), spark.createDataFrame(c, "cid long, vec array<double>, tag int")
    got = {r.qid: (r.same, r.none) for r in retrieve.first_ranks(qd, cd, {"same": lambda a, b: a == b, "none": lambda a, b: a + 99 == b}, small=small).collect()}
    full = brute(q, c, 40)
    tag = {j: t for j, _, t in c}
    for i, _, t in q:
        assert got[i] == (min(r for a, r, j, _ in full if a == i and tag[j] == t), None)


def test_rerank_and_variants(spark):
    hits = spark.createDataFrame([(1, 1, 10, 0.9, "a"), (1, 2, 11, 0.8, "a"), (1, 3, 12, 0.7, "b"), (1, 4, 13, 0.6, "c")], "qid int, rank int, cid int, score double, g string")
    new = F.when(F.col("cid") == 12, 5.0).otherwise(1.0)
    assert [(r["rank"], r.cid) for r in retrieve.rerank(hits, new, window=3, k=2).orderBy("rank").collect()] == [(1, 12), (2, 10)]
    swept = retrieve.rerank_sweep(hits, new, [(2, 2), (3, 2)])
    assert sorted((r.window, r["rank"], r.cid) for r in swept.collect()) == [(2, 1, 10), (2, 2, 11), (3, 1, 12), (3, 2, 10)]
    assert [r.cid for r in retrieve.best_variant(hits, "g", 2).orderBy("rank").collect()] == [10, 12]


def test_hybrid_and_sparse(spark):
    hits = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 12, 0.1)], "qid int, rank int, cid int, score double")
    q = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "qid int, term string, weight double")
    c = spark.createDataFrame([(11, "a", 1.0), (12, "z", 1.0)], "cid int, term string, weight double")
    got = retrieve.hybrid(retrieve.lexical_overlap(hits, q, c), F.col("score"), F.col("lexical")).orderBy("rank").collect()
    assert [(r.cid, r.score) for r in got] == [(11, 0.68), (10, 0.54), (12, 0.06)]
    m = spark.createDataFrame([({"a": 0.5, "b": 1.0}, {"b": 2.0, "c": 1.0})], "q map<string,double>, d map<string,double>")
    assert m.select(vx.sparse_dot(F.col("q"), F.col("d"))).first()[0] == 2.0


def test_metrics(spark):
    df = spark.createDataFrame([(9, 1, False), (2, None, True), (2, 2, True), (None, None, True), (2, 9, True)], "g int, b int, has boolean")
    assert [r[0] for r in df.select(rankmetrics.hard_negative_pass(F.col("g"), F.col("b"), F.col("has"))).collect()] == [True, True, False, False, True]
    cases = [(None, 1, "stage1_miss"), (6, 1, "stage1_miss"), (2, None, "error"), (2, 1, "improved"), (1, 3, "worsened"), (2, 2, "same")]
    got = spark.createDataFrame(cases, "b int, n int, want string").select(rankmetrics.change_class(F.col("b"), F.col("n"), 5), "want").collect()
    assert all(a == b for a, b in got)
    cases = [(None, 1, "stage1_miss"), (11, 1, "stage1_miss"), (4, 7, "worsened_out"), (4, None, "worsened_out"), (8, 2, "improved_in"), (3, 1, "improved_up"), (1, 3, "worsened_down"), (8, 9, "same"), (2, 2, "same")]
    got = spark.createDataFrame(cases, "b int, n int, want string").select(rankmetrics.change_class_buffer(F.col("b"), F.col("n"), 5, 10), "want").collect()
    assert all(a == b for a, b in got)


def test_summary_and_pivot(spark):
    detail = rankmetrics.add_metrics(spark.createDataFrame([("m", "E", 1), ("m", "E", 2), ("m", "H", None)], "model string, category string, gt_rank int"))
    got = {r.category: (r.n, r.top1, r.top3, r.mrr) for r in rankmetrics.summarize(detail).collect()}
    assert got == {rankmetrics.OVERALL: (3, 0.333, 0.667, 0.5), "E": (2, 0.5, 1.0, 0.75), "H": (1, 0.0, 0.0, 0.0)}
    wide = rankmetrics.pivot_categories(rankmetrics.summarize(detail), values=["E", "X"]).first()
    assert (wide["E"], wide["X"]) == ("0.5", "-")


# --- intents


def test_intents(spark):
    cases = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["a", "b"])], "qid int, intents array<string>")
    hits = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "b", 0.4), (2, 1, "a", 0.3), (3, 1, "b", 0.7)], "qid int, rank int, intent string, score double")
    s = intents.survivors(cases, hits, intents.parse_thresholds(spark, "0.3,0.5"))
    got = {(r.t, r.intent): (r.n, r.n_ok) for r in intents.recall_sweep(s).collect()}
    assert got == {(0.3, "a"): (2, 1), (0.3, "b"): (1, 1), (0.3, None): (1, 0), (0.5, "a"): (2, 1), (0.5, "b"): (1, 1), (0.5, None): (1, 1)}
    assert tuple(intents.lowest_safe_threshold(intents.bottleneck(intents.recall_sweep(s))).first()) == (0.5, 0.5)
    assert {tuple(r) for r in intents.recall_failures(s, hits).collect()} == {(0.3, 3, "a", None, "no candidate"), (0.5, 3, "a", None, "no candidate")}
    assert rows(intents.irrelevant_failures(s)) == [(0.3, 2, "a")]
    assert [r.t for r in intents.parse_thresholds(spark, "0.30:0.34:0.02").collect()] == [0.3, 0.32, 0.34]
    with pytest.raises(Exception, match="unknown intent"):
        intents.map_intents(spark.createDataFrame([("Q", "X")], "text string, intent string"), {"Y": "y"}).collect()


# --- two thresholds


def outcome_fixture(spark):
    q = [(0, 1, 0.80, 0.75, 1, 0.75), (1, 1, 0.80, 0.75, 1, 0.60), (2, 1, 0.85, 0.90, 2, 0.80), (3, 1, 0.85, 0.90, 2, 0.60), (4, 0, 0.72, 0.70, 0, None), (5, -1, 0.80, 0.75, 0, None)]
    second = {0: (0.5, 0.4), 1: (0.5, 0.4), 2: (0.75, 0.8), 3: (0.75, 0.6), 4: (0.5, 0.4), 5: (0.5, 0.4)}
    out = []
    for i, kind, sim, s, gold, req in q:
        out += [(i, kind, 1, sim, s, req if gold == 1 else None, gold == 1), (i, kind, 2, *second[i], req if gold == 2 else None, gold == 2), (i, kind, 3, None, None, None, False)]
    return spark.createDataFrame(out, "qid int, kind int, rank int, sim double, max_s double, req_min double, is_gold boolean")


def test_outcomes(spark):
    ds = outcome_fixture(spark)
    cells = spark.createDataFrame([(0.70, 0.70), (0.70, 0.80), (0.75, 0.70), (0.75, 0.80)], "t1 double, t2 double")
    got = {(r.qid, r.t1, r.t2): r.cat for r in thresholds.outcomes(ds, cells).collect()}
    want = {(0, 0.7, 0.7): thresholds.CORRECT, (0, 0.7, 0.8): thresholds.NOANS, (1, 0.7, 0.7): thresholds.INCOMPLETE, (2, 0.7, 0.7): thresholds.CORRECT, (2, 0.75, 0.8): thresholds.CORRECT, (3, 0.7, 0.7): thresholds.WRONG, (4, 0.7, 0.7): thresholds.FALSEPASS, (4, 0.75, 0.7): thresholds.REFUSE, (4, 0.7, 0.8): thresholds.REFUSE, (5, 0.7, 0.7): -1}
    assert {k: got[k] for k in want} == want


def test_folded_loss_is_the_mean_of_outcomes(spark):
    ds = outcome_fixture(spark)
    t1, t2 = thresholds.grid_values(spark, 0.5, 0.9, 0.1, "t1"), thresholds.grid_values(spark, 0.4, 0.9, 0.1, "t2")
    w = thresholds.loss_map(thresholds.WEIGHTS)
    cat = thresholds.outcomes(ds, thresholds.grid(t1, t2)).toPandas()
    for r in thresholds.grid_loss(ds, t1, t2).collect():
        own = cat[(cat.t1 == r.t1) & (cat.t2 == r.t2)]
        a, u = own[own.kind == 1].cat, own[own.kind == 0].cat
        assert r.loss_a == pytest.approx(np.mean([w[c] for c in a])) and r.false_pass == pytest.approx((u == thresholds.FALSEPASS).mean())
    ends = thresholds.smooth(thresholds.grid_loss(ds, t1, t2), ["loss"]).toPandas()
    grid = ends.pivot(index="t1", columns="t2", values="loss").to_numpy()
    pad = np.pad(grid, 1, mode="edge")
    want = sum(pad[i : i + grid.shape[0], j : j + grid.shape[1]] for i in range(3) for j in range(3)) / 9
    assert np.allclose(ends.pivot(index="t1", columns="t2", values="sm_loss").to_numpy(), want)


def test_default_grid_sizes(spark):
    t1, t2 = thresholds.grid_values(spark, 0.5, 0.9, 0.01, "t1"), thresholds.grid_values(spark, 0.4, 0.9, 0.01, "t2")
    assert (t1.count(), t2.count()) == (41, 51) and t1.agg(F.max("t1")).first()[0] == 0.9


def test_intervals_hold_the_mean(spark):
    rng = np.random.default_rng(0)
    out = []
    for i in range(80):
        kind = int(i % 4 != 0)
        out += [(i, kind, k, float(rng.uniform(0.3, 0.9)), float(rng.uniform(0.3, 0.9)), None, bool(kind and k == 1)) for k in (1, 2, 3)]
    ds = spark.createDataFrame(out, "qid int, kind int, rank int, sim double, max_s double, req_min double, is_gold boolean")
    cells = spark.createDataFrame([(0.6, 0.6)], "t1 double, t2 double")
    r = thresholds.loss_intervals(ds, cells, draws=500).first()
    mean = thresholds.grid_loss(ds, cells.select("t1"), cells.select("t2")).first()
    assert r.loss_lo < mean.loss < r.loss_hi and r.loss_lo < r.loss_p90 < r.loss_hi and r.fp_lo <= mean.false_pass <= r.fp_hi
    few = thresholds.loss_intervals(ds, cells, draws=500, block=10).first()  # many blocks, the same spread
    assert abs(few.loss_lo - r.loss_lo) < 0.15 and abs(few.loss_hi - r.loss_hi) < 0.15
    boot = thresholds.interval(thresholds.hash_bootstrap(spark.range(500).select(F.col("id").alias("qid"), (F.col("id") % 2).cast("double").alias("v")), "v", 200)).first()
    assert 0.42 < boot.lo < 0.5 < boot.hi < 0.58
    with pytest.raises(ValueError, match="needed"):
        thresholds.check_classes(ds.where("kind = 1"))


# --- labels


def test_merge_questions_drops_white_space_twins(spark):
    a = spark.createDataFrame([(k, f"question {k}", "ANS", "NORMAL") for k in range(7)], "pos int, question string, group string, expression_type string")
    b = spark.createDataFrame([(0, " Question3 ", "ANS", "NORMAL"), (1, "new one", "OFF", "MULTI")], "pos int, question string, group string, expression_type string")
    got = labels.merge_questions([("a", a), ("b", b)]).orderBy("id").collect()
    assert [r.id for r in got] == [f"Q{k:04d}" for k in range(1, 9)] and got[-1].question == "new one"
    assert rows(labels.violations(b.withColumn("group", F.lit("BAD")), {"group": labels.GROUPS}).select("problem")) == [("group=BAD",)] * 2
    with pytest.raises(ValueError, match="invalid rows"):
        labels.validate(b.withColumn("group", F.lit("BAD")), {"group": labels.GROUPS})
    with pytest.raises(ValueError, match="missing"):
        labels.require_columns(b, ("writer",))


def test_split_is_deterministic_and_stratified(spark):
    df = spark.createDataFrame([(f"Q{k}", f"g{k % 3}", "ANSWER" if k % 2 else "BORDER") for k in range(300)], "id string, intended_group string, final_label string")
    one = {r.id: r.split for r in labels.split_dev_test(df).collect()}
    assert one == {r.id: r.split for r in labels.split_dev_test(df.orderBy(F.desc("id"))).collect()}
    assert sum(v == "dev" for v in one.values()) == 180


def test_split_cuts_each_stratum_by_its_hashes(spark):
    rows = [(f"Q{k}", None if k % 5 == 0 else "ab"[k % 2], "x") for k in range(401)] + [("one", "c", "x")] * 3 + [("Z", "d", None)]
    got = labels.split_dev_test(spark.createDataFrame(rows, "id string, g string, f string"), ratio=0.37, strata=("g", "f")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.g, r.f), []).append(r)
    for own in by.values():
        order = sorted(own, key=lambda r: (hashlib.sha1(f"{labels.SEED}:{r.id}".encode()).hexdigest(), r.id, r.split != "dev"))
        cut = round(0.37 * len(own))
        assert [r.split for r in order] == ["dev"] * cut + ["test"] * (len(own) - cut)


def test_agreement(spark):
    df = spark.createDataFrame([("A", "A")] * 20 + [("A", "B")] * 5 + [("B", "A")] * 10 + [("B", "B")] * 15, "a string, b string")
    r = labels.agreement(df, "a", "b").first()
    assert (r.n, r.agreement) == (50, 0.7) and r.kappa == pytest.approx(0.4)
    assert labels.agreement(df.where("a = 'A' and b = 'A'"), "a", "b").first().kappa is None
    assert labels.agreement(df.limit(0), "a", "b").first().agreement is None


def test_merge_labels(spark):
    a = spark.createDataFrame([(1, "answer ", "3;1"), (2, "ANSWER", "1"), (3, "BORDER", ""), (4, "NO_ANSWER", None)], "id int, label string, gold_faq_ids string")
    b = spark.createDataFrame([(1, "ANSWER", "1,2"), (2, "ANSWER", "9"), (3, "ANSWER", "1"), (4, "NO_ANSWER", "")], "id int, label string, gold_faq_ids string")
    got = labels.merge_labels(a, b).orderBy("id").collect()
    assert [(r.status, r.final_label, r.final_gold_faq_ids) for r in got] == [("AGREED", "ANSWER", "1;2;3"), ("CONFLICT", "", ""), ("CONFLICT", "", ""), ("AGREED", "NO_ANSWER", "")]
    assert labels.unresolved(labels.merge_labels(a, b)).count() == 2


# --- clustering


def test_hdbscan_finds_planted_groups(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(6)[:3]
    points = [(0, k, (centres[k % 3] + rng.normal(0, 0.02, 6)).tolist()) for k in range(60)] + [(0, 100 + k, rng.normal(size=6).tolist()) for k in range(4)]
    got = cluster.hdbscan(spark.createDataFrame(points, "grp int, id int, vec array<double>"), 5).toPandas().set_index("id")
    for k in range(3):
        own = got.loc[[i for i in range(60) if i % 3 == k], "cluster"]
        assert (own >= 0).mean() > 0.8 and own[own >= 0].nunique() == 1
    assert got.loc[range(60)].cluster[lambda c: c >= 0].nunique() == 3 and (got.probability.between(0, 1)).all()


def test_hdbscan_small_and_equal_points():
    assert cluster.hdbscan_points(np.zeros((1, 2)), 2)[0].tolist() == [-1]
    two = np.array([[0.0, 0]] * 5 + [[9.0, 9]] * 5)
    label, prob = cluster.hdbscan_points(two, 3)
    assert len(set(label[:5])) == len(set(label[5:])) == 1 and label[0] != label[9] and (label >= 0).all() and prob.max() <= 1


def test_quality_closed_forms(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "topic_id int, cluster int")
    assert tuple(cluster.cluster_quality(df).first()) == pytest.approx((1, 1, 1, 1))
    one = df.withColumn("cluster", F.lit(-1))
    assert tuple(cluster.cluster_quality(one).first()) == pytest.approx((0, 0, 0, 1))
    part = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 2)], "topic_id int, cluster int")
    r = cluster.cluster_quality(part).first()
    assert r.ari == pytest.approx(0.4 / 3.4) and r.homogeneity == pytest.approx(0.5408520829727552) and 0 < r.nmi < 1


def test_log_parse(spark):
    text = ["===", "회차 1 | x | min_cluster_size = 2", "  클러스터 0 (2개) | 평균 확신도: 0.90", "    ✓ [주제 하나] 질문이 있나요?  (확신도: 1.00)", "    ✓ [주제 하나 / 둘] 질문 (괄호) 있나요?  (확신도: 0.80)", "  노이즈로 분류됨 (1개)", "    · [노이즈(무관)] 무관한 질문?"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(text)], "pos int, value string")
    got = [tuple(r)[1:] for r in cluster.parse_cluster_log(df).orderBy("pos").collect()]
    assert got == [(2, 0, "주제 하나", "질문이 있나요?", 1.0), (2, 0, "주제 하나 / 둘", "질문 (괄호) 있나요?", 0.8), (2, -1, "노이즈(무관)", "무관한 질문?", 0.0)]
    ids = labels.topic_ids(cluster.parse_cluster_log(df)).orderBy("pos")
    assert [r.topic_id for r in ids.collect()] == [0, 0, -1]


def test_groups_by_arrival(spark):
    df = spark.createDataFrame([("p", 1, 1, [1.0, 0.0]), ("p", 2, 2, [0.9, 0.1]), ("p", 3, 3, [0.0, 1.0]), ("q", 4, 1, [0.0, 1.0]), ("p", 5, 4, None)], "profile string, id int, pos int, vec array<double>")
    got = {r.id: (r.group_id, r.joined) for r in group_in_order(df, 0.6).collect()}
    assert got == {1: (0, False), 2: (0, True), 3: (1, False), 4: (0, False)}


# --- models, run logs


def test_models(spark):
    spec = ModelSpec("m", style="prefix", query_prefix="query: ", options={"width": 16})
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    got = df.select(embed_column(F.col("t"), spec, "query"), prompted(F.col("t"), spec, "query"), score_column(F.lit("a x"), F.col("t"))).collect()
    assert got[0][0] == HashedEmbedder(spec).embed_batch(["query: a b"])[0] and got[0][1] == "query: a b" and got[0][2] == 0.5 and got[1][2] == 0.0
    with pytest.raises(ValueError, match="unknown backend"):
        build_embedder(ModelSpec("x", backend="nope"))
    with pytest.raises(ValueError, match="unknown models"):
        select_models([spec], ["other"])
    said = []

    def evaluate(s):
        if s.name == "bad":
            raise RuntimeError("broken")
        return spark.createDataFrame([(1,)], "v int")

    assert [r.model for r in evaluate_models([spec, ModelSpec("bad")], evaluate, said.append).collect()] == ["m"] and said == ["bad: broken"]


def test_run_logs(spark):
    old = spark.createDataFrame([("1", "a"), ("x", "b")], "run string, p string")
    assert runlog.next_run(old) == 2 and runlog.next_run(None) == 1
    new = runlog.numbered(old, spark.createDataFrame([("c", "z")], "p string, q string"))
    assert [tuple(r)[0::2] for r in runlog.union_logs(old, new.drop("timestamp")).orderBy("p").collect()] == [("1", ""), ("x", ""), ("2", "z")]
    assert new.columns == ["run", "timestamp", "p", "q"]
    empty = spark.createDataFrame([], "id long, version long")
    assert tuple(runlog.snapshot(empty).first()) == (0, 0, 0) and runlog.same_snapshot(runlog.snapshot(empty), runlog.snapshot(empty))




# --- serving


def test_cells_from_nested_json(spark):
    from gleaner.operators import serving

    text = '{"one": {"x": [{"concurrency": 1, "n": 5}, {"concurrency": 4, "n": 6}], "y": [{"concurrency": 1, "n": 10}]}}'
    schema = "one map<string, array<struct<concurrency: int, n: int>>>"
    cells = serving.flatten_cells(spark.createDataFrame([(text,)], "j string").select(F.from_json("j", schema).alias("r")).select("r.*"))
    assert sorted(map(tuple, cells.collect())) == [("one", "x", 1, 5), ("one", "x", 4, 6), ("one", "y", 1, 10)]
    ratio = {r.concurrency: r.ratio for r in serving.engine_ratio(cells, "y", "x", "n").collect()}
    assert ratio == {1: 2.0, 4: None}
    q = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "engine string, qualified boolean")
    t = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 9.0)], "engine string, throughput double")
    assert tuple(serving.select_engine(q, t).first()) == (2.0, "a") and serving.select_engine(q.where("engine = 'c'"), t).count() == 0


def test_more_queries_than_fit_make_no_pairs(spark):
    q, c = vectors(4097, 5), vectors(12, 6)
    qd, cd = spark.createDataFrame(q, "qid long, vec array<double>, tag int"), spark.createDataFrame(c, "cid long, vec array<double>, tag int")
    ranks = retrieve.first_ranks(qd, cd, {"same": lambda a, b: a == b})
    plan = ranks._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "Generate" not in plan
    got = {r.qid: r.same for r in ranks.collect()}
    full, tag, tags = brute(q[:50], c, 12), {j: t for j, _, t in c}, {i: t for i, _, t in q}
    assert len(got) == 4097
    for i, _, _ in q[:50]:
        own = [r for a, r, j, _ in full if a == i and tag[j] == tags[i]]
        assert got[i] == (min(own) if own else None)


@pytest.mark.parametrize("small", [4096, 2])
def test_sparse_top_k(spark, small):
    rng = np.random.default_rng(7)
    q = [(i, f"t{t}", float(rng.integers(1, 9))) for i in range(7) for t in rng.choice(12, 5, replace=False)]
    c = [(i, f"t{t}", float(rng.integers(1, 9))) for i in range(600) for t in rng.choice(30, 4, replace=False)]
    want = set()
    for i in range(7):
        own, scores = {t: w for a, t, w in q if a == i}, {}
        for j, t, w in c:
            if t in own:
                scores[j] = scores.get(j, 0) + w * own[t]
        want |= {(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(((-s, j) for j, s in scores.items()))[:4]) for s in [-s]}
    qd, cd = spark.createDataFrame(q, "qid long, term string, weight double"), spark.createDataFrame(c, "cid long, term string, weight double")
    assert {(r.qid, r["rank"], r.cid, r.score) for r in retrieve.sparse_top_k(qd, cd, 4, small=small).collect()} == want
    assert retrieve.sparse_top_k(qd.limit(0), cd, 4).count() == 0 == retrieve.sparse_top_k(qd, cd.limit(0), 4).count()


def plain_hdbscan(x, size):
    """Labels by the definitions: the hierarchy level by level, then the choice of clusters by mass."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, size - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])

    def parts(points, level):
        """Components of the points by links shorter than level."""
        left, out = set(points), []
        while left:
            todo = [left.pop()]
            own = set(todo)
            while todo:
                p = todo.pop()
                near = {q for q in left if reach[p, q] < level}
                left -= near
                own |= near
                todo += near
            out.append(sorted(own))
        return out

    levels = sorted({reach[a, b] for a in range(n) for b in range(a)}, reverse=True)

    def cluster(points, birth):
        """mass, chosen clusters below or at this one."""
        mass, now = 0.0, list(points)
        for level in levels:
            split = parts(now, level)
            big = [p for p in split if len(p) >= size]
            gone = len(now) - sum(map(len, big))
            if len(big) > 1 or not big:
                mass += len(now) * (1 / level - birth)
                below = [cluster(p, 1 / level) for p in big]
                under = sum(m for m, _ in below)
                return (under, [c for _, own in below for c in own]) if big and under > mass else (mass, [points])
            mass += gone * (1 / level - birth)
            now = big[0]
        return mass, [points]

    chosen = []
    for level in levels:
        big = [p for p in parts(range(n), level) if len(p) >= size]
        if len(big) > 1:
            break
    now = list(range(n))
    for level in levels:
        big = [p for p in parts(now, level) if len(p) >= size]
        if len(big) > 1:
            chosen = [c for p in big for c in cluster(p, 1 / level)[1]]
            break
        if not big:
            break
        now = big[0]
    label = np.full(n, -1)
    for k, own in enumerate(chosen):
        label[own] = k
    return label


@pytest.mark.parametrize("seed", range(4))
def test_hdbscan_against_the_definitions(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (12, 3)) for c, s in ((0, 0.2), (1.2, 0.3), (4, 0.5), (2.4, 0.1))] + [rng.uniform(-2, 6, (9, 3))])
    for size in (3, 5):
        got, want = cluster.hdbscan_points(x, size)[0], plain_hdbscan(x, size)
        # where links are equally long, a point that splits off as a cluster is born is of it or noise, by the order of links
        assert ((got < 0) != (want < 0)).sum() <= 2
        both = (got >= 0) & (want >= 0)
        pairs = set(zip(got[both].tolist(), want[both].tolist(), strict=True))
        assert len(pairs) == len(set(got[got >= 0])) == len(set(want[want >= 0])) >= 2


@pytest.mark.parametrize("block", [1024, 7])
def test_distances_block_by_block(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "_BLOCK", block)
    rng = np.random.default_rng(3)
    pts = [(g, i, rng.normal(size=4).tolist()) for g in range(2) for i in range(25)] + [(0, 40, [1.0, 0.0, 0.0, 0.0]), (0, 41, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(pts, "grp int, id long, vec array<double>")
    unit = {(g, i): np.array(v) / np.linalg.norm(v) for g, i, v in pts}
    want = {(g, i, j): round(float(np.linalg.norm(unit[g, i] - unit[g, j])), 6) for g, i in unit for h, j in unit if g == h}
    got = {(r.grp, r.a, r.b): r.dist for r in cluster.pairwise_distances(df).collect()}
    assert got == {k: v for k, v in want.items() if k[1] < k[2]}
    cores = {(g, i): sorted(v for (h, a, _), v in want.items() if (h, a) == (g, i))[3] for g, i in unit}
    found = cluster.core_distances(df, 4)
    assert {(r.grp, r.id): r.core for r in found.collect()} == cores
    reach = {(r.grp, r.a, r.b): r.reach for r in cluster.mutual_reachability(df, found).collect()}
    assert reach == {(g, a, b): max(d, cores[g, a], cores[g, b]) for (g, a, b), d in got.items()}


def test_listing_shows_every_member(spark):
    df = spark.range(1201).select("id", F.when(F.col("id") < 1100, 0).otherwise(-1).alias("cluster"), F.lit(0.5).alias("probability"))
    got = cluster.cluster_listing(df).collect()
    assert [r.id for r in got] == list(range(1201)) and got[0].n == 1100 and got[-1].n == 101


def test_engine_ties_go_to_the_name(spark):
    both = spark.createDataFrame([("tei", True, 5.0), ("tea", True, 5.0), ("a", False, 9.0)], "engine string, qualified boolean, throughput double")
    assert serving.select_engine(both.select("engine", "qualified"), both.select("engine", "throughput")).first().engine == "tea"


def test_a_model_that_fails_as_it_runs_is_left_out(spark):
    bad = F.udf(lambda x: 1 // 0, "int")
    said = []
    out = models.evaluate_models([models.ModelSpec("good"), models.ModelSpec("bad")], lambda s: spark.range(2).select((F.col("id") if s.name == "good" else bad("id")).cast("long").alias("v")), said.append)
    assert [r.model for r in out.collect()] == ["good"] * 2 and said[0].startswith("bad:")


def test_histogram_at_the_edges_of_bins(spark):
    """A value on an edge goes where dividing by the width puts it, as in the SQL of score_histogram."""
    at = [round(k * 0.025, 6) for k in range(41)]
    got = {r.bin: r.n for r in thresholds.histogram(spark.createDataFrame([(v,) for v in at], "v double"), "v", 0.0, 1.0).collect()}
    want = Counter(min(40, math.floor((v - 0.0) / 0.025) + 1) for v in at)
    assert got == want


def test_distances_shuffle_each_block_few_times(spark):
    """Blocks that meet are large, so what is shuffled stays small against the pairs: 30,000 points in 4 blocks are 10 meetings."""
    df = spark.range(30_000).select(F.lit(0).alias("grp"), "id", F.array(F.col("id").cast("double")).alias("vec"))
    met = cluster._meetings(df).select("block", "block2").collect()
    assert {tuple(sorted(r)) for r in met} == {(a, b) for b in range(4) for a in range(b + 1)} and len(met) == 10


@pytest.mark.parametrize("query", ["mutual_reachability", "pairwise_distance"])
def test_a_written_pair_takes_few_bytes(spark, tmp_path, query):
    """Pairs of a matrix come by distance, so that equal ones stand together; in the order of ids a distance alone takes eight bytes."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(rng.normal(size=(1500, 64)))], "grp int, id long, vec array<double>").repartition(1)
    pairs = cluster.pairwise_distances(df) if query == "pairwise_distance" else cluster.mutual_reachability(df, cluster.core_distances(df, 4))
    pairs.write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1500 * 1499 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 7 * 1500 * 1499 // 2


@pytest.mark.parametrize("size", [3, 16])
def test_pairs_matrix_by_matrix(spark, monkeypatch, size):
    """Groups larger than a matrix: every pair comes once, whatever ids and odd vectors there are."""
    for name, value in (("_BLOCK", 20), ("_TILE", 2), ("_SORTED", size), ("_PAIRS", 5)):
        monkeypatch.setattr(cluster, name, value)
    rng = np.random.default_rng(4)
    x = {f"v{k}": v for k, v in enumerate(rng.normal(size=(30, 3)))} | {"same": np.ones(3), "equal": np.ones(3), "zero": np.zeros(3), "none": np.full(3, np.nan)}
    df = spark.createDataFrame([("g", k, v.tolist()) for k, v in x.items()], "grp string, id string, vec array<double>")
    rows = cluster.pairwise_distances(df, normalize=False).collect()
    got = {(r.a, r.b): np.nan if r.dist is None else r.dist for r in rows}
    assert len(rows) == len(got) == 34 * 33 // 2 and all(a < b for a, b in got)
    assert all(np.isclose(d, np.linalg.norm(x[a] - x[b]), atol=1e-6, equal_nan=True) for (a, b), d in got.items())


def test_cores_are_computed_once_for_mutual_reachability(spark):
    df = spark.range(20).select(F.lit(0).alias("grp"), "id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    made = cluster.mutual_reachability(df, cluster.core_distances(df, 4))
    assert made._jdf.queryExecution().sparkPlan().toString().count("MapInPandas") == 1 and made.count() == 190


def test_hdbscan_of_a_large_group(spark, monkeypatch):
    """A group too large for one task gets the labels of hdbscan_points, ties of equal points included."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, s, (40, 3)) for c, s in ((0, 0.2), (1.2, 0.3), (4, 0.5))] + [rng.uniform(-2, 6, (30, 3)), np.full((6, 3), 2.0)])
    df = spark.createDataFrame([(g, k, v.tolist()) for g, n in ((0, len(x)), (1, 20)) for k, v in enumerate(x[:n])], "grp int, id long, vec array<double>")
    for name, value in (("MOST_POINTS", 50), ("_BLOCK", 32), ("_TILE", 8), ("_TREE", 12), ("_LINKS", 500)):
        monkeypatch.setattr(cluster, name, value)
    got = {(r.grp, r.id): (r.cluster, r.probability) for r in cluster.hdbscan(df, 4, normalize=False).collect()}
    assert len(got) == len(x) + 20
    for g, n in ((0, len(x)), (1, 20)):
        want, sure = cluster.hdbscan_points(x[:n], 4)
        assert [got[g, k][0] for k in range(n)] == want.tolist() and [got[g, k][1] for k in range(n)] == pytest.approx(sure.tolist())
    assert len({c for c, _ in got.values()}) > 3
