"""Each catalogue query against its SQL in DuckDB, over the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from gleaner.functions.models import HashedEmbedder, ModelSpec
from gleaner.operators import thresholds
from gleaner.operators.cluster import hdbscan_points
from gleaner.queries import ORACLES, QUERIES, _grid

DATA = os.environ.get("GLEANER_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or hasattr(v, "__float__"):
        return None if math.isnan(float(v)) else round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rel = db.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    want = Counter(tuple(cell(v) for v in r) for r in rel.fetchall())
    got = Counter(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert got == want and got


def test_each_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLES) == {"loss_intervals", "final_scores", "hdbscan_labels", "model_evaluation"}


def replayed(spark, split=None, pairs=None, draws=200, prior=0.75, seed=20261019):
    """Intervals by cell from judged questions, one resample after the other."""
    data = lab_dataset(spark)
    cells = thresholds.grid(*_grid(spark)) if pairs is None else spark.createDataFrame(pairs, "t1 double, t2 double")
    rows, slots = (data if split is None else data.where(f"split = '{split}'")).collect(), {}
    for r in rows:
        slots.setdefault((r.kind, r.qid), []).append(r)
    who = {k: sorted(q for kind, q in slots if kind == k) for k in (0, 1)}
    rng = {s: np.random.default_rng([seed, s, 0]).multinomial(len(who[k]), np.full(len(who[k]), 1 / len(who[k])), draws) for s, k in ((0, 1), (1, 0), (2, 0))}
    for cell in cells.collect():

        def loss(r, cell=cell):
            ok = [x for x in slots[r] if x.sim is not None and x.max_s is not None and x.sim >= cell.t1 and x.max_s >= cell.t2]
            if r[0] == 0:
                return 5.0 if ok else 0.0
            gold = [x for x in ok if x.is_gold]
            return 1.0 if not ok else 5.0 if not gold else 0.0 if any(x.req_min is None or x.req_min >= cell.t2 for x in gold) else 2.0

        own = {k: np.array([loss((k, q)) for q in who[k]]) for k in (0, 1)}
        both = prior * (rng[0] @ own[1]) / len(who[1]) + (1 - prior) * (rng[1] @ own[0]) / len(who[0])
        passed = rng[2] @ (own[0] > 0) / len(who[0])
        yield (cell.t1, cell.t2), (*np.percentile(both, [5, 90, 95]), *np.percentile(passed, [5, 95])), prior * own[1].mean() + (1 - prior) * own[0].mean()


def lab_dataset(spark):
    from gleaner.queries import _dataset

    return _dataset(spark, DATA)


def test_loss_intervals(spark):
    got = {(r.t1, r.t2): (r.loss_lo, r.loss_p90, r.loss_hi, r.fp_lo, r.fp_hi) for r in QUERIES["loss_intervals"](spark, DATA).collect()}
    want = {cell: limits for cell, limits, _ in replayed(spark)}
    assert set(got) == set(want) and len(got) == 99
    for cell in got:
        assert got[cell] == pytest.approx(want[cell], abs=1e-5)


def test_final_scores(spark):
    pairs = [(0.3, 0.35), (0.34, 0.4)]
    got = {(r.split, r.t1, r.t2): r for r in QUERIES["final_scores"](spark, DATA).collect()}
    assert len(got) == 4
    for split in ("dev", "test"):
        for cell, limits, mean in replayed(spark, split, pairs):
            r = got[split, *cell]
            assert (r.loss_lo, r.loss_p90, r.loss_hi, r.fp_lo, r.fp_hi) == pytest.approx(limits, abs=1e-5) and r.loss == pytest.approx(mean)


def test_hdbscan_labels(spark, db):
    """The query hands every vector over as one group; hdbscan_points is held against the definitions in test_operators."""
    x = np.array([r[0] for r in db.execute("SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id").fetchall()])
    want, sure = hdbscan_points(x / np.linalg.norm(x, axis=1, keepdims=True), 3)
    got = sorted(QUERIES["hdbscan_labels"](spark, DATA).collect(), key=lambda r: r.id)
    assert [r.cluster for r in got] == want.tolist() and [r.probability for r in got] == pytest.approx(sure.tolist())


def test_model_evaluation(spark, db):
    items = db.execute("SELECT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL ORDER BY item_id").fetchall()
    model = HashedEmbedder(ModelSpec("hashed-256"))
    q = np.array(model.embed_batch([" ".join(t.split(" ")[:12]) for _, t in items], "query"))
    c = np.array(model.embed_batch([t for _, t in items]))
    score = np.round(q @ c.T, 6)
    ranks = {}
    for k, (i, _) in enumerate(items):
        order = sorted(range(len(items)), key=lambda j: (-score[k, j], items[j][0]))
        ranks[i] = order.index(k) + 1
    got = {r.category: r for r in QUERIES["model_evaluation"](spark, DATA).collect()}
    for name, own in (("전체", list(ranks.values())), ("0", [r for i, r in ranks.items() if i % 2 == 0]), ("1", [r for i, r in ranks.items() if i % 2])):
        assert got[name].n == len(own)
        assert (got[name].top1, got[name].top3, got[name].top5, got[name].mrr) == pytest.approx([np.mean([r <= k for r in own]) for k in (1, 3, 5)] + [np.mean([1 / r for r in own])], abs=6e-4)
