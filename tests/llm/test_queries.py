"""The registered queries over the smallest tables: their contracts' columns, and SQL or brute force."""

import os
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from gleaner.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("GLEANER_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.fixture(scope="module")
def docs(db):
    return {r[0]: r[1:] for r in db.execute("SELECT doc_id, text, lang, source, toxic, quality FROM documents LEFT JOIN labels USING (doc_id)").fetchall()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    rel = db.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(rel.fetchall(), key=str)


def rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


def test_components(spark, docs):
    got = rows(spark, "op2_simhash_gph")
    assert {r.doc_id for r in got} == set(docs) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)
    fp = {r.doc_id: int(r.fingerprint, 16) for r in got}
    comp = {r.doc_id: r.component_id for r in got}
    for a in fp:
        assert comp[a] <= a and comp[comp[a]] == comp[a]
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                assert comp[a] == comp[b]


def test_mix(spark, docs):
    got, by = rows(spark, "op3_mixing_tree"), defaultdict(list)
    for r in got:
        assert r.size == len((docs[r.doc_id][0] or "").encode().split()) and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        by[docs[r.doc_id][2]].append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own) and abs(sum(r.taken for r in own) - own[0].target) < 0.05 * own[0].target


@pytest.mark.parametrize(("name", "at", "least"), [("op4_language_filters", 1, 0.9), ("op5_pu_toxicity", 3, 0.8), ("op10_byte_cnn", 4, 0.75)])
def test_held_out(spark, docs, name, at, least):
    got = rows(spark, name)
    held = {r.doc_id for r in got if r.held_out}
    modulus, rest = (4, 2) if name.startswith("op10") else (5, 0)
    assert held == {i for i in docs if zlib.crc32(str(i).encode()) % modulus == rest}
    said = [(r.lang_pred if at == 1 else r.predicted, docs[r.doc_id][at]) for r in got if r.doc_id in held and docs[r.doc_id][at] is not None]
    assert sum(a == b for a, b in said) >= least * len(said)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(docs)


def test_quality_rules(spark, docs):
    for r in rows(spark, "op8_suffix_repeats"):
        n = len((docs[r.doc_id][0] or "").encode().split())
        assert r.n_words == n and r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n) and (r.kept <= (not r.base_failed))


def test_packing(spark, docs):
    got, by = rows(spark, "op9_hilbert_packing"), defaultdict(int)
    for r in got:
        by[r.doc_id] += r.length
    assert by == {r.doc_id: r.doc_tokens for r in got} and set(by) == set(docs)
    assert sum(by.values()) > 0.99 * 4096 * max(r.sequence_id for r in got)
