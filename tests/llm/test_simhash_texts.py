import random
from fractions import Fraction

import numpy as np
import pytest

from gleaner.llm import simhash_texts as st
from gleaner.llm.common import scratch_path
from gleaner.llm.simhash_gph import bit_moments


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"edit{rng.randrange(10**9)}"
    return out


def texts():
    rng, rows = random.Random(8), []
    for g in range(40):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(40, 300))]
        tail = ["one", "line", "that", "ends", "every", "text", "of", "all"] if g % 2 else []
        rows.append(base + tail)
        rows += [edited(rng, base, rng.randrange(1, 1 + len(base) // 25)) + tail for _ in range(6)]
    rows += [["two", "words"], ["Two", "words"], ["other"], [], []]
    return [(k, " ".join(r) or (None if k % 2 else "")) for k, r in enumerate(rows)]


def brute(rows, share=Fraction(4, 5)):
    """The least id of each component, the linked pairs, and their similarities."""
    sets, root, pairs = [shingles(t) for _, t in rows], list(range(len(rows))), {}
    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both * share.denominator >= either * share.numerator:
                pairs[b, a] = both / either if either else 1.0
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return sorted(set(root)), pairs


def test_components_against_all_pairs(spark, monkeypatch):
    rows = texts()
    expected, pairs = brute(rows)
    assert {0.8, 0.9, 1.0} <= {round(x, 1) for x in pairs.values()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowded, recall in ((4096, 0.9999), (3, 0.9999)):
        monkeypatch.setattr(st, "CROWDED", crowded)
        assert sorted(r.doc_id for r in st.keep_one_similar(docs, recall=recall).collect()) == expected


def test_unrelated_texts_stay_apart_and_recall(spark):
    """Pairs at a similarity of 0.8 to 0.85, one for each text: no text is lost, and few pairs are missed."""
    rng, rows = random.Random(4), []
    for g in range(150):
        base = [f"v{rng.randrange(2000)}" for _ in range(225)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(edited(rng, base, 4)))]
    expected, pairs = brute(rows)
    left = [r.doc_id for r in st.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(expected) <= set(left) and len(pairs) > 100
    assert len(set(left) - set(expected)) <= 0.06 * len(pairs)


def test_plans_follow_the_table(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.integers(-(2**63), 2**63, 8).tolist(),) for _ in range(600)]
    n, both = bit_moments(spark.createDataFrame(rows, "fp array<long>"), 8)
    assert n == 600 and both[3].shape == (64, 64) and abs(both[3][5, 9] / n - 0.25) < 0.1
    compared = []
    flip = st.flip_share(st.SHARE)
    for size in (10**4, 10**5, 10**6, 10**8):
        parts = st.plan(size, [b * size / n for b in both])
        miss = np.prod([1 - st.hit_share(len(p.bits), p.threshold, flip) for p in parts])
        assert miss <= 1 - st.RECALL + 1e-9
        assert len({(p.word, b) for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)
        compared.append(size / 2 * sum(st.hit_share(len(p.bits), p.threshold, 0.5) for p in parts))
    assert all(b < 0.8 * a * 10 ** (k + 1 if k == 2 else 1) for k, (a, b) in enumerate(zip(compared, compared[1:], strict=False)))


def test_wide_fingerprints():
    rng = np.random.default_rng(1)
    own = np.unique(rng.integers(1, 1 << 60, 700).astype(np.uint64))
    got = st.wide_fingerprint(own, 3)
    again = st.wide_fingerprint(own[::-1].copy(), 5)
    assert (got == again[:3]).all() and not st.wide_fingerprint(own[:0]).any()
    other = own[: len(own) * 9 // 10]
    apart = int(np.bitwise_count(got ^ st.wide_fingerprint(other, 3)).sum())
    assert apart <= st.check_limit(Fraction(4, 5), 192)
    assert st.similar(own, other) and not st.similar(own, own[:500]) and st.similar(own[:0], own[:0])


def test_edge_cases(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(9, text, 1), (3, text.upper(), 1), (3, text.upper(), 1), (5, text.replace("w7 ", "other  "), 1), (7, None, 1), (8, "", 1), (None, text, 1), (11, "one", 1), (12, " ".join(f"z{k}" for k in range(60_000)), 1), (None, "alone here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = st.keep_one_similar(docs)
    assert out.columns == ["doc_id", "text", "node"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == [11, 12, 3, 7, None]
    assert st.keep_one_similar(docs.limit(0)).count() == 0
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
