import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.quality_repeats import RepeatRules, assess, maximal_repeats, repeat_cover, repeat_quality, suffix_array


def brute_cover(ids, least):
    n, inside, best = len(ids), set(), 0
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and ids[i + k] == ids[j + k]:
                k += 1
            if k >= least:
                best = max(best, k)
                inside |= set(range(i, i + k))
    return len(inside), best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 5))
def test_cover_is_brute_force(ids, least):
    covered, longest, spans = repeat_cover(np.array(ids, np.int64), least)
    assert (covered, longest) == brute_cover(ids, least)
    assert covered == sum(b - a for a, b in spans)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array(ids):
    sa, lcp = suffix_array(np.array(ids, np.int64))
    assert sa.tolist() == sorted(range(len(ids)), key=lambda k: ids[k:])
    for k, (a, b) in enumerate(zip(sa, sa[1:], strict=False)):
        same = next((x for x in range(len(ids)) if max(a, b) + x >= len(ids) or ids[a + x] != ids[b + x]), len(ids))
        assert lcp[k] == same


def test_maximal_repeats_are_left_maximal():
    found = {(n, tuple(at.tolist())) for n, at in maximal_repeats(np.array([1, 2, 3, 9, 1, 2, 3]), 2)}
    assert found == {(3, (0, 4))}


def reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "a b c a b c", "x y é\x1cz # $%\n\n a \na\na ", "one two three four " * 30, "😀 ß <b> | x\r\nx\r\n", "a b c"])
def test_counts(text):
    assert assess(text, RepeatRules())[:5] == reference(text)


def test_verdicts():
    clean = " ".join(f"w{k}" for k in range(400))
    assert assess(clean, RepeatRules())[-1]
    half = " ".join(f"r{k}" for k in range(100))
    assert not assess(f"{half} {clean} {half}", RepeatRules(max_longest=99))[-1]
    assert assess(f"{half} {clean} {half}", RepeatRules())[-1]
    assert not assess(f"{half} mid {half} {' '.join(clean.split()[:210])}", RepeatRules(max_covered=0.4, max_repeat_percent=100))[-1]


def test_operator_edge_cases(spark):
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(1, None, 0), (2, "", 1), (None, "a b c", 2), (4, long, 3), (4, long, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = repeat_quality(docs).collect()
    assert len(got) == 5 and [r.n_words for r in got if r.doc_id == 4] == [60_000] * 2
    assert all(r.base_failed and not r.kept for r in got if r.doc_id != 4)
    assert repeat_quality(docs.limit(0)).count() == 0
