"""Quality rules with a suffix-array repetition test.

Each text is taken whole. Its words are the runs of anything but ASCII white
space. Beside the base counts, a suffix array over the words of a text gives
longest-common-prefix intervals; each interval of at least ``min_repeat`` words is
a repeated substring, kept where it cannot be extended to the left. The union of
the repeats' occurrences may cover at most ``max_covered`` of the words and the
longest repeat may have at most ``max_longest`` words.

A suffix array is only built for texts in which some window of ``min_repeat``
words occurs twice: without one no interval can reach that depth, so the verdict
is the same and most texts skip the sorting.

Edge cases: a null or empty text has no words and fails the base rule; repeated
rows each get their own row; an empty table gives an empty result; columns other
than the id and the text are not read. Rows are independent, so there is no
shuffle and no skew but for a single text's length (memory linear in it).
Words are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gleaner.llm.common import trim_memory

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class RepeatRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 10
    max_covered: float = 0.4
    max_longest: int = 150


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of an integer sequence, by prefix doubling.

    lcp[i] is the common prefix of suffixes sa[i] and sa[i + 1] (one entry fewer than sa).
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    levels, step = [rank], 1
    sa = np.argsort(rank, kind="stable")
    while step < n and rank[sa[-1]] < n:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
        levels.append(rank)
        step *= 2
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        padded, width = np.append(levels[level], 0), 1 << level
        same = (np.maximum(a, b) + width <= n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        lcp[same] += width
        a[same] += width
        b[same] += width
    return sa, lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every LCP interval with depth >= least; suffixes first..last share depth items."""
    stack: list[tuple[int, int]] = []
    edges = np.flatnonzero(np.append(lcp, 0) >= least)
    if not len(edges):
        return
    runs = np.split(edges, np.flatnonzero(np.diff(edges) > 1) + 1)
    for run in runs:
        start, values = int(run[0]), lcp[run[0] : run[-1] + 1].tolist()
        for k, depth in enumerate([*values, 0]):
            first = start + k
            while stack and stack[-1][0] > depth:
                top, first = stack.pop()
                yield top, first, start + k
            if depth >= least and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))
        stack.clear()


def maximal_repeats(ids: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(length, start positions) of the repeated substrings that no interval extends to the left or right."""
    if len(ids) < 2:
        return []
    sa, lcp = suffix_array(ids)
    found = []
    for depth, first, last in lcp_intervals(lcp, least):
        starts = sa[first : last + 1]
        before = np.where(starts > 0, ids[starts - 1], ids[0])
        if starts.min() == 0 or (before != before[0]).any():
            found.append((depth, np.sort(starts)))
    return found


def repeat_cover(ids: np.ndarray, least: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Words covered by repeats, the longest repeat, and the union of the repeats' spans."""
    repeats = maximal_repeats(ids, least)
    delta = np.zeros(len(ids) + 1, np.int64)
    for length, starts in repeats:
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + length, -1)
    inside = np.cumsum(delta[:-1]) > 0
    flips = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return int(inside.sum()), max((length for length, _ in repeats), default=0), list(zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True))


def _twice(key: np.ndarray) -> np.ndarray:
    """Which entries occur more than once."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _window(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of so many words (size - 1 fewer than words)."""
    n, out = len(h) - size + 1, np.zeros(max(len(h) - size + 1, 0), np.uint64)
    if n <= 0:
        return out
    for k in range(size):
        out ^= out >> np.uint64(29)
        out *= _ODD[0]
        out += h[k : k + n] * _ODD[1]
    return out


def assess(text: str | None, rules: RepeatRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, covered, longest, spans, kept)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        filled = [x for x in lines if x.strip()]
        dup = len(filled) - len(set(filled))
    repeated, covered, longest, spans = 0, 0, 0, []
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        twice = _twice(_window(h, 3))
        if twice.any():
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= twice
            repeated = int(inside.sum())
            if n > rules.min_repeat and _twice(_window(h, rules.min_repeat)).any():
                covered, longest, spans = repeat_cover(h.view(np.int64), rules.min_repeat)
    failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
    kept = not failed and covered <= rules.max_covered * n and longest <= rules.max_longest
    return n, chars, symbols, dup, repeated, failed, covered, longest, spans, kept


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat", "spans", "kept"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, spans array<struct<start:long,end:long>>, kept boolean"


def repeat_quality(docs: DataFrame, rules: RepeatRules = RepeatRules(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, any carried columns, the counts, the repeats' spans (word positions) and kept."""
    own = docs.select(id_col, *[c for c in carry if c != id_col])
    names = own.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    read = [*dict.fromkeys([*names, text_col])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [assess(t if isinstance(t, str) else None, rules) for t in batch[text_col]]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            out["spans"] = [[{"start": a, "end": b} for a, b in x] for x in out["spans"]]
            yield pd.concat([batch[names].reset_index(drop=True), out], axis=1)
        trim_memory()

    return docs.select(*read).mapInPandas(run, f"{fields}, {SCHEMA}")
