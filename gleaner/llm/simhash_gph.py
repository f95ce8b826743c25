"""SimHash near-duplicates by generalised pigeonhole search.

A document's fingerprint has bit b set if over half of its word shingles' 64-bit
hashes have it. Documents whose fingerprints differ in at most ``limit`` bits are
linked, and links make components.

Search. The 64 bits are grouped into m partitions of which partition i may differ
in t_i bits. If the (t_i + 1) sum to limit + 1, a linked pair differs in at most
t_i bits of some partition i (were it more everywhere, the pair would differ in
over ``limit`` bits). So it is enough to look for agreement up to t_i bits in each
partition, and the thresholds may be unequal; t_i = -1 leaves a partition out.
- Correlated bits go to the same partition: bits are grouped greedily by their
  correlation over all distinct fingerprints. Kept apart they'd make every
  partition unselective.
- m and the t_i come from a dynamic programme over the partitions that minimises
  estimated candidate pairs and index entries, for as many fingerprints as the table
  has. The estimate comes from the bits' second moments over all distinct fingerprints.
- Two values agree up to t bits if they have a masked form in common (t of the
  bits left out), so each fingerprint has C(width, t) entries in an index and the
  probes of an entry are the other fingerprints in its bucket. Every candidate is
  then verified on all 64 bits.

Scale. Copies fold into one fingerprint first, so groups of copies cost nothing.
Buckets are runs of a sorted table and are streamed. A bucket with more than
``HEAVY`` fingerprints is dealt again: its members agree in its bits, so the same
pigeonhole argument holds on the rest, with groups and thresholds planned anew from
the moments of what is crowded; buckets shrink until they're light or out of bits. A
bucket emits a spanning forest of its links, never all pairs.

Edge cases: null and empty texts have fingerprint 0, linked like any other;
repeated rows each keep their row; null ids get a component but can't name one
(its id is the smallest non-null one, null if there is none); an empty table gives
an empty result; very long texts are hashed whole, in memory that is a multiple of the
text's; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialise, scratch_scope
from gleaner.llm.components import connected_components

BITS = 64
#: Rows of one bucket that a task compares at once; larger buckets are dealt again by further bits.
HEAVY = 2000
#: What an index entry costs, which is shuffled and sorted, in comparisons of two fingerprints.
ENTRY_COST = 100.0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 without a word."""
    return _majority(shingle_hashes(text, shingle, seed))


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)))
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))


def _majority(h: np.ndarray) -> int:
    by_byte = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 400:
        counts = np.unpackbits(by_byte, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ table for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [fingerprint(t if isinstance(t, str) else None, shingle) for t in batch[text_col]]
            yield pd.DataFrame({"id": batch[id_col], "fp": np.array(made, np.uint64).view(np.int64)})

    return docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, fp long")


@dataclass(frozen=True)
class Partition:
    """Some bits of a fingerprint's word, and in how many of them two fingerprints may differ to meet."""

    bits: tuple[int, ...]
    threshold: int
    word: int = 0


def bit_moments(distinct: DataFrame, words: int = 1) -> tuple[int, list[np.ndarray]]:
    """Number of fingerprints, and for each word how many have bits a and b both set.

    distinct: fp, one long or an array of longs. Sums come from the tasks, words x 64 x 64 in all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((words, BITS, BITS)), 0
        for batch in batches:
            rows = batch["fp"].to_numpy() if words == 1 else np.array(batch["fp"].tolist())
            raw = np.ascontiguousarray(rows.astype(np.int64)).view(np.uint8).reshape(-1, words, 8)
            for start in range(0, len(raw), 1 << 13):
                x = np.unpackbits(raw[start : start + (1 << 13)], axis=2, bitorder="little").astype(np.float32)
                for w in range(words):
                    total[w] += x[:, w].T @ x[:, w]
                n += len(x)
        at = np.indices(total.shape).reshape(3, -1)
        yield pd.DataFrame({"w": np.append(at[0], -1), "a": np.append(at[1], 0), "b": np.append(at[2], 0), "n": np.append(total.ravel(), n).astype(np.int64)})

    got = distinct.select("fp").mapInPandas(run, "w int, a int, b int, n long").groupBy("w", "a", "b").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((words, BITS, BITS)), 0
    for w, a, b, c in got:
        if w < 0:
            n = int(c)
        else:
            both[w, a, b] = c
    return n, [*both]


def group_bits(n: int, both: np.ndarray, m: int, among: list[int] | None = None) -> list[list[int]]:
    """m groups of nearly equal width; each starts with a free bit and takes the free bit most correlated with it."""
    among = list(range(BITS)) if among is None else among
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(cov / scale)
    np.fill_diagonal(corr, 0)
    free, groups = np.zeros(BITS, bool), []
    free[among] = True
    for k in range(m):
        width = len(among) // m + (k < len(among) % m)
        near, group = corr[:, free].sum(1), []
        for _ in range(width):
            group.append(int(np.where(free, near, -1.0).argmax()))
            free[group[-1]] = False
            near = corr[:, group].sum(1)
        groups.append(group)
    return groups


def agree_share(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0..most of the bits, each bit given the one before it."""
    if not n:
        return np.zeros(most + 1)
    p = np.diag(both) / n
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for k, b in enumerate(bits):
        same = p[b] ** 2 + (1 - p[b]) ** 2
        if k:
            a = bits[k - 1]
            p11 = both[a, b] / n
            joint = p11**2 + (p[a] - p11) ** 2 + (p[b] - p11) ** 2 + (1 - p[a] - p[b] + p11) ** 2
            same = min(1.0, joint / max(p[a] ** 2 + (1 - p[a]) ** 2, 1e-9))
        moved = np.append(0, dist[:-1])
        dist = dist * same + moved * (1 - same)
    return np.cumsum(dist)


def allocate(n: int, both: list[np.ndarray], gain: Callable[[int, int], int], need: int, most: int, among: list[int] | None = None, groups_at_most: int = 8) -> list[Partition]:
    """The partitions and thresholds of least estimated cost, candidate pairs and index entries at ENTRY_COST each, whose
    gains sum to ``need`` at least.

    both: the moments of n fingerprints, for each of their words. gain(width, t): what a partition of so many bits gives
    at threshold t, up to ``most``. Every number of groups a word is tried; for each, a dynamic programme over the groups
    holds the least cost of every sum of gains.
    """
    best: tuple[float, list[Partition]] | None = None
    bits = BITS if among is None else len(among)
    for m in range(1, min(groups_at_most, bits) + 1):
        groups = [(w, g) for w, moments in enumerate(both) for g in group_bits(n, moments, m, among)]
        cost = np.full(need + 1, np.inf)
        cost[0] = 0
        steps = []
        for w, group in groups:
            pairs = n * max(n - 1, 0) / 2 * agree_share(n, both[w], group, min(most, len(group) - 1))
            new, pick, back = cost.copy(), np.full(need + 1, -1), np.arange(need + 1)
            for t in range(len(pairs)):
                g = min(need, gain(len(group), t))
                if g > 0:
                    own = cost + pairs[t] + ENTRY_COST * n * comb(len(group), t)
                    to, at = own[: need + 1 - g].copy(), np.arange(need + 1 - g)
                    at[-1] = need - g + int(own[need - g :].argmin())  # more than needed counts as needed
                    to[-1] = own[at[-1]]
                    less = to < new[g:]
                    new[g:][less], pick[g:][less], back[g:][less] = to[less], t, at[less]
            steps.append((pick, back))
            cost = new
        if np.isfinite(cost[need]) and (best is None or cost[need] < best[0]):
            u, parts = need, []
            for (w, group), (pick, back) in zip(groups[::-1], steps[::-1], strict=True):
                if pick[u] >= 0:
                    parts.append(Partition(tuple(sorted(group)), int(pick[u]), w))
                    u = int(back[u])
            best = (float(cost[need]), parts[::-1])
    if best is None:
        raise ValueError("the fingerprints are too short for what is needed of them")
    return best[1]


def within(n: int, both: np.ndarray, limit: int, among: list[int] | None = None) -> list[Partition]:
    """Partitions whose thresholds find every pair of one-word fingerprints that differ in at most limit bits. There are at
    most limit + 1 of them, so that a bucket that is dealt again and again runs out of bits soon."""
    return allocate(max(n, 1), [both], lambda width, t: t + 1, limit + 1, limit, among, limit + 1)


def masks_of(parts: list[Partition]) -> np.ndarray:
    """One mask for each way to leave out t of a partition's bits; entries agree on a mask's bits."""
    out = []
    for part in parts:
        for gone in combinations(part.bits, part.threshold):
            out.append(sum(1 << b for b in part.bits if b not in gone))
    return np.array(out, np.uint64)


def mix(values: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A bucket's 64-bit key. Two buckets with one key only cost some comparisons, as pairs are verified."""
    h = (values & masks) * _ODD ^ (masks * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, root) that keep the same values connected."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def bucket_links(keys: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows that follow each other under one key, as the rows' numbers. keys: sorted.
    near(at, other): which of these pairs of rows link."""
    found_u, found_v = [], []
    at, gap = np.arange(len(keys)), 1
    while len(at):
        at = at[at + gap < len(keys)]
        at = at[keys[at] == keys[at + gap]]
        close = at[near(at, at + gap)]
        if len(close):
            found_u.append(close)
            found_v.append(close + gap)
            if sum(map(len, found_u)) > 1_000_000:
                u, v = forest(np.concatenate(found_u), np.concatenate(found_v))
                found_u, found_v = [u], [v]
        gap += 1
    if not found_u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(found_u), np.concatenate(found_v))


def whole_buckets(batches: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The named columns of a stream that is sorted by the first of them, cut where its value changes."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64)] * len(columns)
    for batch in batches:
        held = [np.concatenate([a, batch[c].to_numpy(np.int64)]) for a, c in zip(rest, columns, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        rest = [a[cut:] for a in held]
        if cut:
            yield [a[:cut] for a in held]
    if len(rest[0]):
        yield rest


def _entries(rows: pd.DataFrame, masks: np.ndarray, cut: int = 16) -> Iterator[pd.DataFrame]:
    """key, mask, fp of every row under every mask."""
    fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
    for first in range(0, len(masks), cut):
        some = masks[first : first + cut]
        mask, value = np.repeat(some, len(fps)), np.tile(fps, len(some))
        yield pd.DataFrame({"key": mix(value, mask), "mask": mask.view(np.int64), "fp": value.view(np.int64)})


_ENTRY = "key long, mask long, fp long"


def _index(distinct: DataFrame, masks: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _entries(batch, masks)

    return distinct.select("fp").mapInPandas(run, _ENTRY)


def deeper(mask: int, n: int, both: np.ndarray, limit: int) -> np.ndarray:
    """Masks for buckets of about n members that agree on mask: the rest of the bits planned anew, each part added to it."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return masks_of(within(n, both, limit, rest)) | np.uint64(mask)


def _redeal(heavy: DataFrame, limit: int, most: int, total: int, both: np.ndarray) -> DataFrame:
    """heavy: the entries of crowded buckets of up to ``most`` members; both: the moments of their fingerprints, total in all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans: dict[int, np.ndarray] = {}
        for batch in batches:
            for mask, group in batch.groupby("mask"):
                own = int(np.int64(mask).view(np.uint64))
                if own not in plans:
                    plans[own] = deeper(own, most, both * (most / total), limit)
                yield from _entries(group, plans[own])

    return heavy.select("mask", "fp").mapInPandas(run, _ENTRY)


def _links(index: DataFrame, limit: int) -> DataFrame:
    """u, v from buckets that are light: a sorted stream, cut where a key ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, signed in whole_buckets(batches, ("key", "fp")):
            fps = signed.view(np.uint64)
            u, v = bucket_links(keys, lambda a, b: np.bitwise_count(fps[a] ^ fps[b]) <= limit)  # noqa: B023
            yield pd.DataFrame({"u": signed[u], "v": signed[v]})

    return index.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInPandas(run, "u long, v long")


def near_links(distinct: DataFrame, limit: int = 3, heavy: int = HEAVY) -> DataFrame:
    """u, v: links that connect all fingerprints that differ in at most limit bits. distinct: fp, each once."""
    n, both = bit_moments(distinct)
    index = _index(distinct, masks_of(within(n, both[0], limit)))
    found: DataFrame | None = None
    while True:
        index = materialise(index, "index")
        crowded = materialise(index.groupBy("key", "mask").count().where((F.col("count") > heavy) & (F.bit_count(F.col("mask")) < BITS - limit)), "crowded")
        most = crowded.agg(F.max("count")).first()[0]
        if most is None:
            links = _links(index, limit)
            return links if found is None else found.unionByName(links)
        light = _links(index.join(crowded, ["key", "mask"], "left_anti"), limit)
        found = light if found is None else found.unionByName(light)
        full = materialise(index.join(crowded, ["key", "mask"], "left_semi"), "full")
        total, own = bit_moments(full)
        index = _redeal(full, limit, int(most), total, own[0])


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp, component (the smallest id that links reach)."""
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    with scratch_scope(docs.sparkSession):
        first = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
        roots = materialise(connected_components(near_links(first, limit)), "roots")
        named = first.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("least").alias("component"))
        linked = roots.join(named, "root").select(F.col("node").alias("fp"), "component")
        # a table of its own, so that both sides of the last join are plain shuffles and a hot fingerprint's side can be split
        classes = materialise(first.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "classes", outer=True)
    return prints.join(classes, "fp").select("id", "fp", "component")
