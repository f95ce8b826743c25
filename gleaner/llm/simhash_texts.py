"""Near-duplicate texts: SimHash candidates by generalised pigeonhole, then the texts themselves.

Two texts are near-duplicates if the Jaccard similarity of their sets of five-word
shingles is at least ``SHARE``. Operator 2's search proposes the pairs and the sets
decide, so no pair is linked that isn't similar. At a similarity of 0.8 about 15 % of
fingerprint bits differ, too many for a guarantee from 64 bits; so here

- a fingerprint has ``WORDS`` words of 64 bits, each from the shingles' hashes mixed anew;
- the dynamic programme that picks the groups of bits and their thresholds is asked,
  instead of for a sum of thresholds, for partitions that together find a pair at the
  similarity asked for with probability ``RECALL`` (pairs that are closer are found more
  surely), at the least estimated cost for as many fingerprints as there are;
- a pair that meets in a bucket is a candidate if two words of the fingerprints together
  differ in no more bits than similar texts' do, which unrelated texts practically never pass;
  before the texts are compared, all words are, and bitmaps of the sets (a bit is set if an odd
  number of shingles falls on it), which differ in no more bits than the sets do in shingles.

Scale. Texts with the same words fold into one node first. Buckets are streamed, and only
members that are candidates for another are kept, never pairs of them. Crowded buckets, such as
those of a hot family of copies, aren't gathered but joined, which can be split. In each round
every bucket has a hub, the member that shares most buckets with others, every node is compared
with one hub at most, and what links counts as one from then on. Hubs follow as long as much
is linked; what is left, pairs of a bucket that links haven't connected, is compared in the end.

Edge cases: null and empty texts are alike; texts of fewer words than a shingle are one
shingle; case and white space make no difference; very long texts are hashed whole, in
memory that is a multiple of the text's; rows that repeat id and text are copies; null
ids come last; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialise, scratch_scope, trim_memory
from gleaner.llm.components import FEW, connected_components
from gleaner.llm.simhash_gph import Partition, allocate, bit_moments, bucket_links, masks_of, mix, shingle_hashes, whole_buckets

SHARE, SHINGLE = Fraction(4, 5), 5
#: Words of a fingerprint, and the probability to find a pair that is just similar enough.
WORDS, RECALL = 8, 0.97
#: Members of a bucket that are compared in one task.
CROWDED = 4096
#: Index entries of a fingerprint that are on disk at a time.
SLICE = 32
#: Longs of a set's bitmap.
MAP = 16
#: Nodes that are broadcast to pick their texts, so that the texts aren't shuffled; beyond it they are.
PICKED = 2_000_000
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """``words`` 64-bit SimHashes of a set of hashes; zeros for none."""
    n = len(hashes)
    if not n:
        return np.zeros(words, np.uint64)
    h = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    raw = (h ^ (h >> np.uint64(31))).view(np.uint8).reshape(n, words * 8)
    counts = np.zeros((words * 8, 8), np.int64)
    for start in range(0, n, 255):  # eight counters of a byte each in a long
        lanes = np.add.reduce(_LANES[raw[start : start + 255]], axis=0)
        counts += lanes.view(np.uint8).reshape(-1, 8)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").ravel().view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, share: Fraction = SHARE) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least share; two empty sets are alike."""
    both = np.sort(np.concatenate([a, b]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common * share.denominator >= share.numerator * (len(both) - common)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle, 42))


def bitmap(own: np.ndarray) -> np.ndarray:
    """MAP longs in which a bit is set if an odd number of the set's hashes falls on it."""
    odd = np.bincount((own % np.uint64(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def flip_share(share: Fraction) -> float:
    """The expected share of fingerprint bits in which sets of one size differ at a Jaccard similarity."""
    return acos(float(2 * share / (1 + share))) / pi


def hit_share(width: int, threshold: int, flip: float) -> float:
    """The probability that two fingerprints differ in at most threshold of width bits."""
    return sum(comb(width, k) * flip**k * (1 - flip) ** (width - k) for k in range(threshold + 1))


def plan(n: int, both: list[np.ndarray], share: Fraction = SHARE, recall: float = RECALL, steps: int = 300, most: int = 2) -> list[Partition]:
    """Partitions that find a pair at the given similarity with probability recall. Misses multiply, so their logarithms add up."""
    flip, unit = flip_share(share), -log(1 - recall) / steps

    def gain(width: int, t: int) -> int:
        hit = hit_share(width, t, flip)
        return steps if hit >= 1 else int(-log(1 - hit) / unit)

    return allocate(max(n, 1), both, gain, steps, most)


def check_limit(share: Fraction, bits: int = 128) -> int:
    """Bits in which similar texts' fingerprints practically never differ more: the mean and 3.5 deviations."""
    flip = flip_share(share)
    return ceil(bits * flip + 3.5 * sqrt(bits * flip * (1 - flip)))


def _may_link(a: str, b: str, words: int, share: Fraction) -> Column:
    """Whether the fingerprints, sizes and bitmaps of two nodes leave room for the similarity. Columns: fp, map and n, with the
    prefixes a and b."""
    apart = lambda c, size: sum(F.bit_count(F.col(f"{a}{c}")[k].bitwiseXOR(F.col(f"{b}{c}")[k])) for k in range(size))
    room = (F.col(f"{a}n") + F.col(f"{b}n")) * (share.denominator - share.numerator)
    return (apart("fp", words) <= check_limit(share, 64 * words)) & (apart("map", MAP) * (share.denominator + share.numerator) <= room)


def _small(df: DataFrame) -> DataFrame:
    """df as a table of its own; broadcast if its rows, which are counted, are few."""
    made = materialise(df, "small")
    return F.broadcast(made) if made.count() <= FEW else made


def _members(nodes: DataFrame, masks: list[tuple[int, int]], limit: int) -> list[DataFrame]:
    """token, node: of light buckets the members that are candidates for another, by the stars they make; of crowded ones all.
    masks: word, mask."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array(batch["fp"].tolist(), np.int64).reshape(len(batch), -1).view(np.uint64)
            for w, mask in masks:
                key = mix(fps[:, w], np.full(len(fps), mask, np.uint64)) + np.int64(w)
                yield pd.DataFrame({"token": key, "node": batch["node"], "c1": fps[:, 0].view(np.int64), "c2": fps[:, 1].view(np.int64)})
        trim_memory()

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, node, c1, c2 in whole_buckets(batches, ("token", "node", "c1", "c2")):

            def near(a: np.ndarray, b: np.ndarray, c1: np.ndarray = c1.view(np.uint64), c2: np.ndarray = c2.view(np.uint64)) -> np.ndarray:
                some = np.bitwise_count(c1[a] ^ c1[b]) <= limit
                out = np.zeros(len(a), bool)
                a, b = a[some], b[some]
                out[some] = np.bitwise_count(c1[a] ^ c1[b]).astype(np.int64) + np.bitwise_count(c2[a] ^ c2[b]) <= limit
                return out

            at, head = bucket_links(keys, near)
            heads = np.unique(head)
            rows, own = np.concatenate([at, heads]), node[np.concatenate([head, heads])]
            yield pd.DataFrame({"token": keys[rows] ^ mix(own.view(np.uint64), np.full(len(rows), 2**64 - 1, np.uint64)), "node": node[rows]})
        trim_memory()

    index = materialise(nodes.select("node", "fp").mapInPandas(entries, "token long, node long, c1 long, c2 long"), "index")
    crowded = materialise(index.groupBy("token").count().where(F.col("count") > CROWDED).select("token"), "crowded")
    light, out = index, []
    if not crowded.isEmpty():
        light = index.join(crowded, "token", "left_anti")
        out = [materialise(index.join(crowded, "token", "left_semi").select("token", "node"), "full", outer=True)]
    made = light.repartition("token").sortWithinPartitions("token", "node").mapInPandas(stars, "token long, node long")
    return [*out, materialise(made, "members", outer=True)]


class _Texts:
    """Exact comparison of pairs of nodes, whose sets of shingles are made once."""

    def __init__(self, texts: DataFrame, shingle: int, share: Fraction):
        self.texts, self.shingle, self.share = texts, shingle, share
        self.sets: DataFrame | None = None

    def _made(self, nodes: DataFrame) -> DataFrame:
        shingle = self.shingle

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(0, len(batch), 200):
                    some = batch.iloc[k : k + 200]
                    yield pd.DataFrame({"node": some["node"], "own": [shingle_set(t if isinstance(t, str) else None, shingle).tobytes() for t in some["text"]]})
            trim_memory()

        few = nodes.count() <= PICKED
        chosen = self.texts.join(F.broadcast(nodes) if few else nodes, "_h").dropDuplicates(["node"])
        return materialise(chosen.select("node", "text").mapInPandas(run, "node long, own binary"), "sets")

    def add(self, nodes: DataFrame) -> None:
        """nodes: node, _h; those whose sets there are already may be among them."""
        if self.sets is None:
            self.sets = self._made(nodes)
        else:
            new = materialise(nodes.join(self.sets.select("node"), "node", "left_anti"), "nodes")
            if not new.isEmpty():
                self.sets = self.sets.unionByName(self._made(new))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The u, v of pairs that are similar."""
        share = self.share

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                holds = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), share) for a, b in zip(batch["a"], batch["b"], strict=True)]
                yield batch.loc[np.array(holds, bool), ["u", "v"]]
            trim_memory()

        first = pairs.join(self.sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u")
        both = first.join(self.sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
        return materialise(both.select("u", "v", "a", "b").mapInPandas(test, "u long, v long"), "links")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def similar_roots(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, share: Fraction = SHARE, recall: float = RECALL, rounds: int = 6) -> DataFrame:
    """node, root of the nodes that links connect. nodes: node, fp, map, n and _h, each node once; texts: _h, text."""
    words = len((nodes.select("fp").first() or [[0] * WORDS])[0])
    n, both = bit_moments(nodes, words)
    limit = check_limit(share)
    masks = [(p.word, int(m)) for p in plan(n, both, share, recall) for m in masks_of([p])]
    members: list[DataFrame] = []
    for k in range(0, len(masks), SLICE):
        with scratch_scope(nodes.sparkSession):
            members += _members(nodes, masks[k : k + SLICE], limit)
    met = members[0]
    for more in members[1:]:
        met = met.unionByName(more)
    met = materialise(met.distinct(), "met")
    weight = met.join(_small(met.groupBy("token").count()), "token").groupBy("node").agg(F.sum("count").alias("weight"))
    entries = materialise(met.join(weight, "node").join(nodes.select("node", "fp", "map", "n"), "node"), "entries")
    exact, tested = _Texts(texts, shingle, share), []
    roots = entries.select("node", F.col("node").alias("root")).limit(0)  # of the nodes that have links

    def rooted(df: DataFrame, node: str, root: str) -> DataFrame:
        own = roots.select(F.col("node").alias(node), F.col("root").alias(root))
        return df.join(own, node, "left").withColumn(root, F.coalesce(root, node))

    def untested(pairs: DataFrame) -> DataFrame:
        done = tested[0] if tested else None
        for more in tested[1:]:
            done = done.unionByName(more)
        return materialise(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), "pairs")

    def settle(pairs: DataFrame) -> int:
        """Tests pairs and merges the roots of those that link; how many do."""
        nonlocal roots
        tested.append(pairs)
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        exact.add(nodes.select("node", "_h").join(_small(ends), "node", "left_semi"))
        found = exact.similar(pairs)
        grown = found.count()
        if grown:
            between = rooted(rooted(found, "u", "a"), "v", "b").select(F.col("a").alias("u"), F.col("b").alias("v"))
            merged = materialise(connected_components(between), "merged").select(F.col("node").alias("root"), F.col("root").alias("to"))
            old = roots.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            new = merged.select(F.col("root").alias("node"), F.col("to").alias("root")).join(old.select("node"), "node", "left_anti")
            roots = materialise(old.unionByName(new), "roots")
        return grown

    def live() -> DataFrame:
        """The entries in buckets of several roots."""
        own = rooted(entries, "node", "root")
        several = own.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
        return materialise(own.join(_small(several), "token"), "live")

    kept = ("node", "fp", "map", "n", "weight", "root")
    first, used = 0, []
    for _ in range(rounds):
        own = live()
        free = own
        for hubs in used:
            free = free.join(hubs, "node", "left_anti")
        hub = F.max_by(F.struct(*kept), F.struct("weight", "node"))
        hubs = _small(free.groupBy("token").agg(hub.alias("h")).select("token", *[F.col(f"h.{c}").alias(f"hub_{c}") for c in kept]))
        near = own.join(hubs, "token").where((F.col("root") != F.col("hub_root")) & _may_link("", "hub_", words, share))
        one = near.groupBy("node").agg(F.max(F.struct("hub_weight", "hub_node")).alias("h"))
        pairs = untested(one.select("node", F.col("h.hub_node").alias("hub_node")).select(*_pair("node", "hub_node")).distinct())
        if pairs.isEmpty():
            break
        grown, first = settle(pairs), first or pairs.count()
        if grown * 50 < first:
            break
        used.append(_small(hubs.select(F.col("hub_node").alias("node")).distinct()))
    # pairs of a bucket that links haven't connected: all rows against those outside the largest root there
    rest = live()
    sizes = rest.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = materialise(rest.join(_small(sizes), "token"), "rest")
    other = rest.where("root <> main").select("token", *[F.col(c).alias(f"o_{c}") for c in kept])
    near = rest.join(other, "token").where((F.col("root") != F.col("o_root")) & _may_link("", "o_", words, share))
    pairs = untested(near.select(*_pair("node", "o_node")).distinct())
    if not pairs.isEmpty():
        settle(pairs)
    return roots


def keep_one_similar(docs: DataFrame, shingle: int = SHINGLE, share: Fraction = SHARE, recall: float = RECALL, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component: that with the smallest id (nulls last).

    Rows that repeat id and text are copies like any others. Column names of docs are free.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_c{k}" for k in range(len(names))])
    own_id, own_text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    keyed = plain.withColumn("_h", F.xxhash64(own_text, F.lit(2)))
    kind = keyed.schema[own_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            node, fps, maps, sizes = [], [], [], []
            for t in batch[own_text]:
                t = t if isinstance(t, str) else ""
                node.append(xxhash.xxh64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), 7))
                own = shingle_set(t, shingle)
                fps.append(wide_fingerprint(own, words).view(np.int64))
                maps.append(bitmap(own))
                sizes.append(len(own))
            yield pd.DataFrame({"id": batch[own_id], "_h": batch["_h"], "node": np.array(node, np.uint64).view(np.int64), "fp": fps, "map": maps, "n": sizes})
        trim_memory()

    with scratch_scope(docs.sparkSession):
        keys = materialise(keyed.select(own_id, "_h", own_text).mapInPandas(run, f"id {kind}, _h long, node long, fp array<long>, map array<long>, n long"), "keys")
        nodes = materialise(keys.groupBy("node").agg(F.first("fp").alias("fp"), F.first("map").alias("map"), F.first("n").alias("n"), F.min("_h").alias("_h")), "distinct")
        roots = similar_roots(nodes, keyed.select("_h", F.col(own_text).alias("text")), shingle, share, recall)
        rooted = keys.select("id", "_h", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_h")).alias("best"))
        kept = materialise(best.select(F.col("best.id").alias("_id"), F.col("best._h").alias("_kh")), "kept", outer=True)
        repeated = not keys.groupBy("id", "_h").count().where("count > 1").isEmpty()
    left = keyed.join(kept, keyed[own_id].eqNullSafe(kept["_id"]) & (keyed["_h"] == kept["_kh"]), "left_semi")
    if repeated:
        left = left.dropDuplicates([own_id, "_h"])
    return left.drop("_h").toDF(*names)
