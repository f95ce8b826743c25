"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, ... and share
all words by weight. A target stops at ``most`` times its source's words, and what
lies above is shared by weight among the others until none is above.

Draws. A source's documents are hashed into blocks; their size follows the table's, so that
small tables too have many (see ``MixSettings``). A target of p whole passes over its source
and a rest takes every block p times, then the first blocks of a seeded permutation until
little of the rest is left; of the next few blocks documents are taken one by one, so the
words taken miss the target by less than the smallest document left out of them, mostly by
far less.

Shards. The block quotas of all sources are dealt to the output shards by a
binary tree: at each node the left half's quotas are one multivariate-
hypergeometric draw from the node's quotas, so every shard gets a random, exact
and disjoint part of each source. A shard's blocks are a run of the source's
permuted blocks; within a shard documents are ordered by a seeded hash.

All random choices are functions of the seed and the data, so reruns agree, in
whatever order tasks run. Only one number per source and the tree's quotas are on the
driver: shards x sources numbers, at most ``QUOTAS``; with more sources shards are larger. The running sums over a source's blocks are taken in
two levels of at most ``_RUN`` expected blocks, so a hot source's blocks don't meet
in one task.

The blocks' shares are joined to the documents without moving them while the blocks are few
enough to be broadcast, which is counted; beyond that the join shuffles.

Edge cases: a null text has size 0 and is taken 0 times in words; a null source is
a source of its own, after the others; repeated rows share a block and are taken
alike; sources without a word have target 0; a text longer than a block is a block's only
content or nearly, and is taken whole or left; an empty table gives an empty result;
columns other than those named are carried only where asked for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, materialise

_RUN = 1024
#: Tables of at most so many rows (blocks, chosen documents, sources; some 100 bytes each) are broadcast; larger ones shuffle.
_BROADCAST_ROWS = 200_000
COPIES = "array<struct<epoch:int,shard:int>>"


#: Numbers that the tree may have on the driver and in tasks.
QUOTAS = 1 << 22


@dataclass(frozen=True)
class MixSettings:
    """block_words and shard_words are upper bounds; tables of fewer words have ``least_shards`` shards of ``shard_blocks`` blocks,
    and about ``fill_blocks`` blocks, or ``fill_words`` words if those are more, around the rest's end are taken by documents."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    block_words: int = 1 << 18
    shard_words: int = 1 << 26
    least_shards: int = 16
    shard_blocks: int = 16
    fill_blocks: int = 8
    fill_words: int = 1 << 13
    seed: int = 3

    def of(self, words: int, sources: int) -> tuple[int, int]:
        """Words of a shard and of a block for a table."""
        shard = max(1, min(self.shard_words, words // self.least_shards))
        shard = max(shard, -(-words * sources // QUOTAS))
        return shard, max(1, min(self.block_words, shard // self.shard_blocks))


@dataclass(frozen=True)
class Source:
    name: str | None
    words: int
    target: float
    blocks: int
    passes: int
    rest: int


def share_targets(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Share the sum of sizes by weight; none above most times its size."""
    targets, left = [0.0] * len(sizes), float(sum(sizes))
    active = list(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        above = [i for i in active if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in active:
                targets[i] = left * weights[i] / total
            break
        for i in above:
            targets[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in above)
        active = [i for i in active if i not in set(above)]
    return targets


def plan_sources(totals: list[tuple[str | None, int]], settings: MixSettings) -> list[Source]:
    block_words = settings.of(sum(n for _, n in totals), len(totals))[1]
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    targets = share_targets([n for _, n in ordered], [settings.weights[k % len(settings.weights)] for k in range(len(ordered))], settings.most)
    out = []
    for (name, n), target in zip(ordered, targets, strict=True):
        whole = min(round(target), settings.most * n)
        passes, rest = divmod(whole, n) if n else (0, 0)
        out.append(Source(name, n, target, max(1, ceil(n / block_words)), passes, rest))
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: each node of a binary tree draws its left half's quotas from its own."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(own: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = own
            return
        middle = (first + last) // 2
        n = int(own.sum()) * (middle - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(own, n, method="marginals")
        node(left, first, middle)
        node(own - left, middle, last)

    node(quotas.astype(np.int64), 0, shards)
    return out


def _numbered(docs: DataFrame, sources: list[Source]) -> DataFrame:
    """docs with _s, the number of the source, and _blocks, how many blocks it has."""
    spark = docs.sparkSession
    rows = [(k, s.name, s.blocks) for k, s in enumerate(sources)]
    named = spark.createDataFrame(rows, "_s int, _name string, _blocks long")
    return docs.join(_small(named, len(rows)), docs["_source"].eqNullSafe(named["_name"])).drop("_name")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def _hash(*cols: Column | int) -> Column:
    return F.xxhash64(*[c if isinstance(c, Column) else F.lit(c) for c in cols])


def sized(docs: DataFrame, settings: MixSettings, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with _source, _size (words) and _h (a seeded hash of id and text)."""
    return docs.withColumns({
        "_source": F.col(source_col).cast("string"),
        "_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "_h": _hash(F.col(id_col).cast("string"), F.col(text_col), settings.seed),
    })


def _block_copies(blocks: DataFrame, sources: list[Source], settings: MixSettings) -> DataFrame:
    """_s, _block, copies (epoch, shard) and fill: the words to take of its source's blocks that are only partly taken."""
    total = sum(s.words for s in sources)
    shard_words, block_words = settings.of(total, len(sources))
    reach = max(block_words * settings.fill_blocks, settings.fill_words) // 2 if block_words < settings.block_words else 0
    words = Window.partitionBy("_s", "_run").orderBy("_p", "_block")
    runs = blocks.groupBy("_s", "_run").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy("_s").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_s", "_run", F.coalesce(F.sum("w").over(over), F.lit(0)).alias("w0"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("c0"))
    ranked = blocks.withColumns({"_end": F.sum("words").over(words.rowsBetween(Window.unboundedPreceding, 0)), "_rank": F.row_number().over(words) - 1}).join(runs, ["_s", "_run"])
    rest = {k: s.rest for k, s in enumerate(sources)}
    rests = blocks.sparkSession.createDataFrame([*rest.items()], "_s int, rest long")
    end = F.col("_end") + F.col("w0")
    near = (end - F.col("words") < F.col("rest") + reach) & (F.col("rest") > 0)
    state = F.when((end <= F.col("rest") - reach) & (F.col("words") > 0), 1).when(near, 2).otherwise(0)
    ranked = ranked.join(rests, "_s").select("_s", "_block", (F.col("_rank") + F.col("c0")).alias("rank"), state.alias("state"), end.alias("end"), "rest")
    # what the blocks that are taken whole leave of the rest
    full = ranked.groupBy("_s").agg(F.coalesce(F.max(F.when(F.col("state") == 1, F.col("end"))), F.lit(0)).alias("full"))
    ranked = materialise(ranked.join(full, "_s").select("_s", "_block", "rank", "state", (F.col("rest") - F.col("full")).alias("fill")), "blocks")
    counts = {r["_s"]: r for r in ranked.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("state") > 0).cast("long")).alias("partial")).collect()}
    n = [int(counts[k]["n"]) if k in counts else 0 for k in range(len(sources))]
    quotas = np.array([s.passes * n[k] + (int(counts[k]["partial"]) if k in counts else 0) for k, s in enumerate(sources)], np.int64)
    shards = max(1, ceil(sum(s.target for s in sources) / shard_words))
    ends = np.cumsum(split_quotas(quotas, shards, settings.seed), axis=0)
    passes = [s.passes for s in sources]
    steps = [[next((m for m in range(max(1, n_b * 2 // 3 + e), 2 * n_b + 2) if gcd(m, n_b) == 1), 1) if n_b else 1 for e in range(settings.most)] for n_b in n]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for s, rank, state in zip(batch["_s"], batch["rank"], batch["state"], strict=True):
                draws = [(e, e * n[s] + (rank * steps[s][e] + e) % n[s]) for e in range(passes[s])]
                if state:
                    draws.append((passes[s], passes[s] * n[s] + rank))
                made.append([{"epoch": e, "shard": int(np.searchsorted(ends[:, s], at, side="right"))} for e, at in draws])
            yield pd.DataFrame({"_s": batch["_s"], "_block": batch["_block"], "copies": made, "fill": batch["fill"].where(batch["state"] == 2)})

    return ranked.mapInPandas(deal, f"_s int, _block long, copies {COPIES}, fill double").withColumn("fill", F.col("fill").cast("long"))


def first_fit(sizes: list[int], fill: int) -> list[bool]:
    """In the given order take what still fits; then the one exchange, or the one more, that comes nearest to fill."""
    taken, left = [], fill
    for n in sizes:
        taken.append(n <= left)
        left -= n if n <= left else 0
    spare = sorted((n, k) for k, n in enumerate(sizes) if not taken[k])
    if not left or not spare:
        return taken
    # (distance from fill, what goes, what comes): nothing, the smallest spare one, or a taken one for a larger spare one
    best = min((left, -1, -1), (abs(left - spare[0][0]), -1, spare[0][1]))
    for k, n in enumerate(sizes):
        if taken[k]:
            at = bisect_right(spare, (n + left, len(sizes)))
            for m, j in spare[max(0, at - 1) : at + 1]:
                best = min(best, (abs(left - (m - n)), k, j))
    if best[1] >= 0:
        taken[best[1]] = False
    if best[2] >= 0:
        taken[best[2]] = True
    return taken


def _filled(partial: DataFrame) -> DataFrame:
    """_s, _h of the documents that fill their source's partly taken blocks: at most block_words of them, as each has a word."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_h"], kind="stable")
        return group[first_fit(group["words"].tolist(), int(group["fill"].iloc[0]))][["_s", "_h"]]

    return partial.where("_size > 0").groupBy("_s", "_h").agg(F.sum("_size").alias("words"), F.first("fill").alias("fill")).groupBy("_s").applyInPandas(run, "_s int, _h long")


def mix_sources(docs: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target, copies (one entry for each time it is taken, with its
    epoch and shard), order (its place within a shard, by hash), taken (words) and the carried columns."""
    base = sized(docs.select(*dict.fromkeys([id_col, text_col, source_col, *carry])), settings, id_col, text_col, source_col)
    keep = [*dict.fromkeys([id_col, *carry])]
    narrow = materialise(base.select("_source", "_size", "_h", *([id_col] if keep == [id_col] else [])), "sizes")
    if keep == [id_col]:
        base = narrow
    totals = [(r[0], int(r[1])) for r in narrow.groupBy("_source").agg(F.sum("_size")).collect()]
    sources = plan_sources(totals, settings)
    block = F.pmod(F.col("_h"), F.col("_blocks"))
    placed = _numbered(narrow, sources).withColumn("_block", block)
    p = _hash(F.col("_s"), F.col("_block"), settings.seed)
    runs = F.ceil(F.col("_blocks") / _RUN).cast("long")
    stats = placed.groupBy("_s", "_block", "_blocks").agg(F.sum("_size").alias("words")).withColumn("_p", p).withColumn("_run", F.shiftrightunsigned("_p", 33) * runs / F.lit(1 << 31)).withColumn("_run", F.floor("_run"))
    dealt = materialise(_block_copies(stats.select("_s", "_block", "_run", "_p", "words"), sources, settings), "copies")
    chosen = materialise(_filled(placed.join(dealt.where("fill is not null").select("_s", "_block", "fill"), ["_s", "_block"])), "filled").withColumn("_in", F.lit(True))
    n_chosen, n_blocks = chosen.count(), sum(s.blocks for s in sources)
    facts = docs.sparkSession.createDataFrame([(k, s.words, s.target, s.passes) for k, s in enumerate(sources)], "_s int, source_size long, target double, _passes int")
    rows = _numbered(base, sources).withColumn("_block", block).join(_small(dealt, n_blocks), ["_s", "_block"]).join(_small(facts, len(sources)), "_s").join(_small(chosen, n_chosen), ["_s", "_h"], "left")
    # a document of a partly taken block has the last copy only if it was chosen
    copies = F.when(F.col("fill").isNull() | F.coalesce("_in", F.lit(False)), F.col("copies")).otherwise(F.filter("copies", lambda c: c["epoch"] < F.col("_passes")))
    return rows.select(*keep, F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), _hash(F.col("_h"), settings.seed + 1).alias("order")).withColumn("taken", F.col("size") * F.size("copies"))


def mix_place(order: Column, epoch: Column, seed: int = MixSettings.seed) -> Column:
    """A copy's place in its shard: shards are read in ascending order of it."""
    return _hash(order, epoch, seed + 2)


def mixture(mixed: DataFrame, seed: int = MixSettings.seed) -> DataFrame:
    """The mix itself: a row for each copy, with shard and epoch, dealt by shard and shuffled inside it by a seeded hash.

    mixed: what mix_sources returns. A shard's rows are sorted by their place; ranges of shard and place are dealt out, so
    a partition is a run of the mix, whatever a shard's size.
    """
    each = mixed.withColumn("_copy", F.explode("copies")).drop("copies", "taken")
    placed = each.withColumns({"shard": F.col("_copy.shard"), "epoch": F.col("_copy.epoch"), "place": mix_place(F.col("order"), F.col("_copy.epoch"), seed)})
    return placed.drop("_copy", "order").repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
