"""Exact top-k inner-product search by pivot-table elimination.

Inner products become distances: with M the largest norm, a vector x gets one more
coordinate sqrt(M^2 - |x|^2) and a query q gets 0 there, so that the squared distance is
M^2 + |q|^2 - 2 x.q: the nearest has the highest score. A table holds each vector's
distances to ``pivots`` pivots. By the triangle inequality the distance of q and x is at
least max_p |d(q, p) - d(x, p)|, which caps their score. Candidates are evaluated in
the order of that cap until it falls below the k-th score found: the result is exact.

Plan. Equal vectors fold into one, with the k + 1 smallest of their ids (no more can
matter). Vectors are range-sorted by nearest pivot and distance and packed into blocks
with their pivot table; a block's smallest and largest distances to each pivot cap the
scores of all of it, and those of a page of blocks cap the page. Each query first searches
its own block in the order of caps, which gives a score to beat. Pages, then blocks, whose
cap doesn't reach that score are never joined to the query; in the others candidates are
evaluated in the order of their caps. Partial results are the best k + 1 of a pair, merged by
a window whose group limit runs before the shuffle. Nothing but the pivots, the largest
norm, the pages' caps and counts comes to the driver.

Components are floor(256 * x); vectors of different lengths are not compared. Scores are
exact: products run in float64 where every partial sum is an integer below 2**53, else
in 64-bit integers, else in integers of any size. A score beyond a 64-bit integer is given as
the nearest one. Vectors of a squared norm of 2**62 or more would make every cap useless, so
they stand in blocks of their own that have none and are always evaluated.

Edge cases: vectors that are null, empty or hold a null or non-finite component, and rows
without an id take no part; repeated rows (same id and vector) count once; ties go
to the smaller id; with fewer candidates than k all are returned; an empty table gives
an empty result; columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import hash_share, materialise

BLOCK, QUERIES, STEP = 4096, 512, 512
#: Range partitions of blocks to a page, and pages at most.
PAGE, PAGES = 32, 100_000
#: Squared norms from which a vector has no cap.
HUGE = 2.0**62
_SLACK = 1e-6  # relative, for rounding in the caps


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, vec (whole numbers as little-endian float64, in binary), d, h1, h2 (a 128-bit hash of vec) of the rows that take part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(np.floor(np.clip(np.asarray(v, np.float64), -_MOST / scale, _MOST / scale) * scale) + 0.0).astype("<f8").tobytes() for v in batch["v"]]
            yield pd.DataFrame({"id": batch["id"], "vec": out, "d": [len(v) for v in batch["v"]]})

    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)
    made = rows.where(whole).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).mapInPandas(run, "id long, vec binary, d int")
    return made.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})


#: The largest finite double.
_MOST = float(np.finfo(np.float64).max)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x, which hold whole numbers: exact, or the nearest 64-bit integer."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    size_q, size_x = np.abs(q).max(1), np.abs(x).max(1)
    with np.errstate(over="ignore"):
        most = float(size_q.max()) * float(size_x.max()) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    big_q, big_x = size_q * np.sqrt(q.shape[1]) >= 2.0**31, size_x * np.sqrt(x.shape[1]) >= 2.0**31
    out = np.empty((len(q), len(x)), np.int64)
    out[np.ix_(~big_q, ~big_x)] = _products(q[~big_q], x[~big_x])

    def slow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        whole = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
        exact = whole(a) @ whole(b).T
        return np.array([[min(max(c, -(2**63)), 2**63 - 1) for c in row] for row in exact], np.int64).reshape(exact.shape)

    if big_q.any():
        out[big_q] = slow(q[big_q], x)
    if big_x.any():
        out[np.ix_(~big_q, big_x)] = slow(q[~big_q], x[big_x])
    return out


def _square(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * x).sum(1)


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Spread-out rows of a sample: each next one is the farthest from those before."""
    x = sample.astype(np.float64)
    first = int(((x - x.mean(0)) ** 2).sum(1).argmax())
    at, near = [first], ((x - x[first]) ** 2).sum(1)
    while len(at) < min(pivots, len(x)):
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def pivot_distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances of rows with extra coordinate lift to the pivots, which carry theirs."""
    own = np.sqrt(np.maximum(top - (pivots**2).sum(1), 0))
    x = np.where(_square(x)[:, None] < HUGE, x, 0.0)  # rows without caps have no use for theirs
    square = (x**2).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots**2).sum(1)[None] + (lift[:, None] - own[None]) ** 2
    return np.sqrt(np.maximum(square, 0))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - _square(x), 0))


def _rows(raw: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(-1, d)


def score_caps(q: np.ndarray, q_table: np.ndarray, low: np.ndarray, high: np.ndarray, top: float) -> np.ndarray:
    """The highest score that query rows can reach with rows whose pivot distances lie in low..high; low is -inf where there are no caps."""
    gap = np.zeros((len(q), len(low)))
    for p in range(q_table.shape[1]):
        a = q_table[:, p, None]
        np.maximum(gap, np.maximum(low[None, :, p] - a, a - high[None, :, p]), out=gap)
    square = _square(q)
    cap = (top + np.minimum(square, HUGE)[:, None] - gap**2) / 2
    cap += _SLACK * (top + np.minimum(square, HUGE)[:, None]) + 1e-3
    cap[square >= HUGE] = np.inf
    cap[:, np.isneginf(low).any(1)] = np.inf
    return cap


def _bounds(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distances to the pivots, as low and high; -inf where the row has no cap."""
    free = (_square(x) >= HUGE)[:, None]
    return np.where(free, -np.inf, table), np.where(free, np.inf, table)


def search_block(q: np.ndarray, q_table: np.ndarray, beat: np.ndarray, x: np.ndarray, x_table: np.ndarray, copies: np.ndarray, k: int, top: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row, the candidates' numbers and scores that can be among its k best; copies: rows each stands for.

    Candidates are taken in the order of their caps, STEP at a time, until the next cap is below the k-th score.
    """
    caps = score_caps(q, q_table, *_bounds(x, x_table), top)
    for i in range(len(q)):
        order = np.argsort(-caps[i], kind="stable")
        floor, at, kept, scores = float(beat[i]), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < len(order) and caps[i, order[at]] >= floor:
            some = order[at : at + STEP]
            some = some[caps[i, some] >= floor]
            kept, scores = np.append(kept, some), np.append(scores, _products(q[i : i + 1], x[some])[0])
            best = np.lexsort((kept, -scores))
            reach = int(np.searchsorted(np.cumsum(copies[kept[best]]), k))
            if reach < len(best):
                last = scores[best[reach]]
                keep = scores >= last
                kept, scores, floor = kept[keep], scores[keep], max(floor, float(last))
            at += STEP
        keep = scores >= floor
        yield i, kept[keep], scores[keep]


def top_inner_products(rows: DataFrame, is_query: Column, k: int = 5, pivots: int = 16, sample: int = 4000, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), id, score: each query's k best among all other rows. is_query is over a column ``id``."""
    vectors = materialise(integer_vectors(rows, id_col, vector_col), "vectors").dropDuplicates(["id", "h1", "h2"])
    vectors = materialise(vectors.withColumn("query", F.coalesce(is_query, F.lit(False))), "unique")
    least = Window.partitionBy("h1", "h2").orderBy("id")
    few = vectors.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.first("d").alias("d"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = vectors.where("query").select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    distinct = materialise(few.join(asked, ["h1", "h2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "distinct_vectors")
    found = [_search(distinct.where(F.col("d") == d), d, n, k, pivots, sample, block) for d, n in sorted((r[0], r[1]) for r in distinct.groupBy("d").count().collect())]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    per_vector = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    best = hits.withColumn("r", F.row_number().over(per_vector)).where(F.col("r") <= k + 1).drop("r")
    asking = vectors.where("query").select(F.col("id").alias("query_id"), "h1", "h2")
    per_query = Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "id")
    ranked = asking.join(best, ["h1", "h2"]).where("id <> query_id").withColumn("rank", F.row_number().over(per_query))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _search(distinct: DataFrame, d: int, n: int, k: int, pivots: int, sample: int, block: int) -> DataFrame:
    """h1, h2, id, score for the asked vectors of one length."""

    def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = 0.0
        for batch in batches:
            if len(batch):
                square = _square(_rows(batch["vec"], d))
                most = max(most, float(square[square < HUGE].max(initial=0)))
        yield pd.DataFrame({"top": [most]})

    top = float(distinct.select("vec").mapInPandas(norms, "top double").agg(F.max("top")).first()[0] or 0.0)
    drawn = distinct.where(hash_share(F.col("h1"), min(1.0, sample / n), 7)).orderBy("h1", "h2").limit(2 * sample).select("vec").collect() or distinct.orderBy("h1", "h2").limit(1).select("vec").collect()
    some = _rows([bytes(r[0]) for r in drawn], d)
    some = some[_square(some) < HUGE]
    stand = choose_pivots(some if len(some) else np.zeros((1, d)), pivots)
    m = len(stand)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _rows(batch["vec"], d)
                table = pivot_distances(x, _lift(x, top), stand, top)
                free = _square(x) >= HUGE
                yield batch.assign(nearest=np.where(free, -1, table.argmin(1)).astype("int32"), far=np.where(free, 0.0, table.min(1)))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, rest = TaskContext.get().partitionId(), 0, None

        def pack(b: pd.DataFrame) -> pd.DataFrame:
            x = _rows(b["vec"], d)
            table = pivot_distances(x, _lift(x, top), stand, top)
            own = np.flatnonzero(b["asked"].to_numpy(bool))
            copies = np.array([len(i) for i in b["ids"]])
            to_q = pivot_distances(x[own], np.zeros(len(own)), stand, top)
            beat = np.full(len(own), -np.inf)
            # its own block first, in the order of caps: the k-th score there, but for one row of its own
            for j, at, score in search_block(x[own], to_q, beat.copy(), x, table, copies, k + 1, top):
                c = copies[at].copy()
                c[at == own[j]] -= 1
                order = np.argsort(-score, kind="stable")
                reach = int(np.searchsorted(np.cumsum(c[order]), k))
                if reach < len(order):
                    beat[j] = score[order[reach]]
            low, high = _bounds(x, table)
            ids = np.concatenate([np.asarray(i, "<i8") for i in b["ids"]])
            return pd.DataFrame([{
                "block": (part << 32) + number, "vecs": x.tobytes(), "table": table.tobytes(), "copies": copies.astype("<i4").tobytes(), "ids": ids.tobytes(),
                "low": low.min(0).tobytes(), "high": high.max(0).tobytes(), "asked": len(own), "q": x[own].tobytes(), "q_table": to_q.tobytes(), "beat": beat.tobytes(),
                "q1": b["h1"].to_numpy(np.int64)[own].tobytes(), "q2": b["h2"].to_numpy(np.int64)[own].tobytes(),
            }])

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= block:
                yield pack(rest.iloc[:block])
                rest, number = rest.iloc[block:].reset_index(drop=True), number + 1
        if rest is not None and len(rest):
            yield pack(rest)

    table = materialise(distinct.mapInPandas(placed, "h1 long, h2 long, vec binary, d int, ids array<long>, asked boolean, nearest int, far double"), "placed")
    ordered = table.repartitionByRange(max(1, -(-n // (4 * block))), "nearest", "far", "h1").sortWithinPartitions("nearest", "far", "h1", "h2")
    blocks = materialise(ordered.mapInPandas(packed, "block long, vecs binary, table binary, copies binary, ids binary, low binary, high binary, asked int, q binary, q_table binary, beat binary, q1 binary, q2 binary"), "blocks")

    # queries in groups, block summaries in pages of neighbouring partitions; a group meets the pages whose caps it reaches
    span = max(PAGE, -(-n // (4 * block * PAGES)))
    page = F.floor(F.shiftright("block", 32) / span).cast("int")

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, own in batch.groupby("page"):
                low, high = (np.array([np.frombuffer(v) for v in own[c]]) for c in ("low", "high"))
                yield pd.DataFrame([{"page": p, "low": low.min(0).tobytes(), "high": high.max(0).tobytes()}])

    paged = blocks.withColumn("page", page)
    ends = paged.select("page", "low", "high").mapInPandas(edges, "page int, low binary, high binary").toPandas()
    by_page = {p: (np.array([np.frombuffer(v) for v in own["low"]]).min(0), np.array([np.frombuffer(v) for v in own["high"]]).max(0)) for p, own in ends.groupby("page")}
    page_ids = sorted(by_page)
    page_low, page_high = (np.array([by_page[p][i] for p in page_ids]).reshape(-1, m) for i in (0, 1))
    summaries = paged.groupBy("page").agg(F.collect_list(F.struct("block", "low", "high")).alias("own"))

    def to_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, q_table, beat = _rows([r.q], d), np.frombuffer(r.q_table).reshape(-1, m), np.frombuffer(r.beat)
                can = score_caps(q, q_table, page_low, page_high, top) >= beat[:, None]
                for j in np.flatnonzero(can.any(0)):
                    w = np.flatnonzero(can[:, j])
                    yield pd.DataFrame([{"page": page_ids[j], "q": q[w].tobytes(), "q_table": np.ascontiguousarray(q_table[w]).tobytes(), "beat": beat[w].tobytes(), "q1": np.frombuffer(r.q1, np.int64)[w].tobytes(), "q2": np.frombuffer(r.q2, np.int64)[w].tobytes()}])

    queries = blocks.where("asked > 0").select("q", "q_table", "beat", "q1", "q2")
    # copies of queries compress so well that Spark takes their tables for small and would broadcast them: joins by merging
    meets = queries.mapInPandas(to_pages, "page int, q binary, q_table binary, beat binary, q1 binary, q2 binary").hint("merge").join(summaries, "page")

    def survive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, q_table, beat = _rows([r.q], d), np.frombuffer(r.q_table).reshape(-1, m), np.frombuffer(r.beat)
                low = np.array([np.frombuffer(o["low"]) for o in r.own])
                high = np.array([np.frombuffer(o["high"]) for o in r.own])
                can = score_caps(q, q_table, low, high, top) >= beat[:, None]
                for j in np.flatnonzero(can.any(0)):
                    who = np.flatnonzero(can[:, j])
                    for s in range(0, len(who), QUERIES):
                        w = who[s : s + QUERIES]
                        yield pd.DataFrame([{"block": r.own[j]["block"], "q": q[w].tobytes(), "q_table": np.ascontiguousarray(q_table[w]).tobytes(), "beat": beat[w].tobytes(), "q1": np.frombuffer(r.q1, np.int64)[w].tobytes(), "q2": np.frombuffer(r.q2, np.int64)[w].tobytes()}])

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, copies, ids = _rows([r.vecs], d), np.frombuffer(r.copies, "<i4"), np.frombuffer(r.ids, "<i8")
                first = np.append(0, np.cumsum(copies))
                q, q1, q2 = _rows([r.q], d), np.frombuffer(r.q1, np.int64), np.frombuffer(r.q2, np.int64)
                out = []
                for i, at, score in search_block(q, np.frombuffer(r.q_table).reshape(-1, m), np.frombuffer(r.beat), x, np.frombuffer(r.table).reshape(-1, m), copies, k + 1, top):
                    own = np.concatenate([ids[first[a] : first[a + 1]] for a in at]) if len(at) else np.zeros(0, np.int64)
                    each = np.repeat(score, copies[at])
                    best = np.lexsort((own, -each))[: k + 1]
                    out.append(pd.DataFrame({"h1": q1[i], "h2": q2[i], "id": own[best], "score": each[best]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    pairs = materialise(meets.mapInPandas(survive, "block long, q binary, q_table binary, beat binary, q1 binary, q2 binary"), "pairs")
    return pairs.hint("merge").join(blocks.select("block", "vecs", "table", "copies", "ids"), "block").mapInPandas(evaluate, "h1 long, h2 long, id long, score long")
