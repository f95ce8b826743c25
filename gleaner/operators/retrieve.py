"""Retrieval: exact top-k, hybrid and multi-stage re-ranking, rank sweeps.

Every operator maps DataFrames to a DataFrame. Queries are (qid, vec), a corpus is
(cid, vec); more columns are ignored. Ties go to the smaller cid, and scores are rounded to
``digits`` before they are compared, so that the order doesn't hang on the order of
additions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import maxsim, sparse_dot

#: So many queries travel with the tasks; more are dealt in parts.
SMALL_QUERIES = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _best(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, digits: int) -> pd.DataFrame:
    """The k best of one corpus block for each query."""
    parts = []
    for start in range(0, len(q), 256):
        s = np.round(q[start : start + 256] @ c.T, digits)
        if s.shape[1] > k:
            cut = np.partition(s, -k, axis=1)[:, -k][:, None]
            rows, cols = np.nonzero(s >= cut)
        else:
            rows, cols = np.divmod(np.arange(s.size), s.shape[1])
        order = np.lexsort((cids[cols], -s[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        rows, cols = rows[keep], cols[keep]
        parts.append(pd.DataFrame({"qid": qids[start + rows], "cid": cids[cols], "score": s[rows, cols]}))
    return pd.concat(parts, ignore_index=True)


def _matrix(v: pd.Series) -> np.ndarray:
    return _unit(np.array(v.tolist(), dtype=np.float64))


def in_chunks(queries: DataFrame, small: int) -> list[DataFrame]:
    """The queries, or where there are more than small, hashed parts of them of about three quarters of it."""
    n = queries.count()
    if n <= small:
        return [queries]
    parts = -(-4 * n // (3 * small))
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == k) for k in range(parts)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, small: int = SMALL_QUERIES) -> DataFrame:
    """qid, rank, cid, score: the k corpus vectors with the highest cosine, exactly.

    Each task scores its corpus rows against the queries by matrix products and keeps k of each, so a query's
    shuffle is k rows a task, and corpus vectors never move. The queries travel with the tasks; more than
    ``small`` (counted) are dealt in parts, each with its own pass over the corpus. Null vectors take no part.
    """
    queries = queries.where("qid is not null and vec is not null").select("qid", F.col("vec").cast("array<double>").alias("vec"))
    corpus = corpus.where("cid is not null and vec is not null").select("cid", F.col("vec").cast("array<double>").alias("vec"))
    ids = f"qid {queries.schema['qid'].dataType.simpleString()}, cid {corpus.schema['cid'].dataType.simpleString()}, score double"

    def hits_of(few: pd.DataFrame) -> DataFrame:
        qids, q = few["qid"].to_numpy(), _matrix(few["vec"])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield _best(qids, q, b["cid"].to_numpy(), _matrix(b["vec"]), k, digits)

        return corpus.mapInPandas(scan, ids)

    held = [few for few in (part.toPandas() for part in in_chunks(queries, small)) if len(few)]
    return rank_by(_union([hits_of(few) for few in held]) if held else queries.sparkSession.createDataFrame([], ids), "score", k)


def first_ranks(queries: DataFrame, corpus: DataFrame, targets: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]], digits: int = 6, small: int = SMALL_QUERIES) -> DataFrame:
    """qid and for each target its first rank in the full ranking, null where there is none; never ranking the corpus.

    queries: qid, tag, vec; corpus: cid (a number), tag, vec. A target says which corpus rows it wants from the tags of
    both (arrays broadcast against each other). Two passes over the corpus: the best wanted row of each query, then how
    many rows beat it; a task emits one row for each query. More than ``small`` queries are dealt in parts.
    """
    queries, corpus = queries.where("qid is not null and vec is not null"), corpus.where("cid is not null and vec is not null")
    queries = queries.select("qid", "tag", F.col("vec").cast("array<double>").alias("vec"))
    return _union([_first_ranks(part, corpus, targets, digits) for part in in_chunks(queries, small)])


def _first_ranks(queries: DataFrame, corpus: DataFrame, targets: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]], digits: int) -> DataFrame:
    few, names = queries.toPandas(), [*targets]
    qids = queries.schema["qid"].dataType.simpleString()
    if few.empty:
        return queries.sparkSession.createDataFrame([], f"qid {qids}, " + ", ".join(f"{n} int" for n in names))
    q, tags = _matrix(few["vec"]), few["tag"].to_numpy()
    scan = corpus.select("cid", "tag", F.col("vec").cast("array<double>").alias("vec"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            if len(b):
                yield np.round(q @ _matrix(b["vec"]).T, digits), b["cid"].to_numpy(np.int64), b["tag"].to_numpy()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s, cids, ct in blocks(batches):
            for n, f in targets.items():
                wanted = np.where(f(tags[:, None], ct[None]), s, -np.inf)
                top = wanted.max(1)
                has = np.flatnonzero(top > -np.inf)
                first = np.where(wanted[has] == top[has, None], cids[None], np.iinfo(np.int64).max).min(1)
                yield pd.DataFrame({"at": has, "name": n, "score": top[has], "cid": first})

    found = scan.mapInPandas(best, "at int, name string, score double, cid long").groupBy("at", "name").agg(F.max(F.struct("score", (-F.col("cid")).alias("c"))).alias("b")).select("at", "name", "b.score", "b.c").collect()
    goal = {n: (np.full(len(few), np.inf), np.zeros(len(few), np.int64)) for n in names}
    for at, n, score, c in found:
        goal[n][0][at], goal[n][1][at] = score, -c

    def beat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s, cids, _ in blocks(batches):
            yield pd.DataFrame({"at": np.arange(len(few))} | {n: ((s > g[:, None]) | ((s == g[:, None]) & (cids[None] < c[:, None]))).sum(1) for n, (g, c) in goal.items()})

    counts = scan.mapInPandas(beat, "at int, " + ", ".join(f"{n} long" for n in names)).groupBy("at").agg(*[F.sum(n).alias(n) for n in names])
    known = pd.DataFrame({"at": np.arange(len(few)), "qid": few["qid"]} | {f"has_{n}": np.isfinite(goal[n][0]) for n in names})
    rows = queries.sparkSession.createDataFrame(known, f"at int, qid {qids}, " + ", ".join(f"has_{n} boolean" for n in names))
    return rows.join(counts, "at").select("qid", *[F.when(F.col(f"has_{n}"), F.col(n) + 1).cast("int").alias(n) for n in names])


def rank_by(hits: DataFrame, score: str = "score", k: int | None = None, tie: str = "cid", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """hits with rank: by score, then tie; at most k of each query."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k) if k else ranked


def sparse_pairs(queries: DataFrame, corpus: DataFrame, digits: int = 6) -> DataFrame:
    """qid, cid, score from (id, term, weight) rows: an equi-join on terms, summed; pairs without a shared term are absent."""
    q = queries.select("qid", "term", F.col("weight").alias("wq"))
    c = corpus.select("cid", "term", F.col("weight").alias("wc"))
    return q.join(c, "term").groupBy("qid", "cid").agg(F.round(F.sum(F.col("wq") * F.col("wc")), digits).alias("score"))


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, small: int = SMALL_QUERIES) -> DataFrame:
    """qid, rank, cid, score: the k corpus texts with the highest sparse dot product, of those that share a term.

    Rows are (id, term, weight). The queries' postings, term by term, travel with the tasks (more than ``small`` queries
    in parts); a corpus text's terms are brought together once, and tasks add up the products of whole batches and keep k
    a query. So neither common terms nor pairs of texts are shuffled.
    """
    packed = corpus.where("cid is not null").groupBy("cid").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    ids = f"qid {queries.schema['qid'].dataType.simpleString()}, cid {corpus.schema['cid'].dataType.simpleString()}, score double"

    def hits_of(few: pd.DataFrame) -> DataFrame:
        at, qids = pd.factorize(few["qid"])
        number, vocabulary = pd.factorize(few["term"])
        number_of = {t: i for i, t in enumerate(vocabulary)}
        order = np.argsort(number, kind="stable")
        ends = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))
        who, weight = at[order], few["weight"].to_numpy(float)[order]

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for start in range(0, len(whole), 256):
                    batch = whole.iloc[start : start + 256]
                    row = np.repeat(np.arange(len(batch)), batch["terms"].str.len())
                    term = np.array([number_of.get(t, -1) for own in batch["terms"] for t in own], np.int64)
                    w = np.array([x for own in batch["weights"] for x in own], float)
                    known = np.flatnonzero(term >= 0)
                    known = known[np.argsort(term[known], kind="stable")]
                    if not len(known):
                        continue
                    score, shared = np.zeros((len(batch), len(qids))), np.zeros((len(batch), len(qids)), bool)
                    cuts = np.flatnonzero(np.append(True, term[known][1:] != term[known][:-1]))
                    for own in np.split(known, cuts[1:]):
                        t = term[own[0]]
                        cells = np.ix_(row[own], who[ends[t] : ends[t + 1]])
                        score[cells] += w[own][:, None] * weight[ends[t] : ends[t + 1]]
                        shared[cells] = True
                    score = np.where(shared, np.round(score, digits), -np.inf).T
                    if score.shape[1] > k:
                        keep = (score >= np.partition(score, -k, axis=1)[:, -k][:, None]) & np.isfinite(score)
                    else:
                        keep = np.isfinite(score)
                    a, b = np.nonzero(keep)
                    cids = batch["cid"].to_numpy()[b]
                    best = np.lexsort((cids, -score[a, b], a))
                    a, b, cids = a[best], b[best], cids[best]
                    first = np.arange(len(a)) - np.searchsorted(a, a) < k
                    yield pd.DataFrame({"qid": np.asarray(qids)[a[first]], "cid": cids[first], "score": score[a[first], b[first]]})

        return packed.mapInPandas(scan, ids)

    own = queries.where("qid is not null").groupBy("qid", "term").agg(F.sum("weight").alias("weight"))
    parts = [own.join(part, "qid", "left_semi") for part in in_chunks(own.select("qid").distinct(), small)]
    held = [few for few in (part.select("qid", "term", "weight").orderBy("qid", "term").toPandas() for part in parts) if len(few)]
    return rank_by(_union([hits_of(few) for few in held]) if held else queries.sparkSession.createDataFrame([], ids), "score", k)


def lexical_overlap(hits: DataFrame, q_tokens: DataFrame, c_tokens: DataFrame, name: str = "lexical") -> DataFrame:
    """hits with the sum over shared terms of the product of weights, 0 without one. Tokens: (qid | cid), term, weight.

    Equi-joins on (id, term): only the terms of texts that are hit meet, and sums combine before the shuffle.
    """
    q, c = q_tokens.select("qid", "term", F.col("weight").alias("_wq")), c_tokens.select("cid", "term", F.col("weight").alias("_wc"))
    shared = hits.select("qid", "cid").join(q, "qid").join(c, ["cid", "term"]).groupBy("qid", "cid").agg(F.sum(F.col("_wq") * F.col("_wc")).alias(name))
    return hits.join(shared, ["qid", "cid"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def hybrid(hits: DataFrame, dense: Column, lexical: Column, alpha: float = 0.6, digits: int = 6) -> DataFrame:
    """Re-rank prefiltered hits by alpha * dense + (1 - alpha) * lexical overlap; equal scores keep the old order."""
    mixed = hits.withColumn("_old", F.col("rank")).withColumn("score", F.round(alpha * dense + (1 - alpha) * lexical, digits))
    return rank_by(mixed.drop("rank"), "score", tie="_old").drop("_old")


def rerank(hits: DataFrame, scorer: Column, window: int, k: int | None = None) -> DataFrame:
    """Replace the scores of the first max(window, k) hits by scorer, re-rank them and cut at k; ties keep the old order."""
    size = max(window, k or 0)
    new = hits.where(F.col("rank") <= size).withColumn("_old", F.col("rank")).withColumn("score", scorer).drop("rank")
    return rank_by(new, "score", k, tie="_old").drop("_old")


def rerank_sweep(hits: DataFrame, scorer: Column, windows: list[tuple[int, int]]) -> DataFrame:
    """One re-ranking for each (window, final k): columns window and final_k are added. hits are ranked and scored once."""
    spark = hits.sparkSession
    grid = spark.createDataFrame(windows, "window int, final_k int")
    most = max(w for w, _ in windows)
    scored = hits.where(F.col("rank") <= most).withColumn("_new", scorer)
    each = scored.join(F.broadcast(grid), F.col("rank") <= F.col("window")).withColumnRenamed("rank", "base_rank")
    w = Window.partitionBy("qid", "window", "final_k").orderBy(F.col("_new").desc(), "base_rank")
    return each.withColumn("rank", F.row_number().over(w)).where("rank <= final_k").withColumnRenamed("_new", "rerank_score")


def best_variant(hits: DataFrame, group: str, k: int) -> DataFrame:
    """Keep each group's best hit of a query (variants of one answer), then the k best groups."""
    w = Window.partitionBy("qid", group).orderBy(F.col("score").desc(), "cid")
    return rank_by(hits.drop("rank").withColumn("_v", F.row_number().over(w)).where("_v = 1").drop("_v"), "score", k)


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Compose stages (dense, hybrid, re-rank, late interaction) into one transform."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def search(queries: DataFrame, corpus: DataFrame, k: int = 3, prefilter: int = 50, alpha: float | None = 0.6, scorer: Callable[[Column, Column], Column] | None = None, late: bool = False, window: int = 10) -> DataFrame:
    """qid, rank, cid, score by stages: dense prefilter, hybrid (alpha None: left out), then re-ranking by a scorer of both
    texts or by late interaction over the first max(window, k), but not by both.

    queries: qid, text, enc; corpus: cid, text, enc, where enc is a struct<dense, sparse, tokens>.
    """
    if scorer is not None and late:
        raise ValueError("a scorer and late interaction exclude each other")
    dense = lambda df, key: df.select(key, F.col("enc.dense").alias("vec"))
    own = lambda df, key, p: df.select(key, *[F.col(c).alias(f"{p}_{n}") for n, c in (("text", "text"), ("sparse", "enc.sparse"), ("tokens", "enc.tokens"))])
    hits = top_k(dense(queries, "qid"), dense(corpus, "cid"), max(k, prefilter))
    hits = hits.join(own(corpus, "cid", "c"), "cid").join(own(queries, "qid", "q"), "qid")
    steps = []
    if alpha is not None:
        steps.append(lambda df: hybrid(df, F.col("score"), sparse_dot(F.col("q_sparse"), F.col("c_sparse")), alpha))
    if scorer is not None:
        steps.append(lambda df: rerank(df, scorer(F.col("q_text"), F.col("c_text")), window, k))
    elif late:
        both = (F.size("q_tokens") > 0) & (F.size("c_tokens") > 0)
        steps.append(lambda df: rerank(df, F.when(both, F.round(maxsim(F.col("q_tokens"), F.col("c_tokens")), 6)).otherwise(0.0), window, k))
    return pipeline(*steps)(hits).where(F.col("rank") <= k).select("qid", "rank", "cid", "score")
