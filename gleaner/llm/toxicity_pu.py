"""Toxicity scoring by non-negative positive-unlabelled learning.

Only confirmed toxic texts (P) and unlabelled texts (U) are used. U is a sample of all texts,
whatever is known of them, so the class prior p among all texts holds for it. With it, the risk of a classifier g is

    p * R_P(g, +1) + max(0, R_U(g, -1) - p * R_P(g, -1)),

the second term being the negatives' risk estimated from U after taking the
positives out; where it falls below zero the step goes against it instead, so the
classifier can't drive it below by memorising U. The loss is logistic, so the
sigmoid of g estimates the probability of a toxic text.

Features are the words (letters only, lower case) of the whole text and their
prefixes, each valued by its share of the text's words; those whose mean differs
most between P and U, by a pooled z-score, make up the vocabulary.

Edge cases: a null or empty text has no words and gets the score of the bias
alone; with no positive text at hand every score is 0; repeated rows each get a
row, and a text counts once in P and once in U; ids, of any type, with several labels count as
toxic if one of them says so, and null ids or labels are left out of the fit; ties in the
vocabulary go to the smaller feature; very long texts are read whole, in memory that is a
multiple of the text's; carried columns named as the result's are refused; other columns are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import hash_share, materialise, own_columns

_WORDS = re.compile(r"[^\W\d_]+")
#: Beside a word itself, its first so many letters are features: inflected and compound forms share them.
PREFIXES = (4, 5, 6, 7)
#: A feature's value is its share of the words, in units of UNIT, up to MOST.
UNIT, MOST = 0.01, 3.0
_MEMO = 1 << 18


def word_features(word: str) -> list[str]:
    """The word, marked by its end, and its prefixes."""
    return [f"{word} ", *(word[:n] for n in PREFIXES if len(word) >= n)]


def text_features(text: str | None) -> dict[str, float]:
    counts = Counter(_WORDS.findall(text.lower())) if isinstance(text, str) else Counter()
    total, out = sum(counts.values()), Counter()
    for word, n in counts.items():
        for f in word_features(word):
            out[f] += n
    return {f: min(MOST, n / total / UNIT) for f, n in out.items()}


@dataclass(frozen=True)
class PUSettings:
    """Bounds of the fit: about so many positive and unlabelled texts, chosen by a hash of the id."""

    positives: int = 4000
    unlabelled: int = 12000
    vocabulary: int = 400
    least_docs: int = 3
    least_z: float = 6.0
    rounds: int = 400
    rate: float = 0.1
    decay: float = 0.1  # over the number of positive texts
    seed: int = 5


@dataclass
class WordModel:
    weights: dict[str, float]
    bias: float
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def _word(self, word: str) -> tuple[str, ...]:
        """The word's features in the model; none for most words."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            found = self.memo[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def score(self, text: str | None) -> float:
        counts = Counter(_WORDS.findall(text.lower())) if isinstance(text, str) else Counter()
        total, seen = sum(counts.values()), Counter()
        for word, n in counts.items():
            for f in self._word(word):
                seen[f] += n
        return _sigmoid(self.bias + sum(self.weights[f] * min(MOST, n / total / UNIT) for f, n in sorted(seen.items())))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -60.0), 60.0))))


def train_nnpu(rows: list[np.ndarray], values: list[np.ndarray], positive: np.ndarray, width: int, prior: float, settings: PUSettings) -> tuple[np.ndarray, float]:
    """Fit a linear classifier. rows, values: the feature numbers of each text and their values."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    x = np.concatenate(values).astype(float) if sizes.sum() else np.zeros(0)
    owner = np.repeat(np.arange(len(rows)), sizes)
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    theta, moment, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, settings.rounds + 1):
        g = np.bincount(owner, theta[flat] * x, len(rows)) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
        loss_neg = np.logaddexp(0, g)
        negative = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
        down = np.where(positive, -prior * s / n_p, s / n_u)
        if negative < 0:
            slope = -down
        else:
            slope = down + np.where(positive, prior * (s - 1) / n_p, 0)
        grad = np.append(np.bincount(flat, slope[owner] * x, width), slope.sum())
        grad[:-1] += settings.decay / n_p * theta[:-1]
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta = theta - settings.rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: PUSettings = PUSettings(), prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> WordModel:
    """Learn from the texts of docs whose label is 1 and from the unlabelled ones.

    prior: share of toxic texts; by default that among all labelled rows given. Unlabelled texts are
    drawn from all texts. The samples' bounds are in the settings.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    n, n_toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    total = docs.count()
    if not n_toxic or not total:
        return WordModel({}, -60.0)
    prior = min(max(prior if prior is not None else n_toxic / n, 1e-4), 0.999)
    toxic = marks.where((F.col("toxic") == 1) & hash_share(F.col("id"), min(1.0, settings.positives / n_toxic), settings.seed)).select("id")
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    confirmed = texts.join(F.broadcast(toxic), "id").withColumn("positive", F.lit(True))
    rest = texts.where(hash_share(F.col("id"), min(1.0, settings.unlabelled / total), settings.seed + 1)).withColumn("positive", F.lit(False))
    once = confirmed.unionByName(rest).groupBy(F.xxhash64("text").alias("h"), "positive").agg(F.min("text").alias("text"), F.min("id").alias("id"))
    sample = materialise(once.select("id", "text", "positive"), "toxicity_sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return WordModel({}, -60.0)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[str, bool], list[float]] = {}
            for text, positive in zip(batch["text"], batch["positive"], strict=True):
                for f, v in text_features(text).items():
                    got = sums.setdefault((f, positive), [0, 0.0, 0.0])
                    got[0] += 1
                    got[1] += v
                    got[2] += v * v
            yield pd.DataFrame([(f, p, *x) for (f, p), x in sums.items()], columns=["feature", "positive", "n", "s", "q"])

    at = lambda c, p: F.coalesce(F.sum(F.when(F.col("positive") == p, F.col(c))), F.lit(0.0))
    stats = sample.mapInPandas(moments, "feature string, positive boolean, n long, s double, q double").groupBy("feature").agg(F.sum("n").alias("n"), *[at(c, p).alias(f"{c}_{'pu'[not p]}") for c in "sq" for p in (True, False)])
    mean_p, mean_u = F.col("s_p") / n_p, F.col("s_u") / n_u
    pooled = (F.col("q_p") + F.col("q_u")) / (n_p + n_u) - F.pow((F.col("s_p") + F.col("s_u")) / (n_p + n_u), 2)
    spread = F.sqrt(pooled * (1 / n_p + 1 / n_u) + 1e-9)
    scored = stats.where(F.col("n") >= settings.least_docs).select("feature", (F.abs(mean_p - mean_u) / spread).alias("z"))
    vocabulary = [r[0] for r in scored.where(F.col("z") >= settings.least_z).orderBy(F.round("z", 6).desc(), "feature").limit(settings.vocabulary).select("feature").collect()]
    number = {w: k for k, w in enumerate(vocabulary)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted((number[f], v) for f, v in text_features(t).items() if f in number) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "positive": batch["positive"], "at": [[k for k, _ in x] for x in found], "value": [[v for _, v in x] for x in found]})

    kind = sample.schema["id"].dataType.simpleString()
    encoded = sample.mapInPandas(encode, f"id {kind}, positive boolean, at array<int>, value array<double>").toPandas().sort_values(["id", "positive"], kind="stable")
    weights, bias = train_nnpu([np.asarray(x, np.int64) for x in encoded["at"]], [np.asarray(x, float) for x in encoded["value"]], encoded["positive"].to_numpy(bool), len(number), prior, settings)
    return WordModel({w: float(weights[k]) for w, k in number.items() if weights[k]}, bias)


def score_toxicity(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, any carried columns, score and predicted (1 from 0.5)."""
    names = own_columns([id_col, *carry], ("score", "predicted"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["score"] = np.array([model.score(t) for t in batch[text_col]], float)
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    return docs.select(*dict.fromkeys([*names, text_col])).mapInPandas(run, f"{fields}, score double, predicted int")
