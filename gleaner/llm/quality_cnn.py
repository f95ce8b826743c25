"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole text.
Learned filters slide over the byte embeddings of each chunk; a filter's response
is its maximum over the chunk. The chunks' responses are combined by their mean
and their maximum over the text, and a dense layer turns them into one probability.

Since a filter is linear, its response at a place is a sum of table rows, one for
each byte under it: the embedding and the filter are multiplied once per model, and
scoring only gathers and adds.

Filters move by ``STRIDE`` bytes, so a filter is tried at every fourth place; chunks cover every
byte. The fit draws its chunks in the tasks: the driver gets a bounded number of chunks of a
bounded number of texts, however long.

Edge cases: null and empty texts are one chunk of padding; texts of any length are
scored whole, in groups of chunks, so memory is bounded; repeated rows each get a
row, and rows of one id are one text of the fit, the smallest; with no label at hand every
score is 0.5; ids with several labels take the smallest; null ids and labels are left out of
the fit; carried columns named as the result's are refused; other columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import hash_share, own_columns

CHUNK, OVERLAP, WIDTH, STRIDE, PAD = 512, 32, 8, 4, 256
GROUP = 2048


@dataclass(frozen=True)
class CNNSettings:
    """Bounds of the fit: about so many labelled texts, chosen by a hash of the id, so many chunks of each at all and so many a round."""

    samples: int = 3000
    pool: int = 16
    chunks: int = 4
    embedding: int = 8
    filters: int = 16
    rounds: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 10


def text_chunks(text: str | None) -> np.ndarray:
    """The text's bytes as rows of CHUNK bytes, each beginning OVERLAP bytes before the last one's end."""
    raw = np.frombuffer((text if isinstance(text, str) else "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class ByteCNN:
    embedding: np.ndarray  # PAD + 1, E
    kernel: np.ndarray  # WIDTH, E, filters
    shift: np.ndarray  # filters
    dense: np.ndarray  # 2 * filters
    bias: float

    def tables(self) -> np.ndarray:
        return np.einsum("be,kef->kbf", self.embedding, self.kernel).astype(np.float32)

    def pooled(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Each filter's maximum over each chunk, not below 0."""
        places = (CHUNK - WIDTH) // STRIDE + 1
        at = np.ascontiguousarray(chunks)
        out = np.empty((len(at), tables.shape[2]), np.float32)
        for first in range(0, len(at), 64):
            part = at[first : first + 64]
            total = tables[0][part[:, 0 : places * STRIDE : STRIDE]]
            for k in range(1, WIDTH):
                total += tables[k][part[:, k : k + (places - 1) * STRIDE + 1 : STRIDE]]
            out[first : first + 64] = total.max(axis=1)
        return np.maximum(out + self.shift.astype(np.float32), 0)

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        """A probability for each text; chunks of many texts are run together."""
        tables, f = self.tables(), len(self.shift)
        mean, top, sizes = np.zeros((len(texts), f)), np.zeros((len(texts), f)), np.zeros(len(texts))
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> None:
            if held:
                z, owner = self.pooled(np.concatenate(held), tables), np.concatenate(owners)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                who = owner[first]
                mean[who] += np.add.reduceat(z, first, axis=0)
                top[who] = np.maximum(top[who], np.maximum.reduceat(z, first, axis=0))
                held.clear()
                owners.clear()

        waiting = 0
        for k, text in enumerate(texts):
            chunks = text_chunks(text)
            sizes[k] = len(chunks)
            for start in range(0, len(chunks), GROUP):
                part = chunks[start : start + GROUP]
                held.append(part)
                owners.append(np.full(len(part), k))
                waiting += len(part)
                if waiting >= GROUP:
                    flush()
                    waiting = 0
        flush()
        logits = np.concatenate([mean / sizes[:, None], top], axis=1) @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def drawn_chunks(text: str | None, settings: CNNSettings) -> np.ndarray:
    """At most settings.pool chunks of a text, at places that depend on its length and the seed."""
    chunks = text_chunks(text)
    if len(chunks) <= settings.pool:
        return np.ascontiguousarray(chunks)
    return chunks[np.sort(np.random.default_rng([settings.seed, len(chunks)]).permutation(len(chunks))[: settings.pool])]


def train_cnn(texts: list[str], labels: np.ndarray, settings: CNNSettings = CNNSettings()) -> ByteCNN:
    return train_chunks([drawn_chunks(t, settings) for t in texts], labels, settings)


def train_chunks(cut: list[np.ndarray], labels: np.ndarray, settings: CNNSettings = CNNSettings()) -> ByteCNN:
    """Adam on the cross-entropy; each round draws some of each text's chunks."""
    rng = np.random.default_rng(settings.seed)
    e, f = settings.embedding, settings.filters
    p = {"emb": rng.normal(0, 0.3, (PAD + 1, e)), "ker": rng.normal(0, (WIDTH * e) ** -0.5, (WIDTH, e, f)), "shift": np.zeros(f), "dense": rng.normal(0, 0.1, 2 * f), "bias": np.zeros(1)}
    moment, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    places = (CHUNK - WIDTH) // STRIDE + 1
    for _ in range(settings.rounds):
        order = rng.permutation(len(cut))
        for start in range(0, len(order), settings.batch):
            who = order[start : start + settings.batch]
            picked = [cut[i][rng.permutation(len(cut[i]))[: settings.chunks]] for i in who]
            sizes = np.array([len(x) for x in picked])
            chunks, owner = np.concatenate(picked), np.repeat(np.arange(len(who)), sizes)
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            net = ByteCNN(p["emb"], p["ker"], p["shift"], p["dense"], 0.0)
            tables = net.tables()
            total = tables[0][chunks[:, 0 : places * STRIDE : STRIDE]]
            for k in range(1, WIDTH):
                total += tables[k][chunks[:, k : k + (places - 1) * STRIDE + 1 : STRIDE]]
            best = total.argmax(axis=1)  # chunk, filter -> place
            raw = np.take_along_axis(total, best[:, None, :], 1)[:, 0] + p["shift"]
            z = np.maximum(raw, 0)
            mean = np.add.reduceat(z, first, axis=0) / sizes[:, None]
            top = np.maximum.reduceat(z, first, axis=0)
            features = np.concatenate([mean, top], axis=1)
            prob = 1 / (1 + np.exp(-np.clip(features @ p["dense"] + p["bias"], -60, 60)))
            d = (prob - labels[who]) / len(who)
            grad = {"dense": features.T @ d + 1e-4 * p["dense"], "bias": np.array([d.sum()])}
            df = d[:, None] * p["dense"]
            dz = df[owner, :f] / sizes[owner, None] + np.where(z == top[owner], df[owner, f:], 0)
            dz = np.where(raw > 0, dz, 0)
            grad["shift"] = dz.sum(0)
            grad["emb"], grad["ker"] = np.zeros_like(p["emb"]), np.zeros_like(p["ker"])
            row = np.arange(len(chunks))[:, None]
            for k in range(WIDTH):
                byte = chunks[row, best * STRIDE + k]  # chunk, filter
                seen = p["emb"][byte]  # chunk, filter, e
                grad["ker"][k] = np.einsum("cfe,cf->ef", seen, dz)
                np.add.at(grad["emb"], byte, dz[:, :, None] * p["ker"][k].T[None])
            step += 1
            for k in p:
                moment[k] = 0.9 * moment[k] + 0.1 * grad[k]
                square[k] = 0.999 * square[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - settings.rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCNN(p["emb"], p["ker"], p["shift"], p["dense"], float(p["bias"][0]))


def fit_quality(docs: DataFrame, labels: DataFrame, settings: CNNSettings = CNNSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteCNN | None:
    """Learn from a bounded sample of the labelled texts (see the settings); None where there is none."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("mark"))
    n = marks.count()
    if not n:
        return None
    few = marks.where(hash_share(F.col("id"), min(1.0, settings.samples / n), settings.seed))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("mark").alias("mark"))
    kind = sample.schema["id"].dataType.simpleString()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "mark": batch["mark"] == 1, "chunks": [drawn_chunks(t, settings).tobytes() for t in batch["text"]]})

    got = sample.mapInPandas(draw, f"id {kind}, mark boolean, chunks binary").toPandas().sort_values("id")
    if not len(got):
        return None
    return train_chunks([np.frombuffer(x, np.int16).reshape(-1, CHUNK) for x in got["chunks"]], got["mark"].to_numpy(float), settings)


def score_quality(docs: DataFrame, model: ByteCNN | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, any carried columns, score and predicted (1 from the threshold)."""
    names = own_columns([id_col, *carry], ("score", "predicted"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["score"] = model.score_texts(batch[text_col].tolist()) if model else 0.5
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            yield out

    return docs.select(*dict.fromkeys([*names, text_col])).mapInPandas(run, f"{fields}, score double, predicted int")
