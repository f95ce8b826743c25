"""Pluggable models: embedders, cross-encoders and their registry; a deterministic pair ships with the library.

An embedder or scorer is built once per Python worker from its config and applied to
Arrow batches. No network or GPU is needed for the built-in ones.
"""

from __future__ import annotations

import json
import time
import urllib.request
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.sources.shared import written


@dataclass(frozen=True)
class ModelSpec:
    """name: registry key; backend: 'hashed' or one registered; style: none, prefix, prompt_name or method."""

    name: str
    backend: str = "hashed"
    style: str = "none"
    query_prefix: str = ""
    passage_prefix: str = ""
    options: dict = field(default_factory=dict)


class HashedEmbedder:
    """Hashed word counts, L2-normalised: a deterministic stand-in for a model."""

    def __init__(self, spec: ModelSpec):
        self.width = int(spec.options.get("width", 256))

    def embed_batch(self, texts: list[str], mode: str = "passage") -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.width] += 1 if h >> 31 else -1
        n = np.sqrt((out**2).sum(1, keepdims=True))
        return (out / np.where(n == 0, 1, n)).tolist()

    def encode(self, texts: list[str], mode: str = "passage", late: bool = False) -> list[tuple]:
        """dense, sparse and token vectors of each text: hashed counts, shares of words, and words by their hashed trigrams."""
        out = []
        for t, dense in zip(texts, self.embed_batch(texts, mode), strict=True):
            words = t.lower().split()
            sparse = {w: n / len(words) for w, n in Counter(words).items()}
            pieces = [" ".join(f" {w} "[k : k + 3].replace(" ", "_") for k in range(len(w))) for w in words] if late else []
            out.append((dense, sparse, self.embed_batch(pieces) if pieces else []))
        return out

    def memory_usage(self) -> str:
        return "-"


class HttpEmbedder:
    """A model behind an HTTP service. options: url takes {model, input} and answers {embeddings}; loaded_url (if given)
    lists the loaded models with their sizes; timeout in seconds. A failed call raises."""

    def __init__(self, spec: ModelSpec):
        self.model, self.url, self.loaded = spec.options.get("model", spec.name), spec.options["url"], spec.options.get("loaded_url")
        self.timeout, self.batch = float(spec.options.get("timeout", 60)), int(spec.options.get("batch", 32))

    def _call(self, url: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            return json.load(r)

    def embed_batch(self, texts: list[str], mode: str = "passage") -> list[list[float]]:
        out = []
        for k in range(0, len(texts), self.batch):
            part = texts[k : k + self.batch]
            found = self._call(self.url, {"model": self.model, "input": part})["embeddings"]
            if len(found) != len(part):
                raise ValueError(f"{len(found)} vectors for {len(part)} texts")
            out += found
        return out

    def memory_usage(self) -> str:
        """Bytes that the service holds for the model; '-' where it doesn't say."""
        if not self.loaded:
            return "-"
        return next((str(m["size"]) for m in self._call(self.loaded).get("models", []) if m.get("name") == self.model), "-")


class LibraryEmbedder:
    """A model of the sentence_transformers library, if that is installed. Style prompt_name names the prompt of a query; style
    method uses the library's own methods for queries and documents."""

    def __init__(self, spec: ModelSpec):
        from sentence_transformers import SentenceTransformer

        self.style, self.model = spec.style, SentenceTransformer(spec.options["hf_id"])

    def embed_batch(self, texts: list[str], mode: str = "passage") -> list[list[float]]:
        if self.style == "method":
            run = self.model.encode_query if mode == "query" else self.model.encode_document
            return run(texts, normalize_embeddings=True).tolist()
        more = {"prompt_name": "query"} if self.style == "prompt_name" and mode == "query" else {}
        return self.model.encode(texts, normalize_embeddings=True, **more).tolist()

    def memory_usage(self) -> str:
        return str(sum(p.numel() * p.element_size() for p in self.model.parameters()))


class LexicalScorer:
    """Share of the query's words in the text, in 0..1."""

    def __init__(self, spec: ModelSpec):
        pass

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            words = set(q.lower().split())
            out.append(len(words & set(t.lower().split())) / len(words) if words else 0.0)
        return out


EMBEDDERS: dict[str, Callable[[ModelSpec], object]] = {"hashed": HashedEmbedder, "http": HttpEmbedder, "sentence_transformers": LibraryEmbedder}
SCORERS: dict[str, Callable[[ModelSpec], object]] = {"lexical": LexicalScorer}

# fixed values: the models that are compared by default, their hub ids and how they take queries
REGISTRY = [
    ModelSpec("qwen3-embedding:0.6b", "sentence_transformers", "prompt_name", options={"hf_id": "Qwen/Qwen3-Embedding-0.6B"}),
    ModelSpec("bge-m3", "sentence_transformers", "none", options={"hf_id": "BAAI/bge-m3"}),
    ModelSpec("multilingual-e5-large", "sentence_transformers", "prefix", "query: ", "passage: ", {"hf_id": "intfloat/multilingual-e5-large"}),
    ModelSpec("embeddinggemma", "sentence_transformers", "method", options={"hf_id": "google/embeddinggemma-300m"}),
    ModelSpec("gte-multilingual-base", "sentence_transformers", "none", options={"hf_id": "Alibaba-NLP/gte-multilingual-base"}),
]

ENCODED = "dense array<double>, sparse map<string, double>, tokens array<array<double>>"


def build_embedder(spec: ModelSpec, factories: dict | None = None):
    table = factories or EMBEDDERS
    if spec.backend not in table:
        raise ValueError(f"unknown backend: {spec.backend}")
    return table[spec.backend](spec)


def select_models(specs: list[ModelSpec], names: list[str] | None) -> list[ModelSpec]:
    """All, or those named; an unknown name is an error."""
    if not names:
        return specs
    known = {s.name: s for s in specs}
    if gone := [n for n in names if n not in known]:
        raise ValueError(f"unknown models: {', '.join(gone)}")
    return [known[n] for n in names]


def prompted(text: Column, spec: ModelSpec, mode: str) -> Column:
    """The text as the model wants it; prompt_name and method styles are left to the backend."""
    prefix = spec.query_prefix if mode == "query" else spec.passage_prefix
    return F.concat(F.lit(prefix), text) if spec.style == "prefix" and prefix else text


def embed_column(text: Column, spec: ModelSpec, mode: str = "passage") -> Column:
    """array<double> by the model, loaded once per worker."""
    factories = dict(EMBEDDERS)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build_embedder(spec, factories)
        for batch in batches:
            yield pd.Series(model.embed_batch(batch.fillna("").tolist(), mode))

    return run(prompted(text, spec, mode))


def try_embed_column(text: Column, spec: ModelSpec, mode: str = "passage") -> Column:
    """struct<vec, sec, error>: each text by itself with its seconds; one that fails has no vector but an error."""
    factories = dict(EMBEDDERS)

    @F.pandas_udf("vec array<double>, sec double, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = build_embedder(spec, factories)
        for batch in batches:
            out = []
            for t in batch.fillna(""):
                start = time.perf_counter()
                try:
                    vec, error = [float(x) for x in model.embed_batch([t], mode)[0]], None
                except Exception as e:  # noqa: BLE001 - one text's failure must not end the others
                    vec, error = None, f"{type(e).__name__}: {e}"
                out.append((vec, time.perf_counter() - start, error))
            yield pd.DataFrame(out, columns=["vec", "sec", "error"])

    return run(prompted(text, spec, mode))


def encode_column(text: Column, spec: ModelSpec, mode: str = "passage", late: bool = False) -> Column:
    """struct<dense, sparse, tokens> by one call of the model; no token vectors unless late."""
    factories = dict(EMBEDDERS)

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = build_embedder(spec, factories)
        for batch in batches:
            yield pd.DataFrame(model.encode(batch.fillna("").tolist(), mode, late), columns=["dense", "sparse", "tokens"])

    return run(prompted(text, spec, mode))


def timed_score_column(query: Column, text: Column, spec: ModelSpec = ModelSpec("lexical", "lexical")) -> Column:
    """struct<score, sec>: as score_column, with each pair's share of its batch's seconds."""
    factories = dict(SCORERS)

    @F.pandas_udf("score double, sec double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = build_embedder(spec, factories)
        for q, t in batches:
            start = time.perf_counter()
            scores = [float(x) for x in model.predict(list(zip(q.fillna(""), t.fillna(""), strict=True)))]
            yield pd.DataFrame({"score": scores, "sec": (time.perf_counter() - start) / max(1, len(scores))})

    return run(query, text)


def score_column(query: Column, text: Column, spec: ModelSpec = ModelSpec("lexical", "lexical")) -> Column:
    """A cross-encoder's score of each (query, text) pair."""
    factories = dict(SCORERS)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = build_embedder(spec, factories)
        for q, t in batches:
            yield pd.Series(model.predict(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype=float)

    return run(query, text)


def evaluate_models(specs: list[ModelSpec], evaluate: Callable[[ModelSpec], DataFrame], log: Callable[[str], None] = print) -> DataFrame | None:
    """The union of each model's results; a model that fails is logged and left out."""
    out = None
    for spec in specs:
        try:
            one = evaluate(spec).withColumn("model", F.lit(spec.name))
            one = written(one, "model")  # a model that fails as it runs fails here
        except Exception as e:  # noqa: BLE001 - one model's failure must not end the others
            log(f"{spec.name}: {e}")
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
