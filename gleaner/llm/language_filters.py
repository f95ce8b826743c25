"""Language identification with bit-sliced Bloom filters over character n-grams.

Fit: for every language the most frequent n-grams of a bounded sample go into that
language's Bloom filter. The filters of each 64 languages are sliced by bit: slot
j of one uint64 table holds, in bit l, slot j of language l's filter. A look-up
ANDs the k slots of an n-gram and so returns the set of all languages holding it.

Predict: over the n-grams of the whole text, the hits of each language are
popcounts of its bit. A filter with false-positive rate f_l answers for about
f_l of the n-grams it doesn't hold, so the hits c_l of n n-grams are corrected to
(c_l - n f_l) / (1 - f_l). The highest corrected count decides, ties going to the
language that sorts first; the score is its share of the n-grams, cut to 0..1.

Edge cases: null text and text without a letter give "und" and score 0; with no
language learned every text gives "und"; very long texts are cut into pieces of
``PIECE`` characters that overlap so that no n-gram is lost; repeated rows each
get a row; columns other than the id and the text are not read. Rows are
independent: no shuffle on the prediction side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import materialise, own_columns, trim_memory

ORDERS = (2, 3, 4)
PIECE = 1 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, all but letters as one space between words and at either end."""
    words = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    return np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of the n-grams of some code points."""
    size = len(codes) - n + 1
    key = np.full(max(0, size), n, np.uint64)
    for k in range(n if size > 0 else 0):
        key = (key << np.uint64(15)) ^ (key >> np.uint64(49)) ^ codes[k : k + size].astype(np.uint64)
    return key


def gram_pieces(text: str, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """The keys of all n-grams of a text, each once, of PIECE places at a time."""
    codes = _codes(text)
    for start in range(0, len(codes), PIECE):
        yield np.concatenate([_keys(codes[start : start + PIECE + n - 1], n) for n in orders])


def grams(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    return np.concatenate([*gram_pieces(text, orders)])


@dataclass
class LanguageFilters:
    """Up to 64 languages in one table of 2**bits slots; rates: each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    bits: int
    hashes: int
    rates: np.ndarray

    @classmethod
    def build(cls, members: dict[str, np.ndarray], bits: int = 18, hashes: int = 3) -> LanguageFilters:
        languages = sorted(members)
        if len(languages) > 64:
            raise ValueError("a mask holds 64 languages; fit several tables for more")
        out = cls(languages, np.zeros(1 << bits, np.uint64), bits, hashes, np.zeros(len(languages)))
        for l, language in enumerate(languages):
            keys = np.asarray(members[language], np.uint64)
            for at in out._places(keys):
                np.bitwise_or.at(out.slots, at, np.uint64(1 << l))
            fill = float(((out.slots >> np.uint64(l)) & np.uint64(1)).mean())
            out.rates[l] = fill**hashes
        return out

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = keys * _MIX[0]
        h ^= h >> np.uint64(32)
        h *= _MIX[1]
        h ^= h >> np.uint64(29)
        step = self.bits
        for k in range(self.hashes):
            yield ((h >> np.uint64(k * step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram, the bit mask of the languages that hold it."""
        out = None
        for at in self._places(keys):
            got = self.slots[at]
            out = got if out is None else out & got
        return out

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Hits by language, and the number of n-grams."""
        hits, total = np.zeros(len(self.languages), np.int64), 0
        for keys in gram_pieces(text):
            masks = self.masks(keys)
            total += len(masks)
            for l in range(len(self.languages)):
                hits[l] += np.count_nonzero(masks & np.uint64(1 << l))
        return hits, total

    def predict(self, text: str | None) -> tuple[str, float]:
        return best_language([self], text)


@dataclass
class LanguageTables:
    """Any number of languages, 64 to a table, in the languages' order."""

    tables: list[LanguageFilters]

    @property
    def languages(self) -> list[str]:
        return [l for t in self.tables for l in t.languages]

    def predict(self, text: str | None) -> tuple[str, float]:
        return best_language(self.tables, text)


def best_language(tables: list[LanguageFilters], text: str | None) -> tuple[str, float]:
    if text is None or not any(t.languages for t in tables) or not has_letter(text):
        return UNKNOWN, 0.0
    shares = []
    for t in tables:
        hits, total = t.counts(text)
        shares.append((hits / total - t.rates) / (1 - t.rates))
    share = np.concatenate(shares)
    best = int(np.argmax(share))
    return [l for t in tables for l in t.languages][best], float(min(1.0, max(0.0, share[best])))


def fit_language_filters(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_per_language: int = 2000, grams_per_language: int = 6000, seed: int = 4) -> LanguageFilters | LanguageTables:
    """Learn the filters from the labelled rows of docs.

    The bound: about ``sample_per_language`` texts of a language, chosen by a hash of the id, and its
    ``grams_per_language`` most frequent n-grams (ties by key). Only those n-grams come to the
    driver, of 64 languages at a time. Beyond 64 languages the result has several tables.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return LanguageFilters.build({})
    spark, size = docs.sparkSession, known.schema[lang_col].dataType.simpleString()
    least = spark.createDataFrame([(l, int(min(1.0, sample_per_language / n) * (1 << 28))) for l, n in sizes.items()], f"_lang {size}, _most long")
    drawn = F.xxhash64(F.col(id_col), F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFF)) < F.col("_most")
    chosen = known.join(F.broadcast(least), (F.col(lang_col) == F.col("_lang")) & drawn)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for language, text in zip(batch["lang"], batch["text"], strict=True):
                seen.setdefault(language, []).extend(gram_pieces(text))
        for language, parts in seen.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"lang": language, "gram": keys.view(np.int64), "n": n})

    counted = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= grams_per_language).select("lang", "gram")
    build = lambda rows: LanguageFilters.build({l: g["gram"].to_numpy(np.int64).view(np.uint64) for l, g in rows.groupby("lang")})
    if len(sizes) <= 64:
        return build(top.toPandas())
    top, names = materialise(top, "grams"), sorted(sizes)
    return LanguageTables([build(top.where(F.col("lang").isin(names[k : k + 64])).toPandas()) for k in range(0, len(names), 64)])


def identify_language(docs: DataFrame, filters: LanguageFilters | LanguageTables, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, any carried columns, lang_pred and score."""
    names = own_columns([id_col, *carry], ("lang_pred", "score"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [filters.predict(t if isinstance(t, str) else None) for t in batch[text_col]]
            out = batch[names].copy()
            out["lang_pred"], out["score"] = [x[0] for x in got], np.array([x[1] for x in got], float)
            yield out
        trim_memory()

    return docs.select(*dict.fromkeys([*names, text_col])).mapInPandas(run, f"{fields}, lang_pred string, score double")
