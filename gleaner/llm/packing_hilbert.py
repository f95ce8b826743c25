"""Packing documents into sequences along a space-filling curve.

Each document's token ids are hashed into a vector; a fixed random projection takes
it to a few dimensions, each cut into 2**ORDER steps, and the cell's place on the
Hilbert curve is the document's key. The documents are range-sorted by that key and
laid end to end, so neighbours in a sequence are neighbours on the curve. The line
is cut every ``length`` tokens: only its very last sequence can need padding, and
none does where that is a power of two long.

Plan. Texts are tokenised once into a table. One range shuffle, by key and a hash of
the id (copies share a key, so the hash splits them), sorts it; each task numbers
its tokens from 0 and writes them with its partition's number. The partitions'
token totals, one number each, give every partition its offset on the line, and a
document's pieces then follow from its own row.

Edge cases: a null or empty text is the end token alone; a document longer than a
sequence spans several; repeated rows and null ids are packed like any other row;
an empty table gives no piece; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialise, trim_memory

#: Vector width, projected dimensions, bits of each on the curve.
WIDTH, DIMS, ORDER = 1024, 4, 15
#: Words kept in a worker's memo (about 200 MB with its table); words beyond it are encoded batch by batch.
_MEMO = 600_000
#: Documents and characters tokenised at a time.
_DOCS, _CHARS = 1024, 3_000_000
#: Texts of these characters only are in normal form and change case one by one, so that their
#: pretokens can be looked up singly; the classes are those of the tokenizer's own split, after lower-casing.
_PLAIN = re.compile(r"[\x00-\x1b\x20-įı-ſ]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-ſ\xb2\xb3\xb9\xbc-\xbe]+")


class WordTokenizer:
    """A tokenizers file whose normaliser lower-cases and whose pretokens, which hold no white space, are encoded independently.

    A memo of the words between white space saves most of the work; texts with characters outside
    the plain range go to the library whole. ``exact`` turns the memo off.
    """

    def __init__(self, path: str, exact: bool = False, most: int = _MEMO):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.memo: dict[str, bytes] = {}
        # a pretoken's last token, and no other, carries the end-of-word mark
        size = self.inner.get_vocab_size()
        self.ends = np.array([(self.inner.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.exact, self.most = exact, most

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't in the memo: their unknown pretokens are encoded in one call with spaces between."""
        memo, parts = self.memo, [_SPLIT.findall(w) for w in words]
        flat = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in memo]
        ids = self._whole(" ".join(flat))
        ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(flat) + 1:
            return {w: self._whole(w).tobytes() for w in words}
        raw, cut = ids.tobytes(), (4 * ends).tolist()
        new = dict(zip(flat, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
        return new | {w: b"".join([new[p] if p in new else memo[p] for p in own]) for w, own in zip(words, parts, strict=True) if w not in new}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        get, cut, missed = self.memo.get, [], {}
        for k, text in enumerate(texts):
            if not self.exact and _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
                words = text.lower().split()
                found = [*map(get, words)]
                holes = []
                if None in found:
                    holes = [i for i, x in enumerate(found) if x is None]
                    words = [words[i] for i in holes]
                    missed.update(dict.fromkeys(words))
                    cut.append((k, found, holes, words))
                else:
                    out[k] = np.frombuffer(b"".join(found), "<u4")
            else:
                out[k] = self._whole(text)
        if missed:
            new = self._learn([*missed])
            for k, found, holes, words in cut:
                for i, w in zip(holes, words, strict=True):
                    found[i] = new[w]
                out[k] = np.frombuffer(b"".join(found), "<u4")
            if len(self.memo) < self.most:
                self.memo |= new
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str, memo: int = _MEMO) -> WordTokenizer:
    """One per Python worker, so that its memo lasts over tasks."""
    if path not in _tokenizers:
        trim_memory()
        _tokenizers[path] = WordTokenizer(path, most=memo)
    return _tokenizers[path]


def _forget() -> None:
    """Later stages run in the same workers and need the memory."""
    if _tokenizers:
        _tokenizers.clear()
        trim_memory()


def _slices(sizes: np.ndarray, most: int = _CHARS) -> Iterator[tuple[int, int]]:
    first, chars = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and (chars + n > most or k - first >= _DOCS):
            yield first, k
            first, chars = k, 0
        chars += n
    if first < len(sizes):
        yield first, len(sizes)


def projection(seed: int = 9) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(WIDTH, DIMS))


def hilbert_keys(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates (Skilling's transposed form)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(ids: list[np.ndarray], along: np.ndarray) -> np.ndarray:
    """The documents' Hilbert keys from their token ids; along: the projection."""
    flat = np.empty((len(ids), along.shape[1]))
    for k, one in enumerate(ids):
        places = ((one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
        v = np.sqrt(np.bincount(places, minlength=WIDTH))
        flat[k] = v @ along / max(float(np.linalg.norm(v)), 1e-9)
    cells = np.clip((flat / 3 + 0.5) * (1 << ORDER), 0, (1 << ORDER) - 1)
    return hilbert_keys(cells.astype(np.int64))


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, memo: int = _MEMO, chars: int = _CHARS) -> DataFrame:
    """id, key, tie, n and the ids as little-endian unsigned 16-bit (32-bit where the vocabulary needs it)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, along = worker_tokenizer(tokenizer_path, memo), projection()
        for batch in batches:
            texts = batch[text_col].where(batch[text_col].notna(), "")
            for first, last in _slices(texts.str.len().to_numpy(np.int64), chars):
                ids = [np.append(x, np.uint32(end_id)) for x in tokenizer.encode(texts.iloc[first:last].tolist())]
                yield pd.DataFrame({"id": batch[id_col].iloc[first:last].to_numpy(), "key": curve_keys(ids, along), "n": [len(x) for x in ids], "ids": [(x.astype("<u2") if x.max() < 65536 else x.astype("<u4")).tobytes() for x in ids]})

    made = docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, key long, n long, ids binary")
    return made.withColumn("tie", F.xxhash64(F.col("id").cast("string"), F.lit(9)))


def _laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number this partition's tokens from 0: at is where a document begins."""
    from pyspark import TaskContext

    _forget()
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = at + batch["n"].cumsum()
        yield pd.DataFrame({"id": batch["id"], "part": part, "at": ends - batch["n"], "n": batch["n"], "ids": batch["ids"]})
        at = int(ends.iloc[-1]) if len(batch) else at


def pack_along_curve(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, memo: int = _MEMO, chars: int = _CHARS) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit; null without with_ids), ids_crc32, doc_tokens, sequence_id, offset.

    memo, chars: words whose ids a worker remembers, and characters it tokenises at a time; fewer take less memory and more time.
    """
    table = materialise(tokenised(docs, tokenizer_path, end_id, id_col, text_col, memo, chars), "tokens")
    kind = table.schema["id"].dataType.simpleString()
    ordered = table.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "id", "n")
    line = materialise(ordered.mapInPandas(_laid, f"id {kind}, part int, at long, n long, ids binary"), "line")
    before, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in line.groupBy("part").agg(F.sum("n")).collect()):
        before[part], total = total, total + n

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _forget()
        for batch in batches:
            rows = []
            for id_, part, at, n, raw in zip(batch["id"], batch["part"], batch["at"], batch["n"], batch["ids"], strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                place = before[part] + at
                done = 0
                while done < n:
                    sequence, offset = divmod(place + done, length)
                    size = min(n - done, length - offset)
                    piece = ids[done : done + size].tobytes()
                    rows.append((id_, done, size, piece if with_ids else None, zlib.crc32(piece), n, sequence, offset))
                    done += size
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return line.mapInPandas(cut, f"id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
