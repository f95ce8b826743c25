"""WARC archives with an index merged into capture histories.

Writing. Every page becomes one WARC/1.1 record. Of pages with equal payloads of at
least ``revisit_bytes`` the smallest page_id is a response and the others are
revisits that refer to it and carry no payload; shorter payloads are always
responses. A record is text in UTF-8 as its payload is, so Spark's text writer with
the record terminator as its line separator writes valid archives through the
commit protocol, to any file system that Spark reaches.

An archive holds about ``ARCHIVE_BYTES`` of records (their number a file follows from the
table's mean), in one gzip stream; offsets point into it as it is uncompressed.

Reading. Archives are unpacked piece by piece and parsed record by record by Content-Length,
so a task holds a compressed archive and a record. The records of an archive, sorted by URL
key and timestamp and numbered, are one run of the index.

Merging. An external merge over range partitions: the runs' entries are dealt by
ranges of (URL key, timestamp, page), so a key with very many captures is split
over partitions and the ranges' order is the global order. There are as many ranges as hold
about ``RANGE_ENTRIES`` entries each, whatever the index's size; that bounds a merge's memory.
A range gets each run's slice in the run's order, and nothing else puts entries in order but the
loser tree that merges the slices: each entry is replayed along one path to the root, log2(k)
comparisons. The output is sorted over partitions and within them.

Capture times come from a column, or without one are made up from the page id.

Edge cases: a null page body is an empty payload; null or odd URLs are kept, with
control characters percent-encoded in the header; null page ids, and ids that are no whole
number, are null in the index and get no record that others refer to; of equal index entries any
order is right; repeated rows are records of their own (of rows with the smallest
page_id, all are responses); very long pages are one record; an empty table gives
no archive and an empty index; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialise, scratch_path

_END = "\r\n\r\n"
#: Bytes of records to an archive, and index entries to a range, about.
ARCHIVE_BYTES, RANGE_ENTRIES = 1 << 28, 200_000
#: Compressed and uncompressed bytes that a reader takes at a time.
_PIECE = 1 << 20
INDEX = "url_key string, capture_time string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, record_bytes long"
_EPOCH = 1_577_836_800  # 2020-01-01


def url_key(url: Column) -> Column:
    """Sort-friendly form: the host's labels reversed, then port and path, in lower case; no scheme, no www."""
    low = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/:?#]*)", 1), r"^www\d*\.", "")
    tail = F.regexp_replace(F.regexp_extract(rest, r"^[^/:?#]*(.*)$", 1), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def _header_safe(c: Column) -> Column:
    encode = lambda out, chars: out if not chars else encode(F.replace(out, F.lit(chars[0]), F.lit(f"%{ord(chars[0]):02X}")), chars[1:])
    odd = "".join(map(chr, [*range(32), 127]))
    plain = encode(c, "% ")
    return F.when(c.rlike(r"[\x00-\x1f\x7f]"), encode(plain, odd)).otherwise(plain)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", time_col: str | None = None, revisit_bytes: int = 100) -> DataFrame:
    """record: the text of each page's WARC record without its terminator."""
    time = F.unix_timestamp(F.col(time_col)) if time_col else F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(1_000_000_000)) + _EPOCH
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"), time.alias("time"))
    page = page.withColumns({"digest": F.sha2(F.col("body").cast("binary"), 256), "n": F.octet_length("body")})
    # short payloads find no partner; a key of their own spreads them over the tasks
    page = page.withColumn("key", F.when(F.col("n") >= revisit_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    first = page.where(F.col("n") >= revisit_bytes).groupBy("key").agg(F.min("page_id").alias("first"))
    page = page.join(first, "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.timestamp_seconds("time"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), _header_safe(F.col("url"))),
        F.concat(F.lit("X-URL-Key: "), _header_safe(url_key(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return page.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block).alias("record"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **options) -> None:
    """Write gzip-compressed archives of about so many bytes before compression."""
    body = F.octet_length(F.coalesce(F.col(options.get("body_col", "html")), F.lit("")))
    mean = pages.agg(F.avg(body)).first()[0] or 0.0
    most = max(1, int(archive_bytes / (mean + 1000)))
    records(pages, **options).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


class _Unpacked:
    """The uncompressed bytes of an archive as a stream, of which only what is asked for is held."""

    def __init__(self, content: bytes):
        self.content, self.at, self.held, self.read, self.offset = memoryview(content), 0, bytearray(), 0, 0
        self.inner = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
        self.rest = b""

    def _more(self) -> bool:
        if self.read:
            del self.held[: self.read]
            self.read = 0
        if self.inner is None:
            piece = bytes(self.content[self.at : self.at + _PIECE])
            self.at += len(piece)
            self.held += piece
            return bool(piece)
        while True:
            raw = self.rest or bytes(self.content[self.at : self.at + _PIECE])
            if not self.rest:
                self.at += len(raw)
            if not raw and self.at >= len(self.content):
                return False
            piece = self.inner.decompress(raw, _PIECE)
            self.rest = self.inner.unconsumed_tail
            if self.inner.eof:  # the next member
                self.rest, self.inner = self.inner.unused_data, zlib.decompressobj(31)
                if not self.rest and self.at >= len(self.content) and not piece:
                    return False
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to mark and with it; None at the end."""
        seen = 0
        while (k := self.held.find(mark, self.read + max(0, seen - len(mark)))) < 0:
            seen = len(self.held) - self.read
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends within a record")
                return None
        return self.take(k - self.read + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.held) - self.read < size:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[self.read : self.read + size])
        self.read += size
        self.offset += size
        return out


def parse_archive(content: bytes, archive: str) -> Iterator[tuple]:
    """The index entries of one archive's records, in its order. content: gzip or plain."""
    stream = _Unpacked(content)
    while True:
        at = stream.offset
        raw = stream.until(b"\r\n\r\n")
        if raw is None:
            return
        head = dict(x.split(": ", 1) for x in raw[:-4].decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
        size = int(head["Content-Length"])
        http = stream.until(b"\r\n\r\n")
        declared = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest, kind, left, seen = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], size - len(http), hashlib.sha256()
        stored = left
        while left:
            piece = stream.take(min(left, _PIECE))
            seen.update(piece)
            left -= len(piece)
        if kind == "response" and (stored != declared or seen.hexdigest() != digest):
            raise ValueError(f"{archive}: record at {at} is damaged")
        stream.take(4)
        page, of = head["WARC-Record-ID"][10:-1], head.get("WARC-Refers-To")
        yield (unquote(head["X-URL-Key"]), head.get("WARC-Date", ""), None if page == "none" else int(page), unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None, declared, digest, kind, int(of[10:-1]) if of else None, archive, at, stream.offset - at)


_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _order(entry: tuple) -> tuple:
    return (entry[0].encode("utf-8", "surrogatepass"), entry[1], entry[2] is not None, entry[2] or 0)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def read_runs(archives: DataFrame) -> DataFrame:
    """archives: path, content (as Spark's binaryFile gives them). The index entries, with their place in their archive's run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                entries = sorted(parse_archive(content, path.rsplit("/", 1)[-1]), key=_order)
                for first in range(0, len(entries), 10_000):
                    some = entries[first : first + 10_000]
                    yield _frame(some).assign(place=np.arange(first, first + len(some)))

    return archives.select("path", "content").mapInPandas(run, f"{INDEX}, place long")


class LoserTree:
    """Merges sorted lists. Inner nodes hold the list that lost there; the winner is above the root."""

    def __init__(self, lists: list[list[tuple]], key=_order):
        self.lists, self.key, self.k = lists, key, len(lists)
        self.heads: list = [key(x[0]) if x else None for x in lists]
        self.at = [0] * self.k
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:  # the first to come waits for its rival
                self.losers[node] = i
                return
            if self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            i = self.losers[0]
            if self.heads[i] is None:
                return
            yield self.lists[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self.key(self.lists[i][self.at[i]]) if self.at[i] < len(self.lists[i]) else None
            self._replay(i)


def merge_runs(index: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """The entries in global order of URL key, timestamp and page: sorted partitions of ascending ranges.

    index: the entries with archive and place, which is ascending with the order within an archive.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            clean = batch[_NAMES].astype(object).where(batch[_NAMES].notna(), None)
            for entry in clean.itertuples(index=False, name=None):
                slices.setdefault(entry[8], []).append(entry)
        rows: list[tuple] = []
        for entry in LoserTree(list(slices.values())):
            rows.append(entry)
            if len(rows) >= 10_000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)

    ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // range_entries))
    dealt = index.repartitionByRange(ranges, "url_key", "capture_time", "page_id")
    return dealt.sortWithinPartitions("archive", "place").mapInPandas(run, INDEX)


def capture_histories(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages to archives under path (a scratch folder by default), read them back and merge their index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write_archives(pages, path, **options)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return merge_runs(materialise(read_runs(found), "runs"))
