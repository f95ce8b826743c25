"""Sheets and question lists: XLSX by a Python data source, header search, FAQ corpora and query sheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gleaner.functions.text import split_ids, strip

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_names(raw: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def read_sheet(raw: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first by default) as text cells; an unknown sheet is a KeyError."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = {s.get("name"): links[s.get(f"{_REL}id")] for s in book.iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in found:
            raise KeyError(f"no sheet {sheet!r}; there are {', '.join(found)}")
        target = found[sheet] if sheet is not None else next(iter(found.values()))
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        with z.open("xl/" + target.removeprefix("/xl/").removeprefix("xl/")) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r", "A"))
                    cells += [None] * (at + 1 - len(cells))
                    v, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
                    if c.get("t") == "s" and v is not None:
                        cells[at] = shared[int(v.text)]
                    elif inline is not None:
                        cells[at] = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t"))
                    else:
                        cells[at] = v.text if v is not None else None
                yield cells
                row.clear()


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.width, self.options = len(schema.fields) - 1, options

    def partitions(self):
        return [_Part(p) for p in self.options["path"].split(",")]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            raw = f.read()
        for pos, cells in enumerate(read_sheet(raw, self.options.get("sheet"))):
            if pos >= int(self.options.get("skip", 0)):
                yield (pos, *(cells + [None] * self.width)[: self.width])


class XlsxDataSource(DataSource):
    """format('xlsx'): options path (comma-separated), sheet, skip (rows), columns. Gives pos and c0.. as text.

    Files must be readable at the same path on every executor; ``read_xlsx`` reads through Spark instead.
    """

    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return "pos long, " + ", ".join(f"c{k} string" for k in range(int(self.options.get("columns", 8))))

    def reader(self, schema):
        return _Reader(schema, dict(self.options))


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, columns: int = 8, skip: int = 0) -> DataFrame:
    """pos and c0.. as text, for any path that Spark reaches."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                rows = [(p, *(c + [None] * columns)[:columns]) for p, c in enumerate(read_sheet(raw, sheet)) if p >= skip]
                yield pd.DataFrame(rows, columns=["pos", *[f"c{k}" for k in range(columns)]])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "pos long, " + ", ".join(f"c{k} string" for k in range(columns)))


def faq_corpus(rows: DataFrame, id_col: str = "faq_id", text_col: str = "question", pos: str = "pos") -> DataFrame:
    """A repeated id keeps its first place and its last text; rows without an id are dropped."""
    known = rows.where(F.col(id_col).isNotNull() & (F.trim(F.col(id_col).cast("string")) != ""))
    return known.groupBy(id_col).agg(F.min(pos).alias(pos), F.max_by(text_col, pos).alias(text_col))


def find_column(header: list[str | None], keywords: tuple[str, ...]) -> int | None:
    """The first header cell that contains any keyword."""
    return next((k for k, h in enumerate(header) if h and any(w in h for w in keywords)), None)


# fixed values: header keywords of a query sheet
HEADERS = {"gold": ("Primary GT",), "acceptable": ("Acceptable GT",), "negative": ("Hard Negative", "경쟁 FAQ"), "intent": ("처리 의도",)}


def query_sheet(rows: DataFrame, category: str, header: list[str | None] | None = None, keep_intent: str = "FAQ_RAG") -> DataFrame:
    """test_id, category, query, gt_ids, acceptable_ids, hard_neg_ids; rows without id or query and with another intent are dropped."""
    at = {k: find_column(header, words) if header else None for k, words in HEADERS.items()}
    col = lambda name, default: F.col(f"c{at[name]}") if at[name] is not None else default
    fixed = header is None
    ids = lambda c: split_ids(c, marks="[;]" if fixed else "[;,]")
    gold = ids(F.col("c2") if fixed else col("gold", F.lit("")))
    acceptable = ids(F.col("c3") if fixed else col("acceptable", F.lit("")))
    negative = ids(F.col("c4") if fixed else col("negative", F.lit("")))
    intent: Column = F.lit("") if fixed else col("intent", F.lit(""))
    kept = rows.where((strip(F.coalesce("c0", F.lit(""))) != "") & (strip(F.coalesce("c1", F.lit(""))) != "" if not fixed else F.lit(True)) & strip(F.coalesce(intent, F.lit(""))).isin("", keep_intent))
    return kept.select(strip(F.col("c0")).alias("test_id"), F.lit(category).alias("category"), F.col("c1").alias("query"), gold.alias("gt_ids"), F.when(F.size(acceptable) > 0, acceptable).otherwise(gold).alias("acceptable_ids"), negative.alias("hard_neg_ids"), "pos")


def query_workbook(spark: SparkSession, path: str, sheets: dict[str, str], skip: int = 1, warn=print) -> DataFrame | None:
    """All query sheets of a workbook (sheet -> category); one that is missing is a warning."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    there, out = sheet_names(bytes(raw)), None
    for sheet, category in sheets.items():
        if sheet not in there:
            warn(f"no sheet {sheet!r}")
            continue
        header = next(read_sheet(bytes(raw), sheet), [])
        one = query_sheet(read_xlsx(spark, path, sheet, max(8, len(header)), skip), category, header)
        out = one if out is None else out.unionByName(one)
    return out
