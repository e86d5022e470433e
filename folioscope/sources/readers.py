"""Readers of pages, tables and documents: what Spark's own sources don't parse.

Spark lists and reads the files (any path it can open); the functions here turn contents into rows.
Null or empty content has no rows; content that isn't what it should be gives its error in ``error``.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row long, col long, value string, error string"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """key, text of the Markdown files below a path; drafts and failed folders are left out."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    keyed = files.select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("text"))
    return keyed.where(~F.col("key").rlike("/(drafts|failed)/"))


def frontmatter(text: Column | str, values: str = "quoted", known: list[str] | None = None, strict: bool = False) -> tuple[Column, Column]:
    """(fields as a map, body).

    ``values``: ``quoted`` strips quotes, ``json`` decodes JSON strings and keeps other JSON as written, ``raw`` keeps all.
    ``known``: only these fields.  ``strict``: a header with a line that is no field gives null instead of leaving it out.
    Lines that start with a space continue and are left out; a repeated field keeps its last value.
    """
    t = F.col(text) if isinstance(text, str) else text
    fence = r"(?s)^---\n(.*?)\n---\n"
    head = F.regexp_extract(t, fence, 1)
    every = F.filter(F.split(head, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith(" "))
    lines = F.filter(every, lambda x: x.contains(":"))
    raw = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    value = {"raw": raw, "quoted": lambda x: F.btrim(raw(x), F.lit('"')), "json": lambda x: F.when(raw(x).startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), raw(x), F.lit("}")), "$.v"), raw(x))).otherwise(raw(x))}[values]
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), value(x).alias("value")))
    if known is not None:
        pairs = F.filter(pairs, lambda p: p["key"].isin(known))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    if strict:
        last = F.when(F.size(lines) == F.size(every), last)
    return last, F.regexp_replace(t, fence, "")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of one object a line; missing numbers are zero."""
    return spark.read.schema(schema).json(path).fillna(0)


def delimited(spark: SparkSession, path: str, delimiter: str, needle: str | None = None, header_rows: int = 1) -> DataFrame:
    """line, cells, is_header of a delimited file; with a needle only header rows and rows that have it as a cell, without regard to case."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", f"\\Q{delimiter}\\E").alias("cells")).where(F.exists("cells", lambda c: F.trim(c) != ""))
    first = raw.orderBy("line").limit(header_rows).select("line", F.lit(True).alias("h"))
    marked = raw.join(F.broadcast(first), "line", "left").select("line", "cells", F.coalesce("h", F.lit(False)).alias("is_header"))
    return marked if needle is None else marked.where(F.col("is_header") | F.exists("cells", lambda c: F.lower(F.trim(c)) == needle.lower().strip()))


#: What a damaged, encrypted or hostile file raises while it is read.
BROKEN = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, RuntimeError, NotImplementedError, zlib.error, EOFError, OverflowError)
#: Bytes that one member of an archive may inflate to.
MOST_INFLATED = 200_000_000


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes; one that inflates beyond MOST_INFLATED is an error, whatever its header says."""
    with z.open(name) as f:
        data = f.read(MOST_INFLATED + 1)
    if len(data) > MOST_INFLATED:
        raise ValueError(f"{name} inflates beyond {MOST_INFLATED} bytes")
    return data


class _Bounded(io.RawIOBase):
    """A member as it is inflated, up to MOST_INFLATED."""

    def __init__(self, source, name: str) -> None:
        self.source, self.name, self.left = source, name, MOST_INFLATED

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        data = self.source.read(1 << 16 if n is None or n < 0 else n)
        self.left -= len(data)
        if self.left < 0:
            raise ValueError(f"{self.name} inflates beyond {MOST_INFLATED} bytes")
        return data


def _cells(read) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                try:
                    rows = [(path, *cell, None) for cell in read(bytes(content))] if content is not None and len(content) else []
                except BROKEN as e:
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value", "error"]).astype({"row": "Int64", "col": "Int64"})

    return run


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _xlsx(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ET.iterparse(_Bounded(f, "xl/sharedStrings.xml")):
                    if _local(e.tag) == "si":
                        shared.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
                        e.clear()
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            with z.open(name) as f:
                for _, e in ET.iterparse(_Bounded(f, name)):
                    if _local(e.tag) != "row":
                        continue
                    for c in e:
                        v = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), "")
                        if c.get("t") == "s" and v:
                            if not 0 <= int(v) < len(shared):
                                raise ValueError(f"shared string {v} of {len(shared)}")
                            v = shared[int(v)]
                        if v:
                            yield name[14:-4], int(e.get("r") or 0), _column(c.get("r") or ""), v
                    e.clear()


def _docx(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(_member(z, "word/document.xml"))
    for k, table in enumerate(x for x in root.iter() if _local(x.tag) == "tbl"):
        for i, row in enumerate(x for x in table if _local(x.tag) == "tr"):
            for j, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                text = " ".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in cell.iter() if _local(p.tag) == "p").strip()
                if text:
                    yield f"table{k + 1}", i + 1, j + 1, text


def spreadsheets(files: DataFrame) -> DataFrame:
    """Cells of OOXML workbooks (path, content); shared strings are resolved for cells that use them."""
    return files.select("path", "content").mapInPandas(_cells(_xlsx), CELLS)


def word_tables(files: DataFrame) -> DataFrame:
    """Cells of the tables of Word documents, paragraphs joined by a space."""
    return files.select("path", "content").mapInPandas(_cells(_docx), CELLS)


def archive_members(files: DataFrame, most_bytes: int = 200_000_000) -> DataFrame:
    """path, member, size of archives' files, named ``outer::inner``; system files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content or b""))) as z:
                        rows += [(path, f"{path}::{i.filename}", i.file_size) for i in z.infolist() if not i.is_dir() and i.file_size <= most_bytes and not re.search(r"__MACOSX|\.DS_Store|Thumbs\.db", i.filename)]
                except BROKEN:
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "size"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long")


def tei_markdown(files: DataFrame) -> DataFrame:
    """path, markdown of TEI documents: title, abstract, heads and paragraphs in their order; null without paragraphs."""

    def one(content: bytes | None) -> str | None:
        try:
            root = ET.fromstring(bytes(content or b""))
        except ET.ParseError:
            return None
        text = lambda e: re.sub(r"\s+", " ", "".join(e.itertext())).strip()
        title = next((text(e) for e in root.iter() if _local(e.tag) == "title"), "")
        out, found = [f"# {title}"] if title else [], False
        for e in root.iter():
            kind = _local(e.tag)
            if kind == "abstract":
                out += ["## Abstract"]
            elif kind == "head" and text(e):
                out += [f"## {text(e)}"]
            elif kind == "p" and text(e):
                out, found = out + [text(e)], True
        return "\n\n".join(out) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "markdown": [one(c) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, markdown string")


def tei_header(text: Column) -> Column:
    """Title, surnames, year and DOI from the header alone; what stands below belongs to the references."""
    head = F.substring_index(text, "</teiHeader>", 1)
    return F.struct(
        F.nullif(F.trim(F.regexp_extract(head, "(?s)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"), F.regexp_extract_all(head, F.lit("<surname>([^<]*)</surname>"), F.lit(1)).alias("surnames"),
        F.nullif(F.regexp_extract(head, r'<date[^>]*when="([0-9]{4})', 1), F.lit("")).alias("year"), F.nullif(F.lower(F.regexp_extract(head, '<idno type="DOI">([^<]*)</idno>', 1)), F.lit("")).alias("doi"),
    )


def citations(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, year, doi, types of biomedical citation XML, one row for each article."""
    schema = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,PublicationTypeList:struct<PublicationType:array<string>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:string>>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
    x = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    ids = F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "doi")
    return x.select(F.col("MedlineCitation.PMID").alias("pmid"), F.col("MedlineCitation.Article.ArticleTitle").alias("title"), F.col("MedlineCitation.Article.Journal.JournalIssue.PubDate.Year").alias("year"), F.when(F.size(ids) == 1, F.lower(ids[0]["_VALUE"])).alias("doi"), F.col("MedlineCitation.Article.PublicationTypeList.PublicationType").alias("types"))
