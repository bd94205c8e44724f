"""Scans: files of many kinds as documents, datasets, checkpoints, catalogues."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import sys
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.folders import read_files
from inkwell.sources.office import cells_of, sheet_rows

# Kinds of files that may be uploaded, and encodings in the order in which they are tried.
UPLOADS = "txt text md markdown pdf docx csv json log xml html htm".split()
ENCODINGS = {"csv": ("utf-8-sig", "utf-8", "gbk"), "text": ("utf-8", "utf-16", "gbk")}
#: How readers fail on files that are damaged, encrypted or not what their name says.
UNREADABLE = (
    ValueError, LookupError, AttributeError, TypeError, RuntimeError, EOFError, OSError,
    csv.Error, zlib.error, zipfile.BadZipFile, ElementTree.ParseError,
)
_SUFFIX = re.compile(r"\.([^./\\]+)$")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(raw: bytes, encodings: tuple[str, ...]) -> str:
    """The text in the first encoding that fits."""
    for name in encodings:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


def docx_text(raw: bytes) -> str:
    """Paragraphs that aren't empty, then table rows with their cells joined by tabs."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    found = [said(p) for p in body.findall(f"{_W}p")]
    rows = ["\t".join(said(c) for c in row.findall(f"{_W}tc")) for table in body.findall(f"{_W}tbl") for row in table.findall(f"{_W}tr")]
    return "\n\n".join([x for x in found if x] + rows)


def csv_text(raw: bytes) -> str:
    csv.field_size_limit(sys.maxsize)  # a cell may be as long as its file
    rows = csv.reader(io.StringIO(decode(raw, ENCODINGS["csv"])))
    return "\n".join("\t".join(c.strip() for c in row) for row in rows)


def _to_text(suffix: str, raw: bytes) -> str | None:
    try:
        if suffix == "docx":
            return docx_text(raw)
        if suffix == "xlsx":
            return "\n".join("\t".join(row) for row in sheet_rows(raw))
        if suffix == "csv":
            return csv_text(raw)
        return None if suffix in ("pdf", "doc", "xls", "pptx") else decode(raw, ENCODINGS["text"])
    except UNREADABLE:
        return None


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, _SUFFIX.pattern, 1))


def may_upload(name: Column) -> Column:
    """A known kind of file, by a plain name."""
    return suffix_of(name).isin(UPLOADS) & ~name.contains("/") & ~name.contains("\\") & ~name.contains("..")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """source_name, suffix, content, content_sha256 (of the bytes), readable: every file under a path.

    Kinds whose readers aren't installed, and files that no encoding fits, have no content.
    """

    def read(name: str, raw: bytes) -> list[tuple]:
        suffix = _SUFFIX.search(name)
        return [(name, _to_text(suffix[1].lower() if suffix else "", raw), hashlib.sha256(raw).hexdigest())]

    found = read_files(spark, path, read, "source_name string, content string, content_sha256 string")
    return found.select("source_name", suffix_of(F.col("source_name")).alias("suffix"), "content", "content_sha256", F.col("content").isNotNull().alias("readable"))


def csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_name, content: each CSV file's rows, cells trimmed and joined by tabs."""
    return documents(spark, path).where("suffix = 'csv' and readable").select("source_name", "content")


def spreadsheet_rows(spark: SparkSession, path: str, header: dict[str, str]) -> DataFrame:
    """Rows of the first sheets under a path, with the columns that ``header`` maps titles to; unreadable files have none."""
    cells = cells_of(spark, path, list(header))
    return cells.select(*[F.col("cells")[k].alias(c) for k, c in enumerate(header.values())])


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """question, ground_truth of a JSON-lines dataset; blank lines are skipped, no rows are an error."""
    rows = spark.read.schema("question string, ground_truth string, source string").json(path).where("question is not null")
    if rows.isEmpty():
        raise ValueError(f"no questions in {path}")
    return rows


def checkpoint(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last whole line of each key; half-written lines are skipped.

    Files follow each other by their time of change, then by name; lines by their place in the file.
    """
    place = F.struct(
        "_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")
    )
    lines = spark.read.text(path).select("value", place.alias("line"))
    rows = lines.select("line", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(f"r.{key}").agg(F.max_by("r", "line").alias("r")).select("r.*")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def tables(spark: SparkSession, pattern: str = "*", hidden: str = "gen_") -> DataFrame:
    """table, column, type, position of the session's tables whose name fits, but for hidden ones."""
    found = [
        (t.name, c.name, c.dataType, k)
        for t in spark.catalog.listTables(pattern=pattern)
        if not t.name.startswith(hidden)
        for k, c in enumerate(spark.catalog.listColumns(t.name))
    ]
    return spark.createDataFrame(found, "table string, column string, type string, position int")
