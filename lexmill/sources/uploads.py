"""Uploaded files: validation, format by content, and their text as segments."""

from __future__ import annotations

import zipfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import normalize_text

PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MAX_BYTES = 100 * 1024 * 1024
#: What a container that is broken, encrypted or packed in an unknown way raises when it is opened.
UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, ValueError, OSError)
#: A task hands on segments whenever it holds so many characters of them, or so many rows.
PIECE, PIECE_ROWS = 4_000_000, 20_000
SEGMENT = "ordinal int, content string, original_content string, source_type string, page_number int, style string, start_offset long, end_offset long, error string"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content", "length")


def sniff(files: DataFrame, content: str = "content") -> DataFrame:
    """files with actual_mime: PDF by its first bytes, DOCX if a zip holds its main part; else null."""

    def members(batches):
        import io

        for batch in batches:
            found = []
            for raw in batch[content]:
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                        found.append("word/document.xml" in z.namelist())
                except UNREADABLE:
                    found.append(False)
            batch["__docx"] = found
            yield batch

    head = lambda n: F.substring(F.col(content), 1, n)
    pdf = files.withColumn("__pdf", head(5) == F.lit(b"%PDF-")).withColumn("__zip", head(4) == F.lit(b"PK\x03\x04"))
    zips = pdf.filter(F.coalesce(F.col("__zip"), F.lit(False)))
    # Only zip containers are opened; everything else is decided by its first bytes.
    opened = zips.mapInPandas(members, zips.withColumn("__docx", F.lit(True)).schema)
    rest = pdf.filter(~F.coalesce(F.col("__zip"), F.lit(False))).withColumn("__docx", F.lit(False))
    kind = F.when(F.col("__pdf"), PDF).when(F.col("__docx"), DOCX)
    return rest.unionByName(opened).withColumn("actual_mime", kind).drop("__pdf", "__zip", "__docx")


def rejection(content: Column, declared: Column, actual: Column, limit: int = MAX_BYTES) -> Column:
    """Why an upload is refused, the first reason that holds; null where it is not."""
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "EMPTY_FILE")
        .when(F.octet_length(content) > limit, "FILE_TOO_LARGE")
        .when(~F.coalesce(declared.isin(PDF, DOCX), F.lit(False)), "UNSUPPORTED_TYPE")
        .when(actual.isNull(), "UNRECOGNISED_CONTENT")
        .when(actual != declared, "CONTENT_TYPE_MISMATCH")
    )


def docx_segments(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, segment fields) of DOCX files: their paragraphs, then their tables; a file that cannot be read is a row
    with an error and no text.

    Every paragraph moves the offset on, empty ones too; tables go on from there.
    """
    kind = files.select(key).schema[0].dataType.simpleString()

    def parse(batches):
        import io
        import xml.etree.ElementTree as ET

        import pandas as pd

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def text_of(p) -> str:
            return "".join({f"{w}t": n.text or "", f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}.get(n.tag, "") for n in p.iter())

        columns = [key, "ordinal", "content", "original_content", "source_type", "page_number", "style", "start_offset", "end_offset", "error"]
        for batch in batches:
            rows, size = [], 0
            for name, raw in zip(batch[key], batch[content], strict=True):
                if size >= PIECE or len(rows) >= PIECE_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                        body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
                    problem = "no body" if body is None else None
                except (KeyError, ET.ParseError, *UNREADABLE) as e:
                    problem = type(e).__name__
                if problem:
                    rows.append((name, 0, None, None, None, None, None, None, None, problem))
                    continue
                at = n = 0
                for p in body.findall(f"{w}p"):
                    t = text_of(p)
                    style = p.find(f"{w}pPr/{w}pStyle")
                    if t.strip():
                        rows.append((name, n, t, t, "NATIVE_TEXT", None, style.get(f"{w}val") if style is not None else None, at, at + len(t), None))
                        n += 1
                    at += len(t) + 1
                for table in body.findall(f"{w}tbl"):
                    t = "\n".join("\t".join("\n".join(text_of(p) for p in c.findall(f"{w}p")) for c in r.findall(f"{w}tc")) for r in table.findall(f"{w}tr"))
                    if t.strip():
                        rows.append((name, n, t, t, "TABLE", None, None, at, at + len(t), None))
                        n += 1
                    at += len(t) + 1
                size += at
            yield pd.DataFrame(rows, columns=columns)

    raw = files.select(key, content).mapInPandas(parse, f"`{key}` {kind}, {SEGMENT}")
    # Cells of a table stay apart: tabs between them are part of its text.
    return raw.withColumn("content", F.when(F.col("source_type") == "TABLE", F.col("content")).otherwise(normalize_text(F.col("content"))))


def page_segments(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Segments of documents that come as pages of extracted text; pages with too little of it are passed over."""
    from lexmill.operators.segment import page_offsets, segments

    placed = page_offsets(pages, document, page, text).filter("usable")
    return segments(placed, [document, page], text, F.col("base_offset"))


def parse(files: DataFrame, key: str, pages: DataFrame | None = None) -> DataFrame:
    """Segments of validated files by format.

    PDF files need a parser that is not part of the library: pages (key, page_number, text) are what it read of them,
    with a null text for a page that it could not read. A PDF without pages, and any file of another format, is a row
    with an error, as is one that cannot be opened.
    """
    docx = docx_segments(files.filter(F.col("actual_mime") == DOCX), key)
    other = files.filter(~F.coalesce(F.col("actual_mime") == DOCX, F.lit(False)))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in docx.schema.fields if f.name not in (key, "error", "ordinal")]
    out = docx
    if pages is not None:
        read = page_segments(pages.join(other.filter(F.col("actual_mime") == PDF).select(key), key, "left_semi"), key, "page_number", "text")
        made = {"source_type": F.lit("NATIVE_TEXT"), "style": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
        out = out.unionByName(read.select(*[made[c].alias(c) if c in made else F.col(c).cast(docx.schema[c].dataType).alias(c) for c in docx.columns]))
        other = other.join(read.select(key), key, "left_anti")
    why = F.when(F.col("actual_mime") == PDF, "pages needed").otherwise("unsupported format")
    return out.unionByName(other.select(key, F.lit(0).alias("ordinal"), *empty, why.alias("error")))
