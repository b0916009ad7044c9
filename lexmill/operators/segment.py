"""Segmentation of pages, paragraphs and lines into clauses with their places in the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.functions.text import clause_number, content_id, first_line, normalize_text, strip

#: Characters that a page must yield to count as text.
USABLE = 20


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each line as a clause: (key, line_no from 0, content)."""
    return documents.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "content"))


def paragraphs(text: Column) -> Column:
    """array of struct(ordinal, raw, start_offset, end_offset): blocks between blank lines, with code-point offsets.

    Each block is looked for from the end of the one before, so repeated blocks get their own places.
    """
    blocks = F.split(text, r"\n[\s\x0b\x1c-\x1f\x85\p{Z}]*\n", -1)
    kind = "array<struct<ordinal:int,raw:string,start_offset:int,end_offset:int>>"

    def step(state, raw):
        found = F.call_function("locate", raw, text, state["cursor"] + 1) - 1
        start = F.when(raw == "", state["cursor"]).otherwise(F.greatest(found, state["cursor"])).cast("int")
        end = (start + F.length(raw)).cast("int")
        item = F.struct(F.size(state["out"]).alias("ordinal"), raw.alias("raw"), start.alias("start_offset"), end.alias("end_offset"))
        return F.struct(end.alias("cursor"), F.concat(state["out"], F.array(item)).cast(kind).alias("out"))

    first = F.struct(F.lit(0).alias("cursor"), F.array().cast(kind).alias("out"))
    return F.aggregate(blocks, first, step, lambda s: s["out"])


def segments(sources: DataFrame, keys: list[str], text: str = "text", base: Column | None = None) -> DataFrame:
    """One row per non-empty paragraph: normalized content, original, section number and title, absolute offsets."""
    at = base if base is not None else F.lit(0)
    rows = sources.select(*keys, at.cast("long").alias("base"), F.explode(paragraphs(F.col(text))).alias("p"))
    rows = rows.withColumn("content", normalize_text(F.col("p.raw"))).filter(F.col("content") != "")
    named = rows.withColumn("section", clause_number(first_line(F.col("content"))))
    return named.select(
        *keys, F.col("p.ordinal").alias("ordinal"), "content", F.col("p.raw").alias("original_content"),
        F.col("section.number").alias("section_number"), F.col("section.title").alias("section_title"),
        (F.col("base") + F.col("p.start_offset")).alias("start_offset"), (F.col("base") + F.col("p.end_offset")).alias("end_offset"),
    )


def usable(raw: Column) -> Column:
    """Whether a page's own text is enough, so that it needs no recognition."""
    return F.length(strip(F.coalesce(raw, F.lit("")))) >= USABLE


def page_offsets(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """pages with base_offset, the summed length of earlier usable pages, and whether each is usable."""
    own = F.when(usable(F.col(text)), F.length(text)).otherwise(F.lit(0)).cast("long")
    before = W.partitionBy(document).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("usable", usable(F.col(text))).withColumn("base_offset", F.coalesce(F.sum(own).over(before), F.lit(0)).cast("long"))


def extraction_status(extracted: Column, total: Column) -> Column:
    return F.when(extracted == 0, "FAILED").when(extracted < total, "PARTIAL").otherwise("COMPLETE")


def page_status(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, pages, extracted, status) of every document."""
    got = pages.groupBy(document).agg(F.count("*").alias("pages"), F.count_if(usable(F.col(text))).alias("extracted"))
    return got.withColumn("status", extraction_status(F.col("extracted"), F.col("pages")))


def table_text(rows: Column) -> Column:
    """A table given as rows of cells: cells joined by tabs, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t")), "\n")


def evidence_ids(segments_: DataFrame, keys: list[str]) -> DataFrame:
    """segments with an id made of their place and content."""
    parts = [F.col(k).cast("string") for k in keys]
    return segments_.withColumn("evidence_id", content_id(*parts, F.col("ordinal").cast("string"), F.col("content")))
