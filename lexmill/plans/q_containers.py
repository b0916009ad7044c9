"""Containers: documents packed as DOCX files, stored, sniffed and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.registry import query, table
from lexmill.sources import sinks, uploads
from lexmill.sources.scratch import shared_folder


def packed(documents: DataFrame) -> DataFrame:
    """(name, content): each line of a text is a paragraph, and the id with the language a table of two cells; of ids that
    leave 1 by 9 the file is cut short."""

    def pack(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        said = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
        for batch in batches:
            out, size = [], 0
            for doc, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True):
                cells = "".join(f"<w:tc>{said(t)}</w:tc>" for t in (str(doc), lang or ""))
                body = "".join(map(said, (text or "").split("\n"))) + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>"
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
                out.append((f"{doc}.docx", held.getvalue()[: 40 if doc % 9 == 1 else None]))
                size += len(out[-1][1])
                if size >= uploads.PIECE:
                    yield pd.DataFrame(out, columns=["name", "content"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["name", "content"])

    return documents.select("doc_id", "text", "lang").mapInPandas(pack, "name string, content binary")


def stored_segments(spark, d):
    """Segments of the files as they come out of the store, each file opened once."""
    path = shared_folder(spark, "containers")
    sinks.put_objects(packed(table(spark, d, "documents")), path)
    return uploads.docx_segments(sinks.stored_objects(spark, path), "name")


_LINES = r"""p AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents WHERE doc_id % 9 <> 1),
o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM p),
s AS (SELECT doc_id, t, start_, start_ + length(t) AS end_, 'NATIVE_TEXT' AS kind FROM o WHERE regexp_matches(t, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]')
  UNION ALL SELECT doc_id, doc_id || chr(9) || coalesce(any_value(lang), ''), sum(length(t) + 1), sum(length(t) + 1) + length(doc_id || chr(9) || coalesce(any_value(lang), '')), 'TABLE' FROM p GROUP BY doc_id)"""


@query("docx_segments", f"WITH {_LINES} SELECT doc_id || '.docx' AS name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_) - 1 AS BIGINT) AS ordinal, kind AS source_type, md5(t) AS text_md5, CAST(start_ AS BIGINT) AS start_offset, CAST(end_ AS BIGINT) AS end_offset FROM s", ids="S6 S7 S8 W12 U3")
def docx_segments(spark, d):
    rows = stored_segments(spark, d).filter("error is null")
    cast = [F.col(c).cast("long").alias(c) for c in ("ordinal", "start_offset", "end_offset")]
    return rows.select("name", cast[0], "source_type", F.md5(F.col("original_content").cast("binary")).alias("text_md5"), *cast[1:])


@query("docx_unreadable", "SELECT doc_id || '.docx' AS name FROM documents WHERE doc_id % 9 = 1", ids="S2 S9")
def docx_unreadable(spark, d):
    return stored_segments(spark, d).filter("error is not null").select("name")
