"""Text, segmentation and ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import segment, workflow
from lexmill.plans.registry import query, table

#: For RE2: white space and word characters, boundaries by what is next to the phrase.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def body_sql(column: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({column}, ''), '{WS}+', ' ', 'g')))"


def contains_sql(column: str, phrase: str) -> str:
    import re

    p = T.fold(phrase)
    quoted = re.sub(r"([.\\+*?\[\](){}^$|])", r"\\\1", p).replace("'", "''")
    return f"regexp_matches({column}, '(^|[^\\p{{L}}\\p{{N}}_]){quoted}($|[^\\p{{L}}\\p{{N}}_])')" if p else "false"


@query("text_normalize", f"SELECT doc_id, sha256({body_sql('text')}) AS body_sha256, CAST(length({body_sql('text')}) AS INTEGER) AS body_length FROM documents")
def text_normalize(spark, d):
    body = T.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.fingerprint(body).alias("body_sha256"), F.length(body).alias("body_length"))


_PHRASES = ("the", "mit license", "all rights reserved", "of the", "version 2.0.")


@query("text_phrase_match", f"WITH b AS (SELECT doc_id, {body_sql('text')} AS body FROM documents) SELECT doc_id, " + ", ".join(f"{contains_sql('body', p)} AS has_{i}" for i, p in enumerate(_PHRASES)) + " FROM b")
def text_phrase_match(spark, d):
    b = table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("body"))
    return b.select("doc_id", *[T.contains_phrase(F.col("body"), p).alias(f"has_{i}") for i, p in enumerate(_PHRASES)])


_ACCENTS = ("é", "eau", "la", "ß", "ción")


@query(
    "text_phrase_unicode_boundary",
    f"WITH b AS (SELECT {body_sql('text')} AS body FROM documents) " + " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER (WHERE {contains_sql('body', p)}) AS documents FROM b" for p in _ACCENTS),
)
def text_phrase_unicode_boundary(spark, d):
    b = table(spark, d, "documents").select(T.normalize(F.col("text")).alias("body"))
    counts = b.agg(*[F.count_if(T.contains_phrase(F.col("body"), p)).alias(f"n{i}") for i, p in enumerate(_ACCENTS)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"n{i}").alias("documents")) for i, p in enumerate(_ACCENTS)])).alias("x")).select("x.*")


@query("text_conservative_normalize", rf"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{{A0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g')) AS sha FROM documents
""")
def text_conservative_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint(T.normalize_text(F.col("text"))).alias("sha"))


@query("segment_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM documents)
SELECT doc_id, line_no, CAST(length(content) AS INTEGER) AS n, md5(content) AS md5 FROM l
""")
def segment_lines(spark, d):
    return segment.lines(table(spark, d, "documents")).select("doc_id", "line_no", F.length("content").alias("n"), F.md5("content").alias("md5"))


#: Turns of a conversation, joined with blank lines, are paragraphs.
_TALKS = "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


def _talks(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


@query("segment_paragraphs", rf"""
WITH t AS ({_TALKS}), b AS (SELECT conv_id, unnest(regexp_split_to_array(text, '\n{WS}*\n')) AS raw FROM t),
n AS (SELECT conv_id, regexp_replace(regexp_replace(regexp_replace(raw, '[ \t\x{{A0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') AS content FROM b)
SELECT conv_id, count(*) AS segments, CAST(sum(length(content)) AS BIGINT) AS characters FROM n WHERE content <> '' GROUP BY conv_id
""")
def segment_paragraphs(spark, d):
    s = segment.segments(_talks(spark, d), ["conv_id"])
    return s.groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum(F.length("content")).alias("characters"))


@query("segment_offsets", rf"""
WITH t AS ({_TALKS}) SELECT conv_id, CAST(length(text) AS BIGINT) AS characters, true AS exact FROM t
""")
def segment_offsets(spark, d):
    """Every paragraph is found again at its offsets, and the last ends where the text ends."""
    talks = _talks(spark, d)
    p = talks.select("conv_id", "text", segment.paragraphs(F.col("text")).alias("p"))
    right = F.forall("p", lambda x: F.call_function("substring", F.col("text"), x["start_offset"] + 1, x["end_offset"] - x["start_offset"]) == x["raw"])
    return p.select("conv_id", F.element_at("p", -1)["end_offset"].cast("long").alias("characters"), right.alias("exact"))


_HEADS = [(1, "8. Liability cap"), (2, "8.2 Liability."), (3, "Section 12.3.4 - Term:"), (4, "ARTICLE IV Notices"), (5, "Article 7"), (6, "30 days' notice"), (7, "Payment terms"), (8, "  9.1   Fees  "), (9, "CLAUSE 5.Fees"), (10, ""), (11, "1 " + "x" * 220), (12, "Articles IV"), (13, "12 (a) thing")]
_HEADS_SQL = ", ".join(f"({i}, '{h.replace(chr(39), chr(39) * 2)}')" for i, h in _HEADS)


@query("segment_clause_number", rf"""
WITH h AS (SELECT CAST(id AS BIGINT) AS id, trim(line) AS t FROM (VALUES {_HEADS_SQL}) v(id, line)), m AS (
SELECT id, t, length(t) BETWEEN 1 AND 200 AS fits, '^(\d+(?:\.\d+)*)\.?\s+([A-Z][^\n]{{0,120}})?' AS p1, '^(?:Section|SECTION|Clause|CLAUSE)\s+(\d+(?:\.\d+)*)\.?\s*([^\n]{{0,120}})' AS p2, '^(?:Article|ARTICLE)\s+([IVXLC]+|\d+)\.?\s*([^\n]{{0,120}})' AS p3 FROM h)
SELECT id, CASE WHEN NOT fits THEN NULL WHEN regexp_matches(t, p1) THEN regexp_extract(t, p1, 1) WHEN regexp_matches(t, p2) THEN regexp_extract(t, p2, 1) WHEN regexp_matches(t, p3) THEN regexp_extract(t, p3, 1) END AS number,
nullif(CASE WHEN NOT fits THEN NULL WHEN regexp_matches(t, p1) THEN trim(regexp_extract(t, p1, 2), ' .:-') WHEN regexp_matches(t, p2) THEN trim(regexp_extract(t, p2, 2), ' .:-') WHEN regexp_matches(t, p3) THEN trim(regexp_extract(t, p3, 2), ' .:-') END, '') AS title FROM m
""")
def segment_clause_number(spark, d):
    heads = spark.createDataFrame(_HEADS, "id long, line string")
    return heads.select("id", T.clause_number(F.col("line")).alias("c")).select("id", "c.number", "c.title")


@query("segment_status", r"""
WITH p AS (SELECT conv_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AS usable FROM conversations),
a AS (SELECT conv_id, count(*) AS pages, count(*) FILTER (WHERE usable) AS extracted FROM p GROUP BY conv_id)
SELECT conv_id, pages, extracted, CASE WHEN extracted = 0 THEN 'FAILED' WHEN extracted < pages THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM a
""")
def segment_status(spark, d):
    return segment.page_status(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("segment_html_pages", r"SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')) >= 20 AS usable FROM pages")
def segment_html_pages(spark, d):
    return table(spark, d, "pages").select("page_id", segment.usable(F.regexp_replace("html", "<[^>]*>", "")).alias("usable"))


@query("segment_page_offsets", r"""
WITH p AS (SELECT conv_id, turn, text, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AS usable FROM conversations)
SELECT conv_id, turn, usable, CAST(coalesce(sum(CASE WHEN usable THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base_offset FROM p
""")
def segment_page_offsets(spark, d):
    return segment.page_offsets(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "usable", "base_offset")


@query("dup_documents", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS first_id, count(*) OVER (PARTITION BY text) AS copies, sha256(text) AS file_hash FROM documents")
def dup_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("file_hash"))
    # Firsts and counts come from a partial aggregate, so a file sent in many times is no hot window.
    per = docs.groupBy("file_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return docs.join(per, "file_hash").select("doc_id", "first_id", "copies", "file_hash")


@query("dup_first_version", "SELECT source, sha256(text) AS file_hash, min(doc_id) AS first_version FROM documents GROUP BY source, text HAVING count(*) > 1")
def dup_first_version(spark, d):
    docs = table(spark, d, "documents").select("source", T.fingerprint(F.col("text")).alias("file_hash"), "doc_id")
    return docs.groupBy("source", "file_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_version")).filter("n > 1").drop("n")


@query("ingest_next_version", "SELECT source, max(doc_id) + 1 AS next_version FROM documents GROUP BY source")
def ingest_next_version(spark, d):
    return workflow.next_version(table(spark, d, "documents"), ["source"], "doc_id")


_NAMES = [(1, "Contract v2.pdf"), (2, "../../etc/passwd"), (3, "naïve: draft?.DOCX"), (4, "***"), (5, "  a_b-c.txt "), (6, "x.tar.docx")]


@query("functions_names", r"""
WITH n AS (SELECT CAST(id AS BIGINT) AS id, name FROM (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in _NAMES) + r""") v(id, name))
SELECT id, coalesce(nullif(trim(regexp_replace(name, '[^\p{L}\p{N}._\- ]', '', 'g')), ''), 'document') AS safe, CASE WHEN lower(regexp_extract(name, '(\.[^.]*)$', 1)) IN ('.pdf', '.docx') THEN lower(regexp_extract(name, '(\.[^.]*)$', 1)) ELSE '' END AS suffix, regexp_full_match(name, '[A-Za-z0-9._:-]{1,200}') AS request_id, upper(trim(name)) AS role, lower(trim(name)) AS email FROM n
""")
def functions_names(spark, d):
    n = F.col("name")
    rows = spark.createDataFrame(_NAMES, "id long, name string")
    return rows.select("id", T.safe_filename(n).alias("safe"), T.suffix(n).alias("suffix"), T.safe_request_id(n).alias("request_id"), T.role_code(n).alias("role"), T.email_key(n).alias("email"))
