"""Mapping of the driver's documents: a line is a clause, the first line of a text its heading."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.vocab import DEFAULT_WEIGHTS
from lexmill.operators import mapping, segment
from lexmill.plans.fixtures import CORPUS_RULES
from lexmill.plans.q_text import body_sql, contains_sql
from lexmill.plans.registry import query, table


def clauses(spark, d, *more):
    docs = table(spark, d, "documents").select("doc_id", *more, "text", T.first_line(F.col("text")).alias("heading"))
    return docs.select("doc_id", *more, "heading", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "content"))


def scored(spark, d, rules=CORPUS_RULES, signals=False):
    return mapping.score(clauses(spark, d), rules, "content", "heading", signals)


LINES = f"""
lines AS (SELECT doc_id, string_split(text, chr(10))[1] AS heading, unnest(string_split(text, chr(10))) AS content, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM documents),
body AS (SELECT doc_id, line_no, {body_sql('content')} AS body, {body_sql('heading')} AS heading FROM lines)"""


def tests_sql(r: mapping.Rules) -> list[tuple[str, str, str]]:
    found = [("exact_phrase", p, contains_sql("body", p)) for p in r.exact_phrases] + [("alias", p, contains_sql("body", p)) for p in r.aliases]
    found += [("keyword_group", " + ".join(g), "(" + " AND ".join(contains_sql("body", t) for t in g) + ")") for g in r.keyword_groups]
    found += [("section_heading", p, contains_sql("heading", p)) for p in r.section_heading_terms]
    return found + [("negative_pattern", p, contains_sql("body", p)) for p in r.negative_patterns]


def score_sql(r: mapping.Rules, kinds: tuple[str, ...] | None = None) -> str:
    w = DEFAULT_WEIGHTS | r.weights
    return " + ".join([f"CASE WHEN {test} THEN {w[kind]} ELSE 0 END" for kind, _, test in tests_sql(r) if not kinds or kind in kinds] or ["0"])


SCORED = LINES + ", scored AS (" + " UNION ALL ".join(f"SELECT doc_id, line_no, '{r.code}' AS requirement, {r.confirm_threshold} AS threshold, {score_sql(r)} AS score FROM body" for r in CORPUS_RULES) + ")"


@query("map_score", f"WITH {SCORED} SELECT doc_id, line_no, requirement, CAST(score AS INTEGER) AS score FROM scored")
def map_score(spark, d):
    return scored(spark, d).select("doc_id", "line_no", "requirement", "score")


@query(
    "map_signals",
    f"WITH {LINES}, s AS (" + " UNION ALL ".join(f"SELECT '{r.code}' AS requirement, '{kind}' AS kind, '{m.replace(chr(39), '')}' AS matched, {(DEFAULT_WEIGHTS | r.weights)[kind]} AS delta, count(*) FILTER (WHERE {test}) AS clauses FROM body" for r in CORPUS_RULES for kind, m, test in tests_sql(r)) + ") SELECT requirement, kind, matched, CAST(delta AS INTEGER) AS delta, clauses FROM s WHERE clauses > 0",
)
def map_signals(spark, d):
    rows = scored(spark, d, signals=True).select("requirement", F.explode("signals").alias("s")).select("requirement", "s.*")
    return rows.groupBy("requirement", "kind", "matched", "delta").agg(F.count("*").alias("clauses"))


def _kind(name: str, kind: str) -> None:
    """What the signals of one kind add to each clause, for every rule set."""
    per = " UNION ALL ".join(f"SELECT doc_id, line_no, '{r.code}' AS requirement, {score_sql(r, (kind,))} AS delta FROM body" for r in CORPUS_RULES)

    @query(name, f"WITH {LINES}, per AS ({per}) SELECT doc_id, line_no, requirement, CAST(delta AS INTEGER) AS delta FROM per WHERE delta <> 0")
    def run(spark, d):
        rows = scored(spark, d, signals=True)
        delta = F.aggregate(F.filter("signals", lambda s: s["kind"] == kind), F.lit(0), lambda a, s: a + s["delta"])
        return rows.select("doc_id", "line_no", "requirement", delta.alias("delta")).filter("delta <> 0")


_kind("map_keyword_group", "keyword_group")
_kind("map_negative", "negative_pattern")
_kind("map_heading", "section_heading")

STATES = SCORED + """, states AS (
SELECT doc_id, requirement, threshold, count(*) AS clauses, max(score) AS best, count(*) FILTER (WHERE score >= threshold) AS qualifying, count(*) FILTER (WHERE score > 0) AS positive FROM scored GROUP BY doc_id, requirement, threshold),
named AS (SELECT *, CASE WHEN qualifying > 0 THEN 'CONFIRMED' WHEN positive > 0 THEN 'UNRESOLVED' ELSE 'NONE' END AS state FROM states)"""


def states(spark, d):
    return mapping.state(scored(spark, d), ["doc_id"], F.col("line_no"))


@query("map_state", f"WITH {STATES} SELECT doc_id, requirement, state, CAST(best AS INTEGER) AS best, clauses, qualifying FROM named")
def map_state(spark, d):
    return states(spark, d).select("doc_id", "requirement", "state", "best", "clauses", "qualifying")


@query("map_confirmed_evidence", f"""WITH {STATES} SELECT n.doc_id, n.requirement, n.state, coalesce(string_agg(CAST(s.line_no AS VARCHAR), ',' ORDER BY s.score DESC, CAST(s.line_no AS VARCHAR)), '') AS evidence
FROM named n LEFT JOIN scored s ON s.doc_id = n.doc_id AND s.requirement = n.requirement AND CASE WHEN n.state = 'CONFIRMED' THEN s.score >= n.threshold ELSE s.score > 0 END GROUP BY n.doc_id, n.requirement, n.state""")
def map_confirmed_evidence(spark, d):
    return states(spark, d).select("doc_id", "requirement", "state", F.array_join("evidence", ",").alias("evidence"))


@query("map_many_to_many", f"WITH {SCORED} SELECT doc_id, line_no, count(*) AS requirements, string_agg(requirement, ',' ORDER BY requirement) AS codes FROM scored WHERE score >= threshold GROUP BY doc_id, line_no HAVING count(*) > 1")
def map_many_to_many(spark, d):
    hits = scored(spark, d).filter("score >= threshold").groupBy("doc_id", "line_no")
    return hits.agg(F.count("*").alias("requirements"), F.array_join(F.sort_array(F.collect_list("requirement")), ",").alias("codes")).filter("requirements > 1")


def explained_sql(r: mapping.Rules) -> str:
    w = DEFAULT_WEIGHTS | r.weights
    parts = ", ".join(f"CASE WHEN {t} THEN '{k}: ''{m}'' ({w[k]:+d})' END" for k, m, t in tests_sql(r))
    return f"SELECT doc_id, line_no, '{r.code}' AS requirement, concat_ws('; ', {parts}) AS explanation FROM body WHERE {score_sql(r)} > 0"


@query("map_explanation", f"WITH {LINES} " + " UNION ALL ".join(map(explained_sql, CORPUS_RULES)))
def map_explanation(spark, d):
    rows = scored(spark, d, signals=True).filter("score > 0")
    return rows.select("doc_id", "line_no", "requirement", F.array_join(mapping.explanation(F.col("signals")), "; ").alias("explanation"))


@query(
    "map_negative_population",
    f"WITH body AS (SELECT item_id, {body_sql('text')} AS body, '' AS heading FROM benchmark), scored AS ("
    + " UNION ALL ".join(f"SELECT '{r.code}' AS requirement, {r.confirm_threshold} AS threshold, {score_sql(r)} AS score, {' + '.join(f'CAST({t} AS INTEGER)' for k, _, t in tests_sql(r) if k != 'negative_pattern')} AS signals FROM body" for r in CORPUS_RULES)
    + ") SELECT requirement, count(*) AS pairs, count(*) FILTER (WHERE score >= threshold) AS hits, count(*) FILTER (WHERE score >= threshold AND signals = 1) AS single_signal_hits FROM scored GROUP BY requirement",
)
def map_negative_population(spark, d):
    return mapping.precision_check(mapping.score(table(spark, d, "benchmark"), CORPUS_RULES, "text"))


@query("segment_evidence_ids", r"""WITH f AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS raw, unnest(range(len(regexp_split_to_array(text, '\n\s*\n')))) AS k FROM documents),
c AS (SELECT doc_id, k, regexp_replace(regexp_replace(raw, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS content FROM f),
n AS (SELECT *, k AS ordinal FROM c WHERE content <> '')
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, sha256(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(ordinal AS VARCHAR), content)) AS evidence_id FROM n""")
def segment_evidence_ids(spark, d):
    rows = segment.evidence_ids(segment.segments(table(spark, d, "documents"), ["doc_id"]), ["doc_id"])
    return rows.select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "evidence_id")
