"""Small inline relations: requirement rules over the test corpus, clauses of contracts, evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.operators.extract import Terms
from lexmill.operators.mapping import Rules
from lexmill.plans.analysis import Requirement

#: Requirements over the driver's documents, whose lines stand for clauses.
CORPUS_RULES = (
    Rules(code="LICENSE", confirm_threshold=5, exact_phrases=("released under the MIT License", "licensed under the Apache License"), aliases=("GNU General Public License",), keyword_groups=(("license", "version"), ("license", "mit")), negative_patterns=("all rights reserved",)),
    Rules(code="RIGHTS", confirm_threshold=5, exact_phrases=("all rights reserved",), aliases=("CC BY-NC 4.0",), keyword_groups=(("rights", "reserved"),), section_heading_terms=("license", "licensed"), negative_patterns=("mit license",)),
    Rules(code="COMMON", confirm_threshold=8, exact_phrases=("of the", "in the"), aliases=("and", "that"), keyword_groups=(("the", "in", "of"),), section_heading_terms=("the",), negative_patterns=("is",), weights={"alias": 2}),
    Rules(code="CONJUNCTION", confirm_threshold=8, exact_phrases=("and",), aliases=("of",), keyword_groups=(("to", "a"),), section_heading_terms=("the",)),
    Rules(code="ACCENT", confirm_threshold=6, exact_phrases=("le",), aliases=("é", "è"), keyword_groups=(("de", "la"),), negative_patterns=("eau",)),
)

TERMS = Terms(
    cap_phrases=("shall not exceed", "limited to"), unlimited_phrases=("without limit", "unlimited liability"), composite_phrases=("greater of", "whichever is less"),
    units={"MONTHS": ("months", "calendar months"), "DAYS": ("days", "calendar days", "consecutive days"), "USD": ("dollars",)},
    bases={"FEES_PAID": ("fees paid", "amounts paid"), "FEES_PAYABLE": ("fees payable",)},
    exceptions=(("DATA", "Data breach", ("data breach", "personal data")), ("IP", None, ("infringement",))),
)

#: (clause id, text). Sentences of the shapes that contracts have.
CLAUSES = (
    ("c01", "The liability of either party shall not exceed twelve (12) months of the fees paid."),
    ("c02", "Liability is limited to 15 (fifteen) calendar days of fees payable under this agreement."),
    ("c03", "Liability for a data breach shall not exceed 1,250,000.50 dollars of amounts paid."),
    ("c04", "For infringement and personal data the supplier accepts unlimited liability."),
    ("c05", "Liability shall not exceed the greater of 6 months of fees paid or 100 dollars."),
    ("c06", "Liability shall not exceed six months of fees paid."),
    ("c07", "The parties meet every 30 days to talk about service levels."),
    ("c08", " \t "),
    ("c09", "Liability is limited to  24\nconsecutive days."),
    ("c10", "The supplier is liable without limit; shall not exceed 3 months."),
    ("c11", "Damages shall not exceed 12monthsly but 7 days of Fees Paid, then 9 months."),
    ("c12", "Liability shall not exceed 2.5 months of fees payable or fees paid."),
    ("c13", "Clients shall not exceedingly rely on 4 months."),
)

STANDARD = dict(scope="A", unit="UNIT_X", basis="P", preferred=10.0)
NO_RULE = dict(has_rule=False)
RULE = dict(has_rule=True, acceptable_max=20.0, approval_required_above=30.0, unlimited_outcome="UNACCEPTABLE")


def _cap(kind="PRIMARY", scope="A", label=None, status="FINITE", value=10.0, unit="UNIT_X", basis="P", evidence="e1"):
    return (kind, scope, label, status, value, unit, basis, evidence)


#: (case, standard, rule, facts status, caps, expected (kind, scope, label, classification, outcome)).
NUMERIC_CASES = (
    ("N01", STANDARD, NO_RULE, "COMPLETE", [_cap()], [("PRIMARY", "A", None, "MATCH", "NOT_APPLICABLE")]),
    ("N02", STANDARD, NO_RULE, "COMPLETE", [], [("PRIMARY", "A", None, "MISSING", "NOT_APPLICABLE")]),
    ("N03", STANDARD, RULE, "COMPLETE", [_cap(), _cap(value=20.0, evidence="e2")], [("PRIMARY", "A", None, "CONFLICT", "NOT_APPLICABLE")]),
    ("N04", STANDARD, RULE | dict(comparable_scopes=["B"]), "COMPLETE", [_cap(), _cap("EXCEPTION", "B", "b", value=25.0, evidence="e2"), _cap("EXCEPTION", "C", None, "UNLIMITED", None, None, None, "e3")],
     [("PRIMARY", "A", None, "MATCH", "NOT_APPLICABLE"), ("EXCEPTION", "B", "b", "DEVIATION", "APPROVAL_REQUIRED"), ("EXCEPTION", "C", None, "DEVIATION", "UNACCEPTABLE")]),
    ("N05", STANDARD, RULE, "COMPLETE", [_cap(scope="UNKNOWN")], [("PRIMARY", "UNKNOWN", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N06", STANDARD, RULE, "COMPLETE", [_cap(unit="UNIT_Y")], [("PRIMARY", "A", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N07", STANDARD, RULE, "COMPLETE", [_cap(basis="Q")], [("PRIMARY", "A", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N08", STANDARD, RULE | dict(comparable_bases=["Q"]), "COMPLETE", [_cap(basis="Q", value=12.0)], [("PRIMARY", "A", None, "DEVIATION", "ACCEPTABLE")]),
    ("N09", STANDARD, RULE, "COMPLETE", [_cap(value=15.0)], [("PRIMARY", "A", None, "DEVIATION", "ACCEPTABLE")]),
    ("N10", STANDARD, RULE, "COMPLETE", [_cap(value=25.0)], [("PRIMARY", "A", None, "DEVIATION", "APPROVAL_REQUIRED")]),
    ("N11", STANDARD, RULE, "COMPLETE", [_cap(value=31.0)], [("PRIMARY", "A", None, "DEVIATION", "APPROVAL_REQUIRED")]),
    ("N12", STANDARD, NO_RULE, "COMPLETE", [_cap(value=9.0)], [("PRIMARY", "A", None, "DEVIATION", "NOT_APPLICABLE")]),
    ("N13", STANDARD, dict(has_rule=True, deviation_outcome="UNACCEPTABLE", acceptable_max=20.0), "COMPLETE", [_cap(value=9.0)], [("PRIMARY", "A", None, "DEVIATION", "UNACCEPTABLE")]),
    ("N14", STANDARD, dict(has_rule=True, deviation_outcome="SOMETHING"), "COMPLETE", [_cap(value=9.0)], [("PRIMARY", "A", None, "DEVIATION", "NOT_APPLICABLE")]),
    ("N15", STANDARD, dict(has_rule=True), "COMPLETE", [_cap(status="UNLIMITED", value=None, unit=None)], [("PRIMARY", "A", None, "DEVIATION", "NOT_APPLICABLE")]),
    ("N16", STANDARD, RULE, "COMPLETE", [_cap(status="ABSENT", value=None)], [("PRIMARY", "A", None, "MISSING", "NOT_APPLICABLE")]),
    ("N17", STANDARD, RULE, "COMPLETE", [_cap(status="UNKNOWN", value=None)], [("PRIMARY", "A", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N18", STANDARD, RULE, "COMPLETE", [_cap(value=None)], [("PRIMARY", "A", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N19", STANDARD | dict(preferred=None), RULE, "COMPLETE", [_cap()], [("PRIMARY", "A", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N20", STANDARD | dict(scope=None), RULE, "COMPLETE", [_cap()], [("PRIMARY", "A", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N21", STANDARD, RULE, "FAILED", [], [("PRIMARY", "A", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N22", STANDARD | dict(scope=""), RULE, None, [], [("PRIMARY", "UNKNOWN", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N23", STANDARD, RULE, "PARTIAL", [_cap(), _cap(evidence="e2")], [("PRIMARY", "A", None, "MATCH", "NOT_APPLICABLE")]),
    ("N24", STANDARD, RULE | dict(scope_required=False, comparable_scopes=["UNKNOWN"]), "COMPLETE", [_cap(scope="UNKNOWN")], [("PRIMARY", "UNKNOWN", None, "MATCH", "NOT_APPLICABLE")]),
    ("N25", STANDARD | dict(basis=None), RULE, "COMPLETE", [_cap(basis=None)], [("PRIMARY", "A", None, "UNABLE_TO_EVALUATE", "NOT_APPLICABLE")]),
    ("N26", STANDARD, RULE, "COMPLETE", [_cap(value=None, basis=None, status="UNLIMITED", unit=None), _cap(value=None, basis=None, status="UNLIMITED", unit=None, evidence="e2")], [("PRIMARY", "A", None, "DEVIATION", "UNACCEPTABLE")]),
    ("N27", STANDARD, RULE, "COMPLETE", [_cap("EXCEPTION", label="x"), _cap("EXCEPTION", label="y", value=12.0, evidence="e2")], [("EXCEPTION", "A", "x", "MATCH", "NOT_APPLICABLE"), ("EXCEPTION", "A", "y", "DEVIATION", "ACCEPTABLE")]),
)

#: (case, mapping state, expected presence, required, has rule, deviation outcome, expected (classification, outcome)).
PRESENCE_CASES = (
    ("P01", "CONFIRMED", "PRESENT", True, True, None, ("MATCH", "ACCEPTABLE")),
    ("P02", "CONFIRMED", "PRESENT", True, False, None, ("MATCH", "NOT_APPLICABLE")),
    ("P03", "CONFIRMED", "ABSENT", True, True, "UNACCEPTABLE", ("DEVIATION", "UNACCEPTABLE")),
    ("P04", "CONFIRMED", "ABSENT", True, True, "NONSENSE", ("DEVIATION", "NOT_APPLICABLE")),
    ("P05", "CONFIRMED", "ABSENT", False, False, "UNACCEPTABLE", ("DEVIATION", "NOT_APPLICABLE")),
    ("P06", "NONE", "ABSENT", True, True, None, ("MATCH", "ACCEPTABLE")),
    ("P07", "NONE", "ABSENT", True, False, None, ("MATCH", "NOT_APPLICABLE")),
    ("P08", "NONE", "PRESENT", True, True, None, ("MISSING", "NOT_APPLICABLE")),
    ("P09", "NONE", "PRESENT", False, True, None, None),
    ("P10", "UNRESOLVED", "PRESENT", True, True, None, ("UNABLE_TO_EVALUATE", "NOT_APPLICABLE")),
    ("P11", "AMBIGUOUS", "ABSENT", False, False, None, ("UNABLE_TO_EVALUATE", "NOT_APPLICABLE")),
    ("P12", "CONFIRMED", None, True, True, None, None),
    ("P13", None, "PRESENT", True, True, None, None),
)

SUBJECT = "case_id string, std_scope string, std_unit string, std_basis string, preferred double, has_rule boolean, scope_required boolean, comparable_scopes array<string>, comparable_bases array<string>, deviation_outcome string, unlimited_outcome string, approval_required_above double, acceptable_max double, facts_status string, candidates array<string>"
CAPS = "case_id string, kind string, scope string, scope_label string, status string, value double, unit string, basis string, evidence_id string"
PRESENCE = "case_id string, mapping_state string, expected_presence string, required boolean, has_rule boolean, deviation_outcome string, std_scope string, candidates array<string>"


def numeric_rows() -> tuple[list[tuple], list[tuple]]:
    subjects, caps = [], []
    for case, s, r, status, own, _ in NUMERIC_CASES:
        subjects.append((case, s["scope"], s["unit"], s["basis"], s["preferred"], r["has_rule"], r.get("scope_required"), r.get("comparable_scopes"), r.get("comparable_bases"), r.get("deviation_outcome"), r.get("unlimited_outcome"), r.get("approval_required_above"), r.get("acceptable_max"), status, ["m1", "m2"]))
        caps += [(case, *c) for c in own]
    return subjects, caps


def numeric(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    subjects, caps = numeric_rows()
    return spark.createDataFrame(subjects, SUBJECT), spark.createDataFrame(caps, CAPS)


def presence(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s, e, q, h, d, None, ["m1", "m2"]) for c, s, e, q, h, d, _ in PRESENCE_CASES], PRESENCE)


def clauses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLAUSES), "evidence_id string, content string")


def _quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(_quoted(x) for x in v) + "]::VARCHAR[]"
    return "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], schema: str, name: str) -> str:
    """The rows as a common table expression of that name."""
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "int": "INTEGER", "long": "BIGINT"}
    columns = [c.split(" ") for c in schema.split(", ")]
    casts = ", ".join(f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in columns)
    body = ", ".join("(" + ", ".join(_quoted(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) v({', '.join(c for c, _ in columns)}))"


#: A snapshot over the corpus for the whole analysis.
SNAPSHOT = (
    Requirement(rules=CORPUS_RULES[0], evaluator_type="PRESENCE", document_type="en", expected_presence="PRESENT", required=False, has_rule=True),
    Requirement(rules=CORPUS_RULES[1], evaluator_type="PRESENCE", document_type="en", expected_presence="ABSENT", has_rule=True, deviation_outcome="UNACCEPTABLE"),
    Requirement(rules=CORPUS_RULES[2], evaluator_type="PRESENCE", document_type="en", expected_presence="PRESENT", has_rule=False),
    Requirement(rules=CORPUS_RULES[4], evaluator_type="PRESENCE", document_type="fr", expected_presence="PRESENT", has_rule=True),
)
