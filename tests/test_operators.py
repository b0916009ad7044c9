import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import normalize
from lexmill.operators import access, evaluate, extract, invariants, mapping, reads, report, rollup, segment, workflow
from lexmill.plans import analysis, fixtures
from lexmill.plans.catalogue import QUERIES
from lexmill.sources import sinks, uploads


def test_numeric_cases_all_as_expected(spark):
    subjects, caps = fixtures.numeric(spark)
    got = {}
    for r in evaluate.evaluate_numeric(subjects, caps, ["case_id"]).collect():
        got.setdefault(r.case_id, set()).add((r.evaluation_kind, r.scope_key, r.scope_label, r.classification, r.rule_outcome))
        assert r.evidence or r.classification == "MISSING"
        assert r.evaluator_version
    assert got == {c: set(want) for c, *_, want in fixtures.NUMERIC_CASES}


def test_presence_cases(spark):
    got = {r.case_id: (r.classification, r.rule_outcome) for r in evaluate.evaluate_presence(fixtures.presence(spark), ["case_id"]).collect()}
    assert got == {c[0]: c[-1] for c in fixtures.PRESENCE_CASES if c[-1]}


def model_ladder(cap, s, r):
    kind, scope, label, status, value, unit, basis, _ = cap
    valid = ("ACCEPTABLE", "APPROVAL_REQUIRED", "UNACCEPTABLE", "NOT_APPLICABLE")
    ok = lambda v: v if v in valid else "NOT_APPLICABLE"
    unable = ("UNABLE_TO_EVALUATE", "NOT_APPLICABLE")
    if scope == "UNKNOWN" and r.get("scope_required", True):
        return unable
    if status == "UNKNOWN":
        return unable
    if status == "UNLIMITED":
        return "DEVIATION", ok(r.get("unlimited_outcome")) if r["has_rule"] else "NOT_APPLICABLE"
    if status == "ABSENT":
        return "MISSING", "NOT_APPLICABLE"
    if value is None or unit is None or s["scope"] is None or not (scope == s["scope"] or scope in r.get("comparable_scopes", [])) or unit != s["unit"]:
        return unable
    if basis is None or s["basis"] is None or not (basis == s["basis"] or basis in r.get("comparable_bases", [])) or s["preferred"] is None:
        return unable
    if value == s["preferred"]:
        return "MATCH", "NOT_APPLICABLE"
    if not r["has_rule"]:
        return "DEVIATION", "NOT_APPLICABLE"
    if r.get("deviation_outcome") is not None:
        return "DEVIATION", ok(r["deviation_outcome"])
    top, most = r.get("approval_required_above"), r.get("acceptable_max")
    if top is not None and value > top:
        return "DEVIATION", "APPROVAL_REQUIRED"
    if most is not None:
        return "DEVIATION", "ACCEPTABLE" if value <= most else "APPROVAL_REQUIRED"
    return "DEVIATION", "NOT_APPLICABLE"


def test_ladder_against_model_on_random_caps(spark):
    rng = random.Random(2)
    subjects, caps, want = [], [], {}
    for i in range(600):
        s = dict(scope=rng.choice(["A", "A", None]), unit=rng.choice(["X", "Y"]), basis=rng.choice(["P", None]), preferred=rng.choice([10.0, 10.0, None]))
        r = dict(has_rule=rng.random() < 0.8)
        for k, vs in dict(scope_required=[True, False], comparable_scopes=[["B"], ["UNKNOWN"]], comparable_bases=[["Q"]], deviation_outcome=["UNACCEPTABLE", "odd"], unlimited_outcome=["ACCEPTABLE", "odd"], approval_required_above=[15.0, 5.0], acceptable_max=[12.0, 20.0]).items():
            if rng.random() < 0.4:
                r[k] = rng.choice(vs)
        cap = (rng.choice(["PRIMARY", "EXCEPTION"]), rng.choice(["A", "A", "B", "UNKNOWN"]), None, rng.choice(["FINITE"] * 5 + ["UNLIMITED", "ABSENT", "UNKNOWN"]), rng.choice([10.0, 12.0, 16.0, None]), rng.choice(["X", "X", "Y", None]), rng.choice(["P", "P", "Q", None]), "e")
        subjects.append((str(i), s["scope"], s["unit"], s["basis"], s["preferred"], r["has_rule"], r.get("scope_required"), r.get("comparable_scopes"), r.get("comparable_bases"), r.get("deviation_outcome"), r.get("unlimited_outcome"), r.get("approval_required_above"), r.get("acceptable_max"), "COMPLETE", []))
        caps.append((str(i), *cap))
        want[str(i)] = model_ladder(cap, s, r)
    rows = evaluate.evaluate_numeric(spark.createDataFrame(subjects, fixtures.SUBJECT), spark.createDataFrame(caps, fixtures.CAPS), ["case_id"]).collect()
    assert {r.case_id: (r.classification, r.rule_outcome) for r in rows} == want


def test_caps_of_clauses(spark):
    got = {}
    for r in extract.extract(fixtures.clauses(spark), [], fixtures.TERMS).collect():
        got.setdefault(r.evidence_id, []).append((r.kind, r.scope, r.status, r.value, r.unit, r.basis))
    assert got["c01"] == [("PRIMARY", "GENERAL", "FINITE", 12.0, "MONTHS", "FEES_PAID")]
    assert got["c02"] == [("PRIMARY", "GENERAL", "FINITE", 15.0, "DAYS", "FEES_PAYABLE")]
    assert got["c03"] == [("EXCEPTION", "DATA", "FINITE", 1250000.5, "USD", "FEES_PAID")]
    assert [c[:3] for c in got["c04"]] == [("EXCEPTION", "DATA", "UNLIMITED"), ("EXCEPTION", "IP", "UNLIMITED")]
    assert got["c05"][0][2:4] == ("UNKNOWN", None) and got["c06"][0][2:4] == ("UNKNOWN", None)
    assert got["c09"][0][3:5] == (24.0, "DAYS") and got["c11"][0][3:5] == (7.0, "DAYS") and got["c12"][0][3:6] == (2.5, "MONTHS", "FEES_PAID")
    assert "c07" not in got and "c08" not in got and "c13" not in got
    status = lambda c: extract.fact_status(fixtures.clauses(spark).filter(c).withColumn("k", F.lit(1)), ["k"], fixtures.TERMS).first().status
    assert [status(c) for c in ("evidence_id = 'c08'", "evidence_id in ('c07', 'c08')", "evidence_id in ('c01', 'c08')", "evidence_id = 'c01'")] == ["FAILED", "COMPLETE", "PARTIAL", "COMPLETE"]


def test_terms_as_data(spark):
    """Terms in rows say of every clause what terms built into a plan say."""
    import json

    odd = extract.Terms(cap_phrases=("limited to", " "), unlimited_phrases=(), units={"B": ("days", "day (s)"), "A": ("days", "consecutive days", "")}, bases={"Z": ("fees",), "C": ("amounts paid", "fees paid")}, exceptions=(("X", None, ()), ("Y", "why", ("liability",))), general_scope="ALL")
    deaf = extract.Terms(units={"DAYS": ("days",)})
    own = {"T": fixtures.TERMS, "ODD": odd, "DEAF": deaf, "BARE": extract.Terms(cap_phrases=("shall not exceed",))}
    more = [(f"m{i}", t) for i, t in enumerate(["Limited to 3 day (s), day", "limited to 1,000 consecutive days of fees", "limited to 1e5 days; liability", None, "\\E limited to 2 days \\Q"])]
    clauses = fixtures.clauses(spark).unionByName(spark.createDataFrame(more, "evidence_id string, content string"))
    from lexmill.functions.text import normalize

    rows = clauses.crossJoin(extract.term_rows(spark, own)).select("requirement", "evidence_id", F.explode(extract.caps_by(normalize(F.col("content")), F.col("terms"))).alias("c")).select("requirement", "evidence_id", "c.*")
    got = sorted(map(tuple, rows.collect()), key=repr)
    want = sorted(((code, *r) for code, t in own.items() for r in map(tuple, extract.extract(clauses, [], t).collect())), key=repr)
    assert got == want and {g[0] for g in got} == {"T", "ODD", "BARE"}
    stored = [("listed", json.dumps({"extraction": {"units": ["Days"], "cap_phrases": ["x"]}})), ("null", None), ("broken", "{"), ("none", "{}"), ("kinds", json.dumps({"extraction": {"units": 5, "cap_phrases": "x", "exceptions": {}, "general_scope": ""}}))]
    read = {r.requirement: r.terms for r in extract.read_terms(spark.createDataFrame(stored, "requirement string, payload string")).collect()}
    assert read["listed"].units == {"days": "Days"} and read["listed"].usable and read["listed"].number
    assert all(not read[k].usable and read[k].general_scope == "GENERAL" and read[k].number is None for k in ("null", "broken", "none", "kinds"))


def test_rules_parse_and_round_trip():
    for bad in (None, {}, {"confirm_threshold": True}, {"confirm_threshold": "5"}, {"confirm_threshold": None}):
        with pytest.raises(mapping.Misconfigured):
            mapping.Rules.parse("R", bad)
    r = mapping.Rules.parse("R", {"confirm_threshold": 5, "exact_phrases": None, "keyword_groups": [["a", "b"]], "tie_margin": 1, "weights": {"alias": 4}})
    again = mapping.Rules.parse("R", r.payload())
    assert again.payload() == r.payload() and r.payload()["weights"]["negative_pattern"] == -5


def test_scoring_order_and_states(spark):
    rules = [mapping.Rules(code="R", confirm_threshold=5, exact_phrases=("limit of liability",), aliases=("cap",), keyword_groups=((), ("fees", "paid")), section_heading_terms=("liability",), negative_patterns=("client",))]
    rows = [("d1", "1", "Limit  of\nLiability: cap on fees PAID by client", "Liability"), ("d1", "2", "lien", None), ("d2", "1", "a cap", None), ("d3", "1", "nothing", ""), ("d4", "1", "handicap", "x")]
    df = spark.createDataFrame(rows, "doc string, evidence_id string, content string, section_title string")
    s = mapping.score(df, rules, "content", "section_title")
    first = s.filter("doc = 'd1' and evidence_id = '1'").select("score", mapping.explanation(F.col("signals")).alias("x")).first()
    assert first.score == 5 + 3 + 3 + 2 - 5
    assert first.x == ["exact_phrase: 'limit of liability' (+5)", "alias: 'cap' (+3)", "keyword_group: 'fees + paid' (+3)", "section_heading: 'liability' (+2)", "negative_pattern: 'client' (-5)"]
    states = {r.doc: (r.state, r.evidence) for r in mapping.state(s, ["doc"], F.col("evidence_id")).collect()}
    assert states == {"d1": ("CONFIRMED", ["1"]), "d2": ("UNRESOLVED", ["1"]), "d3": ("NONE", []), "d4": ("NONE", [])}


def test_paragraph_offsets_with_repeats(spark):
    texts = ["a\n\na\n \na\n\n\n\nb", "", "one", "\n\nx\n\n", "8. Title here\nbody\n\nSection 9: Next."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", segment.paragraphs(F.col("t")).alias("p")).collect():
        want = re.split(r"\n\s*\n", texts[r.i])
        assert [x.raw for x in r.p] == want
        assert all(texts[r.i][x.start_offset : x.end_offset] == x.raw for x in r.p)
        assert all(a.end_offset <= b.start_offset for a, b in zip(r.p, r.p[1:], strict=False))
    s = segment.segments(df, ["i"], "t", F.lit(100)).filter("i = 4").orderBy("ordinal").collect()
    assert [(x.section_number, x.section_title, x.start_offset) for x in s] == [("8", "Title here", 100), ("9", ": Next." .strip(" .:-"), 120)]


def docx(paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:pPr><w:pStyle w:val='Body'/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_uploads(spark, tmp_path):
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a.txt", "x")
    files = [("a", docx(["First", "", "Second  one"], [["x", "y"], ["1", "2"]]), uploads.DOCX), ("b", b"%PDF-1.7 body", uploads.PDF), ("c", plain.getvalue(), uploads.DOCX), ("d", b"", uploads.PDF), ("e", b"hello", "text/plain"), ("f", b"%PDF-", uploads.DOCX), ("g", b"PK\x03\x04broken", uploads.DOCX)]
    df = spark.createDataFrame(files, "name string, content binary, declared string")
    sniffed = uploads.sniff(df)
    got = {r.name: r.why for r in sniffed.select("name", uploads.rejection(F.col("content"), F.col("declared"), F.col("actual_mime")).alias("why")).collect()}
    assert got == {"a": None, "b": None, "c": "UNRECOGNISED_CONTENT", "d": "EMPTY_FILE", "e": "UNSUPPORTED_TYPE", "f": "CONTENT_TYPE_MISMATCH", "g": "UNRECOGNISED_CONTENT"}
    seg = [(r.content, r.source_type, r.start_offset, r.end_offset) for r in uploads.parse(sniffed.filter("name = 'a'"), "name").orderBy("ordinal").collect()]
    assert seg == [("First", "NATIVE_TEXT", 0, 5), ("Second one", "NATIVE_TEXT", 7, 18), ("x\ty\n1\t2", "TABLE", 19, 26)]
    assert {r.error for r in uploads.parse(sniffed.filter("name in ('b')"), "name").collect()} == {"pages needed"}
    pages = spark.createDataFrame([("b", 1, "First page with its own text.\n\nA second paragraph."), ("b", 2, None), ("b", 3, "Third page, again with text."), ("x", 1, "of another file, passed over")], "name string, page_number int, text string")
    got = [(r.name, r.page_number, r.content, r.start_offset, r.error) for r in uploads.parse(sniffed.filter("name in ('b', 'f')"), "name", pages).orderBy("name", "page_number", "start_offset").collect()]
    assert got == [("b", 1, "First page with its own text.", 0, None), ("b", 1, "A second paragraph.", 31, None), ("b", 3, "Third page, again with text.", 50, None), ("f", None, None, None, "pages needed")]


def test_unreadable_documents_are_rows(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    made = []
    for xml, flags in ((f"<w:document {w}/>", 0), ("<broken", 0), (f"<w:document {w}><w:body/></w:document>", 1)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", xml)
        raw = bytearray(out.getvalue())
        for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the flag of an encrypted part
            raw[raw.index(mark) + at] |= flags
        made.append(bytes(raw))
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate([*made, b"PK\x03\x04broken"])], "name string, content binary")
    got = {r.name: r.error for r in uploads.docx_segments(df, "name").collect()}
    assert got == {"0": "no body", "1": "ParseError", "2": "RuntimeError", "3": "BadZipFile"}
    assert {r.name: r.actual_mime for r in uploads.sniff(df).collect()} == {"0": uploads.DOCX, "1": uploads.DOCX, "2": uploads.DOCX, "3": None}


def test_objects_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([("a.pdf", b"one"), ("b.pdf", b"two"), ("c.pdf", b"one"), ("d.docx", b"three")], "name string, content binary")
    path = f"{tmp_path}/objects"
    sinks.put_objects(df.limit(3), path)
    files = sorted(str(f) for f in tmp_path.rglob("*.parquet"))
    sinks.put_objects(df, path)  # only what is new is written, and nothing that was there is touched
    sinks.put_objects(df, path)
    assert spark.read.parquet(path).count() == 3 and set(files) <= {str(f) for f in tmp_path.rglob("*.parquet")}
    keys = df.select(sinks.object_key(F.col("content"), F.col("name")).alias("storage_key")).filter("storage_key like '%docx'").union(spark.createDataFrame([("ab/none.pdf",)], "storage_key string"))
    assert [bytes(r.content) for r in sinks.stored_objects(spark, path, keys).collect()] == [b"three"]
    rows = spark.createDataFrame([(i % 7, i) for i in range(20)], "k int, v int")
    for part in (rows.filter("v < 9"), rows, rows):
        sinks.append_new(part, f"{tmp_path}/rows", ["k"])
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == list(range(7))


def test_analysis_of_contracts(spark, tmp_path):
    cap = mapping.Rules(code="CAP", confirm_threshold=5, exact_phrases=("liability",))
    notice = mapping.Rules(code="NOTICE", confirm_threshold=5, exact_phrases=("notice period",))
    snapshot = [
        analysis.Requirement(rules=cap, preferred=12.0, unit="MONTHS", basis="FEES_PAID", scope_key="GENERAL", terms=fixtures.TERMS, has_rule=True, deviation_outcome="UNACCEPTABLE"),
        analysis.Requirement(rules=notice, evaluator_type="PRESENCE", expected_presence="PRESENT", required=False),
    ]
    rows = [("r1", "MSA", "1", fixtures.CLAUSES[0][1], None), ("r1", "MSA", "2", "A notice period applies.", None), ("r2", "MSA", "1", "Liability shall not exceed 6 months of the fees paid.", None), ("r3", "MSA", "1", "Nothing here.", None), ("r4", "NDA", "1", fixtures.CLAUSES[0][1], None)]
    out = analysis.run_analysis(spark.createDataFrame(rows, "review_id string, document_type string, evidence_id string, content string, section_title string"), snapshot)
    got = {(r.review_id, r.requirement): (r.classification, r.requires_decision) for r in out["findings"].collect()}
    assert got == {("r1", "CAP"): ("MATCH", False), ("r1", "NOTICE"): ("MATCH", False), ("r2", "CAP"): ("DEVIATION", True)}
    assert {(r.review_id, r.requirement) for r in out["skipped"].collect()} == {("r2", "NOTICE"), ("r3", "NOTICE")}
    assert {(r.review_id, r.requirement, r.failure) for r in out["failures"].collect()} == {("r3", "CAP", "evaluation without evidence")}
    assert {r.review_id: r.next_status for r in out["reviews"].collect()} == {"r1": "RESOLVED", "r2": "LEGAL_REVIEW", "r3": "RESOLVED", "r4": "RESOLVED"}
    key = F.concat_ws(":", "review_id", "requirement").alias("finding_id")
    findings, evaluations = out["findings"].select(key, "classification"), out["evaluations"].select(key, "classification", "rule_outcome", "evidence")
    for _ in range(2):  # a run that is written again replaces itself
        sinks.publish_analysis(findings, evaluations, f"{tmp_path}/a", "1")
    assert sinks.published_evaluations(spark, f"{tmp_path}/a").count() == evaluations.count() == 3
    evaluations.write.parquet(f"{tmp_path}/a/evaluations/run=9")  # a run that broke off is not seen
    assert sinks.published_evaluations(spark, f"{tmp_path}/a").count() == 3
    with pytest.raises(invariants.InvariantBroken, match="finding_stored"):
        sinks.publish_analysis(findings, evaluations, f"{tmp_path}/a", "2")
    with pytest.raises(invariants.InvariantBroken, match="finding_without_evaluation"):
        sinks.publish_analysis(findings, evaluations.limit(0), f"{tmp_path}/b", "1")


def test_a_body_is_normalized_once_for_all_tests(spark):
    own = extract.Terms(cap_phrases=["cap", "(limit)", "a+b", "été d'or"], unlimited_phrases=["no  cap", "x\x01y"], units={"DAYS": ["days", "(net) days"]}, bases={"B": ["fee's", "fees paid"]}, exceptions=[("S", None, ["data_1", "§ 9"])])
    said = ["Cap 1,200 (net) days, fees\u2003PAID", "caps 3 days", "x(limit)y 4 days", " (limit) 4.5days of fee's", "a+b", "aa+b", "Été\td'or\n\n7 days", "no\xa0 cap", "x\x01y", "x\x01 y", "\x01cap\x01 § 9", "cap§ 9", "cap § 99 data_1", "cap data_12", "", None, "\u2003 \x85", "cap _fees paid 12345 days"]
    rows = spark.createDataFrame([("R", s) for s in said], "requirement string, content string")
    body = normalize(F.col("content"))
    read = rows.join(F.broadcast(extract.term_rows(spark, {"R": own})), "requirement").select("content", extract.caps(body, own).alias("one"), extract.caps_by(body, F.col("terms")).alias("by"))
    assert [(r.content, r.by) for r in read.collect()] == [(r.content, r.one) for r in read.collect()]
    plan = rows.join(extract.term_rows(spark, {"R": own}), "requirement").select(extract.caps_by(body, F.col("terms")).alias("by"))._jdf.queryExecution().analyzed().toString().split("Join")[0]
    assert plan.count("coalesce(content") == 1


def test_clauses_are_read_where_they_are_scored(spark):
    """One shuffle of clauses: none to fetch them again, none to bring the caps of a scope together."""
    terms = extract.Terms(cap_phrases=("shall not exceed",), units={"MONTHS": ("months",)}, bases={"FEES": ("fees",)})
    r = analysis.Requirement(rules=mapping.Rules(code="C", confirm_threshold=5, exact_phrases=("liability",)), terms=terms, preferred=12.0, unit="MONTHS", basis="FEES", scope_key="GENERAL", has_rule=True)
    said = [("a", "1", "Liability shall not exceed 12 months of fees."), ("a", "1", "Liability shall not exceed 12 months of fees."), ("a", "2", "Liability shall not exceed 12 months of fees."), ("b", "1", "Liability shall not exceed 12 months of fees."), ("b", "2", "Liability shall not exceed 3 months of fees."), ("c", "1", "Nothing."), ("d", "1", "Liability is a word."), ("e", None, "Liability shall not exceed 12 months of fees.")]
    rows = spark.createDataFrame([(*s, "MSA", None) for s in said], "review_id string, evidence_id string, content string, document_type string, section_title string")
    got = analysis.run_analysis(rows, [r])
    assert {(x.review_id, x.classification, tuple(x.evidence)) for x in got["evaluations"].collect()} == {("a", "MATCH", ("1", "2")), ("b", "CONFLICT", ("1", "2")), ("d", "MISSING", ()), ("e", "UNABLE_TO_EVALUATE", (None,))}
    assert [x.review_id for x in got["failures"].collect()] == ["c"]
    for rows in (got["evaluations"], QUERIES["contract_evaluations"](spark, "/root/testdata/sf0.001")):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_parts_of_findings_are_told_apart_in_one_shuffle(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("a", 2, "x"), (None, 1, "x"), (None, 1, "x")], "k string, n int, t string")
    assert sorted(map(str, reads.told_apart(rows, "k").collect())) == sorted(map(str, rows.distinct().collect()))
    plan = QUERIES["findings_nested"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Findings, evaluations, links and evidence, each once, and the linked evidence by finding.
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 5


def test_both_standards_are_held_against_one_reading(spark):
    rows = spark.createDataFrame([("expected", "k", "x"), ("actual", "k", "x"), ("expected", None, "x"), ("actual", None, None), ("expected", "a", None), ("actual", "b", "x")], "side string, key string, v string")
    one = report.difference(rows.filter("side = 'expected'"), rows.filter("side = 'actual'"), ["key"], ["v"])
    got = report.difference_of(rows, "side", ["key"], ["v"])
    assert set(got.collect()) == set(one.collect()) and got.count() == 4
    plan = QUERIES["contract_change_impact"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # line items for states and for clauses, not again for the other standards


def test_findings_and_evaluations_meet_once(spark, monkeypatch):
    findings = lambda *ids: spark.createDataFrame([(i,) for i in ids], "k string")
    for f, e in ((("a", "b"), ("a", "b", "b")), (("a", "a"), ("a",)), (("a", None), ("a", None)), ((), (None, "x")), (("a",), ()), ((None, None), ("y", "y"))):
        got, (f, e) = invariants.unpaired(findings(*f), findings(*e), "k"), (findings(*f), findings(*e))
        one = {"finding_without_evaluation": invariants.without_evaluation(f, e, "k"), "duplicate_finding": invariants.duplicates(f, ["k"]), "evaluation_without_finding": invariants.dangling(e, "k", f, "k")}
        assert {n: df.isEmpty() for n, df in got.items()} == {n: df.isEmpty() for n, df in one.items()}
    read = []
    monkeypatch.setattr(sinks, "publish_analysis", lambda f, e, path, run, own=sinks.publish_analysis: read.extend(f.inputFiles() + e.inputFiles()) or own(f, e, path, run))
    assert QUERIES["published_findings"](spark, "/root/testdata/sf0.001").count() > 0
    assert read and not any("lineitem" in f for f in read)  # joined once for all runs


def test_one_requirement_never_stops_another(spark):
    rules = lambda code: mapping.Rules(code=code, confirm_threshold=5, exact_phrases=("liability",))
    snapshot = [
        analysis.Requirement(rules=rules("ODD"), evaluator_type="GUESS"), analysis.Requirement(rules=rules("BARE"), evaluator_type="PRESENCE"), analysis.Requirement(rules=rules("DEAF"), preferred=1.0, unit="MONTHS", basis="FEES_PAID", scope_key="GENERAL"),
        analysis.Requirement(rules=rules("CAP"), preferred=12.0, unit="MONTHS", basis="FEES_PAID", scope_key="GENERAL", terms=fixtures.TERMS),
    ]
    rows = [("r1", "MSA", "1", fixtures.CLAUSES[0][1], None), ("r2", None, "1", fixtures.CLAUSES[0][1], None)]
    out = analysis.run_analysis(spark.createDataFrame(rows, "review_id string, document_type string, evidence_id string, content string, section_title string"), snapshot)
    assert {(r.requirement, r.classification) for r in out["findings"].collect()} == {("CAP", "MATCH"), ("DEAF", "UNABLE_TO_EVALUATE")}
    assert {(r.requirement, r.failure) for r in out["failures"].collect()} == {("ODD", "unknown evaluator_type"), ("BARE", "no expected_presence")}
    assert [(r.review_id, r.refusal) for r in out["refused"].collect()] == [("r2", "document type not declared")]
    assert {r.refusal for r in analysis.refusals(spark.createDataFrame(rows[:1], "review_id string, document_type string, evidence_id string, content string, section_title string"), [analysis.Requirement(rules=rules("X"), document_type="")]).collect()} == {"untyped snapshot"}


def test_status_and_report_edges(spark):
    rows = [("f1", True, None), ("f1", True, "REQUEST_CLARIFICATION"), ("f2", True, None), ("f3", True, "REJECT"), ("f3", False, None), ("f4", False, None)]
    got = {r.f: (r.status, r.resolved) for r in rollup.finding_status(spark.createDataFrame(rows, "f string, requires boolean, decision_type string"), ["f"]).collect()}
    assert got == {"f1": ("AWAITING_CLARIFICATION", False), "f2": ("DECISION_REQUIRED", False), "f3": ("RESOLVED", True), "f4": ("OPEN", True)}
    none = spark.createDataFrame([], "classification string")
    assert rollup.fail_closed_rate(none).first().fail_closed_rate is None
    reviews = spark.createDataFrame([("r",)], "review_id string")
    empty = spark.createDataFrame([], "review_id string, requires_decision boolean, resolved boolean")
    assert rollup.review_outcome(empty, reviews, "review_id").first().next_status == "RESOLVED"
    a, b = spark.createDataFrame([("k", None, 1), ("x", "l", 2)], "a string, b string, v int"), spark.createDataFrame([("k", None, 1), ("x", "l", 3), ("y", None, 1)], "a string, b string, v int")
    assert sorted((r.a, r.verdict) for r in report.difference(a, b, ["a", "b"], ["v"]).collect()) == [("k", "same"), ("x", "changed"), ("y", "unexpected")]


def test_access_order(spark):
    r = spark.range(1).select(access.access_outcome(F.lit(None).cast("boolean"), F.lit(True)).alias("a"), access.access_outcome(F.lit(True), F.lit(None).cast("boolean")).alias("b"), access.access_outcome(F.lit(True), F.lit(True)).alias("c"), workflow.transition_allowed(F.lit("CLOSED"), F.lit("DRAFT")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("NOT_FOUND", "FORBIDDEN", "OK", False)


def test_versions_without_contract_or_hash(spark):
    from lexmill.operators import ingest

    stored = spark.createDataFrame([(1, 1, "a", 10), (1, 2, None, 11), (None, 4, "a", 12)], "contract_id long, version_number long, file_hash string, version_id long")
    uploads = spark.createDataFrame([(1, 20, "a", "x"), (1, 21, None, "y"), (1, 22, "b", "z"), (None, 23, "a", "v"), (2, 24, None, "w"), (2, 25, None, "w")], "contract_id long, upload_id long, file_hash string, number string")
    got = {r.upload_id: (r.version_number, r.duplicate_of, r.number) for r in ingest.new_versions(uploads, stored).collect()}
    assert got == {20: (3, 10, "x"), 21: (4, 11, "y"), 22: (5, None, "z"), 23: (5, 12, "v"), 24: (1, None, "w"), 25: (2, 24, "w")}
    assert ingest.new_versions(uploads.limit(0), stored).collect() == []
