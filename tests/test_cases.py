import json

from lexmill.plans import fixtures
from lexmill.sources import configs


def write(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))
    return f"file://{tmp_path}"


def test_all_hand_made_cases_from_files(spark, tmp_path):
    """The cases of the fixtures, written to files of one and of many, come out as they expect."""
    cases = []
    names = ("kind", "scope", "scope_label", "status", "value", "unit", "basis", "evidence_id")
    for case, s, r, status, caps, want in fixtures.NUMERIC_CASES:
        one = {"id": case, **{f"std_{k}" if k != "preferred" else k: v for k, v in s.items()}, **r, "extraction_status": status or "FAILED", "caps": [dict(zip(names, c, strict=True)) for c in caps]}
        cases.append(one | {"expect": [dict(zip(("evaluation_kind", "scope_key", "scope_label", "classification", "rule_outcome"), w, strict=True)) for w in want]})
    for case, state, expected, required, has_rule, outcome, want in fixtures.PRESENCE_CASES:
        expect = [{"evaluation_kind": "PRIMARY", "scope_key": "DEFAULT", "classification": want[0], "rule_outcome": want[1]}] if want else []
        cases.append({"id": case, "evaluator_type": "PRESENCE", "mapping_state": state, "expected_presence": expected, "required": required, "has_rule": has_rule, "deviation_outcome": outcome, "expect": expect})
    at = write(tmp_path, one=cases[0], many=cases[1:20], rest=cases[20:], empty=[])
    items, broken = configs.read_json_files(spark, at)
    good, odd = configs.typed(items)
    assert broken.collect() == [] and odd.collect() == [] and good.count() == len(cases)
    verdicts = configs.judge(good).collect()
    assert {v.verdict for v in verdicts} == {"same"} and len(verdicts) == sum(len(c["expect"]) for c in cases)


def test_odd_files_and_fields(spark, tmp_path):
    at = write(tmp_path, cut='[{"id": "A"', number="5", blank="", text='"x"', null="null", good=[{"id": "A", "more": {"deep": 1}}, 7, {"note": "no id"}, {"id": "B", "preferred": "soon"}, {"id": "C", "caps": {"kind": "x"}}, {"id": "D", "preferred": None, "caps": []}, {"id": "E", "required": "maybe"}])
    items, broken = configs.read_json_files(spark, at)
    got = {r.file.rsplit("/", 1)[1]: r.failure for r in broken.collect()}
    assert got == {"cut.json": "not JSON", "number.json": "neither a list nor an object", "text.json": "neither a list nor an object", "null.json": "neither a list nor an object"}
    good, odd = configs.typed(items)
    assert sorted(r.id for r in good.collect()) == ["A", "D"]
    assert sorted((r.place, r.failure) for r in odd.collect()) == [(1, "no object"), (2, "no id"), (3, "preferred: no double"), (4, "caps: no array"), (6, "required: no boolean")]
    assert {(r.id, r.required, r.extraction_status, r.evaluator_type) for r in good.collect()} == {(i, True, "COMPLETE", "NUMERIC_COMPARISON") for i in "AD"}
