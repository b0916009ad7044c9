
from __future__ import annotations

from lexmill.plans.registry import COVERS

EARLIER = {
    "access_authority_count": "F22 J12 A16 Y9",
    "access_caller_reviews": "S12 F3 F4 F11 H3",
    "access_effective_permissions": "J11 J13 A26 U2 H11",
    "access_grant_guard": "U1 O18",
    "access_legal_scope": "F2 F10 J9 Y19",
    "access_missing_grants": "J15 O19 H16",
    "access_outcome": "F12 Y8",
    "access_replace_set": "U6 H16",
    "access_visible_reviews": "F11 J10",
    "analysis_findings": "F5 M9 O1 Y12",
    "analysis_refusal": "O2",
    "audit_page": "F1 F14 T5 T6 H9",
    "classification_histogram": "A18 O17",
    "config_carry_forward": "O11 H15",
    "config_file_validation": "O13",
    "config_latest_version": "W2",
    "config_new_snapshots": "K6",
    "config_page": "A14 T5 T6",
    "config_publish_complete": "J5 J6 O10 H15",
    "config_snapshot_hash": "A27",
    "config_untyped": "F6",
    "config_upsert_plan": "K7",
    "decision_commands": "K5 O7 H14 Y5",
    "decision_current": "J14 W3 Y10",
    "decision_effective": "W5",
    "decision_history": "F18 W4 H7",
    "decision_next_version": "A13 W6",
    "decision_outstanding": "A17",
    "decision_required": "F18 F19 F20",
    "dup_documents": "J16 Z16",
    "dup_first_version": "J16 W7",
    "escalation_requests": "O9 H14 Y6",
    "escalation_withdraw": "O9 Y6",
    "eval_applicability": "V15",
    "eval_optional_suppressed": "V4",
    "eval_scope_conflict": "A4 A5 V11",
    "fail_closed_rate": "A20 Z19",
    "finding_resolved": "A9 A10",
    "finding_status": "A9 A10",
    "functions_content_id": "Z17",
    "ingest_next_version": "A13",
    "inv_closed_sets": "F7 I7",
    "inv_composite_fk": "I5",
    "inv_dangling": "I5",
    "inv_ev_min": "I1",
    "inv_evidence_cardinality": "V18 I4",
    "inv_unique": "I3",
    "latest_completed_run": "S13 W1",
    "lifecycle_valid": "F23",
    "lifecycle_walk": "O5 O8",
    "map_confirmed_evidence": "A3 T1",
    "map_explanation": "Z12 M8",
    "map_heading": "Z8 M5",
    "map_keyword_group": "Z23 M4",
    "map_many_to_many": "M7",
    "map_negative": "M3",
    "map_negative_population": "J20 A29 O24",
    "map_score": "J1 J2 A1 A2",
    "map_signals": "J1 J2 M2 M3",
    "map_state": "F8 F9 M6",
    "omit_legal_position": "F13",
    "page_with_total": "A14 T5",
    "rate_limit_sliding": "W13 R5",
    "redact_event_values": "F16 Z14",
    "redact_fields": "F16",
    "report_review": "A15 A19 Z20 H5",
    "review_advance": "A11 A12 O6",
    "review_first": "J17 W8",
    "review_list_scoped": "H3",
    "rollup_finding": "A7 A8 V17",
    "rollup_tier": "V17",
    "run_summary": "A21 A22 Y11",
    "segment_evidence_ids": "Z17",
    "segment_html_pages": "S3",
    "segment_lines": "Z6",
    "segment_offsets": "Z5 Z6 Z7",
    "segment_page_offsets": "W11",
    "segment_paragraphs": "Z5 Z6 Z7",
    "segment_status": "S3 A24",
    "session_valid": "F21",
    "snapshot_items": "S14 J3 J4",
    "text_conservative_normalize": "Z2",
    "text_normalize": "Z1",
    "text_phrase_match": "Z3",
    "text_phrase_unicode_boundary": "Z3",
    "wait_seconds": "Z22 O15",
}


def by_id() -> dict[str, list[str]]:
    """The queries that show each id of the inventory."""
    found: dict[str, list[str]] = {}
    for name, ids in (EARLIER | COVERS).items():
        for i in ids.split():
            found.setdefault(i, []).append(name)
    return found
