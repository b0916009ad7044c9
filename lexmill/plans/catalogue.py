"""The engine's own queries, each with its SQL twin."""

from __future__ import annotations

from lexmill.plans import q_access, q_admin, q_cases, q_config, q_containers, q_contracts, q_evaluation, q_ingest, q_mapping, q_names, q_reads, q_rules, q_store, q_streams, q_text, q_verify, q_workflow  # noqa: F401  they register
from lexmill.plans.registry import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]

FLAGSHIP = "map_state"
