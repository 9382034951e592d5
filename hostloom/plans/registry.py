"""All registered queries by name."""

from __future__ import annotations

from hostloom.plans import queries_core, queries_graph, queries_more, queries_score, queries_state, queries_stream

_MODULES = (queries_core, queries_graph, queries_more, queries_score, queries_state, queries_stream)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "det4_detections"
