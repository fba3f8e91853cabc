"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from tidemark.plans import community_queries, evidence_queries, graph_queries, latest_queries, paged_queries, role_queries, search_queries, skill_queries, source_queries, state_queries, text_queries, view_queries

MODULES = (evidence_queries, graph_queries, source_queries, community_queries, text_queries, skill_queries, search_queries, paged_queries, role_queries, state_queries, view_queries, latest_queries)

QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: text for m in MODULES for name, text in m.ORACLE.items()}
