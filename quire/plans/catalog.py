"""All queries of the library outside quire.llm, with their SQL."""

from __future__ import annotations

from quire.plans import document_queries, file_queries, glyph_queries, page_queries, presence_queries, status_queries, text_queries

_GROUPS = (page_queries, file_queries, text_queries, glyph_queries, presence_queries, document_queries, status_queries)
QUERIES = {name: f for group in _GROUPS for name, f in group.QUERIES.items()}
ORACLE_SQL = {name: sql for group in _GROUPS for name, sql in group.ORACLE.items()}
