"""Queries by name and the SQL that gives the same rows."""

from __future__ import annotations

from facetlake.queries import behavior, extraction, records, relations, retrieval, texts

MODULES = (texts, retrieval, behavior, relations, extraction, records)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
