"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from facetlake.llm import queries_audit, queries_free, queries_native

QUERIES = queries_native.QUERIES | queries_free.QUERIES | queries_audit.QUERIES
ORACLE = queries_native.ORACLE | queries_audit.ORACLE
