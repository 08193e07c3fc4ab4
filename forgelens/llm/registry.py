"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from forgelens.llm import queries_documents, queries_numeric, queries_source, queries_tokens

MODULES = (queries_documents, queries_numeric, queries_source, queries_tokens)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
