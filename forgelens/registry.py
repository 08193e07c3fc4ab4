"""All queries of the core and their SQL."""

from __future__ import annotations

from forgelens.plans import dataset, drift, history, io, models, stats

BOOKS = (history.book, dataset.book, stats.book, models.book, io.book)


def queries() -> dict:
    return {k: v for b in BOOKS for k, v in b.queries.items()} | drift.QUERIES


def oracle_sql() -> dict:
    return {k: v for b in BOOKS for k, v in b.sql.items()} | drift.ORACLES
