"""All queries of the engine proper, and their SQL."""

from __future__ import annotations

from tidemark.plans import evaluation, ingest, intake, matching, models, reports, training

MODULES = [ingest, intake, matching, evaluation, reports, training, models]


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
