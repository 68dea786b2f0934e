"""The queries and SQL of this subpackage."""

from __future__ import annotations

from . import chat, hnsw, langid, lm, mixing, pieces, pii, probminhash, toxicity, vafile

MODULES = [hnsw, vafile, toxicity, probminhash, mixing, langid, pieces, chat, pii, lm]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
