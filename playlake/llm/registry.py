"""Queries and oracle SQL of this subpackage, one ``opN_<name>`` per operator."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all():
    from . import q_filters, q_models, q_structure, q_text  # noqa: F401
    return QUERIES, ORACLE
