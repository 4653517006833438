"""Registered queries: one per operator of the survey inventory.

Each query takes (spark, sf_dir) and returns a DataFrame computed from the
given tables; ``ORACLE`` holds the equivalent DuckDB SQL where one exists.
"""

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
    # Import for side effects (registration), in inventory order.
    from . import q_sources, q_cleaning, q_nesting, q_encode, q_sampling  # noqa: F401
    from . import q_pairs, q_profile, q_ranking, q_vectors  # noqa: F401
    from . import q_learn, q_ingest  # noqa: F401
    return QUERIES, ORACLE
