"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import math

import pytest

import __spark_entry__ as E
from settings import SF_SMALL
from oracle_compare import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, SQL[name])
    assert ok, msg


def _core(names):
    """Queries without SQL, but for the optional subpackage's, whose own tests check them."""
    return sorted(n for n in names if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", _core(set(QUERIES) - set(SQL)))
def test_rows_only_queries_give_finite_values(spark, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SF_SMALL).collect()]
    assert rows
    for r in rows:
        for c, v in r.items():
            assert v is not None and (not isinstance(v, float) or math.isfinite(v)), (c, v)
            if c.startswith("precision") or c in ("explained", "cumulative"):
                assert 0 <= v <= 1 + 1e-9, (c, v)
            if c in ("silhouette", "cosine"):
                assert -1 - 1e-9 <= v <= 1 + 1e-9, (c, v)
            if c in ("size", "inertia", "mse"):
                assert v >= 0, (c, v)
