"""Pure helpers: hashing, distribution tails, small solvers."""

import math

import numpy as np

from playlake.functions.hashing import murmur3_32, signed_hash_vector
from playlake.functions.stats import normal_two_sided_p, t_two_sided_p
from playlake.operators.encode import OUTCOME_GROUPS, OUTCOME_MAP
from playlake.operators.learn import solve_spd


def test_murmur3_public_vectors():
    assert murmur3_32(b"") == 0
    assert murmur3_32(b"hello") & 0xFFFFFFFF == 0x248BFA47
    assert murmur3_32(b"", seed=1) & 0xFFFFFFFF == 0x514E28B7


def test_signed_hash_vector_shape_and_sign():
    for tok in ["game_type=R", "game_type=S", "stand=None"]:
        v = signed_hash_vector(tok, 4)
        assert len(v) == 4 and sorted(abs(x) for x in v) == [0, 0, 0, 1]
        h = murmur3_32(tok.encode())
        assert v[abs(h) % 4] == (1 if h >= 0 else -1)


def test_t_pvalue_known_values():
    assert abs(t_two_sided_p(2.0, 10) - 0.0733880347707) < 1e-9
    assert abs(t_two_sided_p(0.0, 5) - 1.0) < 1e-12
    assert abs(normal_two_sided_p(1.959963984540054) - 0.05) < 1e-9
    assert math.isnan(t_two_sided_p(float("nan"), 3))


def test_outcome_map_covers_all_events():
    assert len(OUTCOME_MAP) == 23
    assert set(OUTCOME_MAP.values()) <= set(OUTCOME_GROUPS)
    assert OUTCOME_GROUPS.index("homerun") == 4 and OUTCOME_MAP["home_run"] == "homerun"


def test_solver_matches_numpy_identity():
    rng = np.random.default_rng(0)
    a = rng.random((12, 12))
    a = a @ a.T + np.eye(12)
    b = rng.random((12, 3))
    x = solve_spd(a, b)
    assert np.allclose(a @ x, b)
