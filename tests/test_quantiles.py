"""Bracketed exact quantiles against numpy."""

import numpy as np

from playlake.operators.profile import exact_quantiles


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=3001), "b": np.repeat([1.0, 2.0, 5.0], [500, 1, 700]), "c": np.array([3.0]),
            "d": rng.integers(0, 50, 2000).astype(float)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    names = [f"n{i}" for i in range(len(probs))]
    for accuracy in (40, 10_000):
        got = {r.g: [r[n] for n in names] for r in exact_quantiles(df, "v", "g", probs, names, accuracy).collect()}
        assert got.keys() == data.keys()
        for g, vs in data.items():
            assert np.allclose(got[g], np.quantile(vs, probs)), (g, accuracy)
    whole = exact_quantiles(df, "v", None, probs, names, 40).first()
    assert np.allclose([whole[n] for n in names], np.quantile([v for _, v in rows if v is not None], probs))
