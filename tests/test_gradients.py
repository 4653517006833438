"""Models trained by distributed gradients, against numpy and against the linear models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playlake.operators import gradients as G
from playlake.operators import learn as L


def test_minimise_finds_the_least(spark):
    a = np.diag([1.0, 10.0, 100.0])
    x, losses = G.minimise(lambda x: (float((x - 1) @ a @ (x - 1)), 2 * a @ (x - 1)), np.zeros(3))
    assert np.allclose(x, 1, atol=1e-4) and all(p >= q for p, q in zip(losses, losses[1:]))

    def rosenbrock(x):
        return ((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2,
                np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    assert np.allclose(G.minimise(rosenbrock, np.array([-1.2, 1.0]), tolerance=1e-14)[0], 1, atol=1e-4)


@pytest.fixture(scope="module")
def xor(spark):
    """Two classes that no line parts, one of them rare, and vectors with a null."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        y = int(rng.random() < 0.15)
        sx = rng.choice([-1, 1])
        x = np.array([sx, sx if y else -sx]) * 2 + rng.normal(0, 0.4, 2)
        rows.append((i, y, [float(v) * 3 + 7 for v in x], i % 4 == 0))
    rows += [(9000, 1, None, False), (9001, None, [0.0, 0.0], False)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>, test boolean")
    return df.where("NOT test"), df.where("test")


def precision(pred):
    return L.precision_scores(pred, "label", "prediction").first().precision_macro


def test_network_beats_the_linear_model(xor):
    train, test = xor
    net = G.train_network(train, "v", "label", hidden=12, rounds=60)
    ours = precision(G.predict_network(net, test, "v"))
    linear = precision(L.predict(L.weighted_classifier(train.where("v IS NOT NULL AND label IS NOT NULL"), "v", "label"), test, "v"))
    assert ours > 0.95 and ours > linear + 0.2
    assert G.predict_network(net, train.where("id = 9000"), "v").first().prediction is None


def test_network_is_the_same_under_another_dealing(xor):
    train, test = xor
    nets = [G.train_network(d, "v", "label", hidden=4, rounds=8) for d in (train.coalesce(1), train.repartition(13))]
    assert np.allclose(nets[0].parameters, nets[1].parameters, atol=1e-6)
    got = [[r.prediction for r in G.predict_network(n, test, "v").orderBy("id").collect()] for n in nets]
    assert got[0] == got[1]


def test_gradients_match_differences(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), rng.normal(0, 1, 4).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    seen = {}

    def spy(function, start, rounds=0, tolerance=0):
        value, gradient = function(start)
        at = rng.integers(0, len(start), 6)
        near = [(function(start + 1e-5 * np.eye(len(start))[i])[0] - function(start - 1e-5 * np.eye(len(start))[i])[0]) / 2e-5
                for i in at]
        seen[len(start)] = np.allclose(gradient[at], near, atol=1e-6)
        return start, [value]

    old, G.minimise = G.minimise, spy
    try:
        G.train_network(df, "v", "label", hidden=3)
        pairs = df.select("v", F.transform("v", lambda x: x * 2 + 1).alias("w"))
        G.train_cosine_projection(pairs, "v", "w")
    finally:
        G.minimise = old
    assert len(seen) == 2 and all(seen.values())


def test_cosine_projection_is_no_worse_than_ridge(spark):
    rng = np.random.default_rng(9)
    b = rng.standard_normal((6, 5))
    rows = []
    for i in range(500):
        x = rng.standard_normal(6)
        y = x @ b + rng.normal(0, 0.3, 5)
        rows.append((x.tolist(), (y * float(rng.lognormal(0, 2))).tolist(), i % 5 == 0))  # lengths that say nothing
    rows += [([0.0] * 6, [0.0] * 5, False), (None, [1.0] * 5, False)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>, test boolean")
    train, test = df.where("NOT test"), df.where("test")
    ridge = L.ridge_fit(train.where("x IS NOT NULL"), "x", "y")
    cosine = lambda m: L.cosine_mse(L.ridge_predict(test, "x", m, "p"), "p", "y").first().cosine
    ours = [cosine(G.train_cosine_projection(train, "x", "y", start=s, rounds=40)) for s in (ridge, None)]
    assert min(ours) >= cosine(ridge) and min(ours) > 0.95 and abs(ours[0] - ours[1]) < 0.01


def test_nothing_to_train_on(spark):
    df = spark.createDataFrame([(None, [1.0]), (1, None)], "label int, v array<double>")
    with pytest.raises(ValueError, match="label"):
        G.train_network(df, "v", "label")
    with pytest.raises(ValueError, match="both"):
        G.train_cosine_projection(df.select(F.lit(None).cast("array<double>").alias("x"), F.col("v").alias("y")), "x", "y")
