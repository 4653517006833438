"""Classifiers, projection and components on data whose answer is known."""

import numpy as np
import pytest

from playlake.operators import clustering as C
from playlake.operators import learn as L


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        y = int(rng.choice([0, 1, 2], p=[0.6, 0.3, 0.1]))
        state = np.eye(3)[y] * 4 + rng.normal(0, 0.4, 3)
        rows.append((i, y, state.tolist(), (state @ np.arange(6).reshape(3, 2) + 1).tolist(), i % 5 == 0))
    df = spark.createDataFrame(rows, "id long, label int, state array<double>, sent array<double>, test boolean")
    return df.where("NOT test").cache(), df.where("test").cache(), rows


def _precision(pred):
    return L.precision_scores(pred, "label", "prediction").first()


@pytest.mark.parametrize("vec", ["state", "sent"])
def test_classifier_beats_the_majority(separable, vec):
    train, test, _ = separable
    p = _precision(L.predict(L.weighted_classifier(train, vec, "label"), test, vec))
    assert p.precision_weighted > 0.9 and p.precision_macro > 0.8


def test_projection_solves_the_normal_equations(separable):
    train, test, rows = separable
    b = L.ridge_fit(train, "state", "sent", lam=1e-9)
    x = np.array([[*r[2], 1.0] for r in rows if not r[4]])
    y = np.array([r[3] for r in rows if not r[4]])
    assert np.allclose(b, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-5)
    shrunk = L.ridge_fit(train, "state", "sent", lam=50.0)
    d = np.diag([50.0, 50.0, 50.0, 0.0])
    assert np.allclose(shrunk, np.linalg.solve(x.T @ x + d, x.T @ y), atol=1e-8)
    r = L.cosine_mse(L.ridge_predict(test, "state", b, "p"), "p", "sent").first()
    assert r.cosine > 1 - 1e-9 and r.mse < 1e-9 and r.n == sum(r[4] for r in rows)
    stacked = L.predict(L.weighted_classifier(train, "sent", "label"), L.ridge_predict(test, "state", b, "p"), "p")
    assert _precision(stacked).precision_weighted > 0.9
    with pytest.raises(ValueError, match="no rows"):
        L.ridge_fit(train.limit(0), "state", "sent")


def test_text_embedding_and_encoder(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, ""), (4, "b c d")], "id long, text string")
    out = {r.id: np.array(r.sentence_embeddings) for r in L.text_embed(df, "text", dims=32).collect()}
    assert all(abs(np.linalg.norm(out[i]) - 1) < 1e-5 for i in (1, 2, 4)) and not out[3].any()
    assert out[1] @ out[2] < 1 - 1e-3
    enc = L.encoder_udf(lambda texts: np.array([[len(t), t.count("a")] for t in texts]), 2)
    got = {r.id: r.v for r in df.select("id", enc("text").alias("v")).collect()}
    assert got == {1: [5.0, 2.0], 2: [3.0, 1.0], 3: [0.0, 0.0], 4: [5.0, 0.0]}


def test_components_explain_all_variance(separable):
    train, *_ = separable
    proj, ev = C.pca_fit(train, "state", k=3)
    assert abs(sum(ev) - 1) < 1e-9 and sorted(ev, reverse=True) == ev
    x = np.array([r.state for r in train.collect()])
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(ev, w / w.sum())
    assert len(proj.first().pca) == 3


def test_cosine_of_zeros_is_zero(spark):
    """Texts without words have a vector of zeros, which has no direction: it counts as 0, not as an error."""
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 1.0], [0.0, 0.0]), ([0.0, 0.0], [3.0, 0.0])],
                               "a array<double>, b array<double>")
    r = L.cosine_mse(df, "a", "b").first()
    assert abs(r.cosine - 1 / 3) < 1e-12 and abs(r.mse - (0.5 + 1 + 4.5) / 3) < 1e-12 and r.n == 3
    assert np.isnan(L.cosine_mse(df, "a", "b", of_zeros=float("nan")).first().cosine)


def test_projections_take_texts_without_words(spark, tmp_path):
    """J4 over documents of which some have no words, also among those held out."""
    import __spark_entry__ as E
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, None if i % 9 == 0 else "..." if i % 3 == 0 else f"w{i % 7} w{i % 5} w{i}", "en") for i in range(120)],
                          "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, rng.normal(0, 1, 4).tolist(), i % 3) for i in range(120)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("j4_project_state", "j4_project_cosine"):
        r = E.queries()[name](spark, str(tmp_path)).first()
        assert -1 <= r.cosine <= 1 and r.mse >= 0 and r.n > 0
