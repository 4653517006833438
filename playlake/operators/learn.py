"""Learning and evaluation (D13, J1-J8) on Spark ML.

Classifiers are Spark ML estimators fed by ``array_to_vector``; class
weights come from the per-class weight table joined on the label.  The
state -> sentence-space projection is a multi-output ridge regression:
per-partition Gram sums (numpy inside ``mapInPandas``), summed by Spark,
solved on the driver as one small d x d system, then applied as a
broadcast coefficient matrix with column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .sampling import class_weights


# ------------------------------------------------------------------ D13
def text_embed(df: DataFrame, text: str, out: str = "sentence_embeddings", dims: int = 384) -> DataFrame:
    """Sentence -> unit-norm ``dims`` vector: tokens -> hashed TF -> IDF -> L2; the text is left out.

    Null is a text without tokens: its vector is zeros.  The pretrained-encoder slot: any Arrow ``pandas_udf`` returning
    array<float> can replace this (see ``encoder_udf``).
    """
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern="\\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims)
    # written, so that the fit and the transform read term counts and the text is tokenised once
    df = df.withColumn(text, F.coalesce(text, F.lit("")))
    t = written(tf.transform(tok.transform(df)).drop("_tok", text), "term-counts")
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(t)
    n = Normalizer(inputCol="_idf", outputCol="_n", p=2.0).transform(idf.transform(t))
    return n.withColumn(out, vector_to_array("_n", "float32")).drop("_tf", "_idf", "_n")


def encoder_udf(encode_batch, dims: int):
    """Wrap a batch encoder (list[str] -> ndarray[n, dims]) as an iterator pandas UDF."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            m = np.asarray(encode_batch(s.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(m))
    return enc


# ------------------------------------------------------------------ J1-J3
def weighted_classifier(train: DataFrame, vec: str, label: str, mode: str = "inverse", max_iter: int = 50,
                        reg: float = 0.0):
    """Multinomial logistic regression with per-class weights."""
    w = class_weights(train, label, mode=mode).withColumnRenamed("position", "_lab")
    t = train.join(w, train[label].cast("int") == w["_lab"], "left").drop("_lab") \
             .withColumn("_f", array_to_vector(F.col(vec))).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    lr = LogisticRegression(featuresCol="_f", labelCol=label, weightCol="weight", family="multinomial",
                            maxIter=max_iter, regParam=reg)
    return lr.fit(t)


def predict(model, df: DataFrame, vec: str, out: str = "prediction") -> DataFrame:
    p = model.transform(df.withColumn("_f", array_to_vector(F.col(vec))))
    return p.withColumn(out, F.col("prediction").cast("int")).drop("_f", "rawPrediction", "probability") \
            if out == "prediction" else p.withColumnRenamed("prediction", out).drop("_f", "rawPrediction", "probability")


# ------------------------------------------------------------------ J4
def ridge_fit(df: DataFrame, x: str, y: str, lam: float = 1.0) -> np.ndarray:
    """Multi-output ridge with intercept: returns B of shape (dx + 1, dy).

    One pass over the data: each partition emits its partial [X 1]^T[X 1]
    and [X 1]^T Y as one array; a second stage of about the square root as
    many tasks adds the arrays up, and the driver adds theirs and solves.
    """
    def partial(it):
        xtx = xty = None
        for pdf in it:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf[x].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
            X = np.hstack([X, np.ones((len(X), 1))])
            Y = np.stack(pdf[y].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
            a, b = X.T @ X, X.T @ Y
            xtx = a if xtx is None else xtx + a
            xty = b if xty is None else xty + b
        if xtx is not None:
            yield pd.DataFrame({"dx": [xtx.shape[0]], "dy": [xty.shape[1]],
                                "m": [np.concatenate([xtx.ravel(), xty.ravel()])]})

    def total(it):
        m = None
        for pdf in it:
            for row in pdf.itertuples(index=False):
                m = row.m if m is None else m + row.m
                dx, dy = row.dx, row.dy
        if m is not None:
            yield pd.DataFrame({"dx": [dx], "dy": [dy], "m": [m]})

    schema = "dx long, dy long, m array<double>"
    spark = df.sparkSession
    tasks = max(1, int(float(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    rows = df.select(x, y).mapInPandas(partial, schema).repartition(tasks).mapInPandas(total, schema).collect()
    if not rows:
        raise ValueError("no rows to fit")
    dx, dy = int(rows[0]["dx"]), int(rows[0]["dy"])
    m = np.sum([np.asarray(r["m"]) for r in rows], axis=0)  # one array of (dx + 1)(dx + 1 + dy) numbers a task
    xtx, xty = m[:dx * dx].reshape(dx, dx), m[dx * dx:].reshape(dx, dy)
    reg = lam * np.eye(dx)
    reg[-1, -1] = 0.0  # no penalty on the intercept
    return solve_spd(xtx + reg, xty)


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with partial pivoting using elementwise numpy
    only (no LAPACK call: threaded BLAS can stall next to the JVM)."""
    n = a.shape[0]
    m = np.hstack([np.array(a, dtype=np.float64), np.array(b, dtype=np.float64).reshape(n, -1)])
    for k in range(n):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        if p != k:
            m[[k, p]] = m[[p, k]]
        m[k] = m[k] / m[k, k]
        f = m[:, k].copy()
        f[k] = 0.0
        m -= f[:, None] * m[k][None, :]
    return m[:, n:]


def ridge_predict(df: DataFrame, x: str, coef: np.ndarray, out: str) -> DataFrame:
    """y = [x 1] B, one matrix product per Arrow batch (B is dx x dy: bounded
    by the dimensions, shipped once with the task closure)."""
    from pyspark.sql import types as T

    B = np.asarray(coef, dtype=np.float64)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def apply(it):
        for pdf in it:
            if len(pdf) == 0:
                yield pdf.assign(**{out: pd.Series([], dtype=object)})
                continue
            X = np.stack(pdf[x].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
            Y = np.hstack([X, np.ones((len(X), 1))]) @ B
            yield pdf.assign(**{out: list(Y)})

    return df.mapInPandas(apply, schema)


# ------------------------------------------------------------------ J6-J8
def precision_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Macro and support-weighted precision of predicted classes.

    Classes count when they occur as a label or a prediction; a class never
    predicted has precision 0.  Weighted uses label support (tp + fn).
    """
    t = df.groupBy(F.col(truth).alias("c")).agg(F.count(F.lit(1)).alias("support"))
    p = df.groupBy(F.col(pred).alias("c")).agg(F.count(F.lit(1)).alias("predicted"),
                                               F.sum(F.when(F.col(truth) == F.col(pred), 1).otherwise(0)).alias("tp"))
    c = t.join(p, "c", "full").fillna(0, subset=["support", "predicted", "tp"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    return c.agg(F.avg(prec).alias("precision_macro"),
                 (F.sum(prec * F.col("support")) / F.sum("support")).alias("precision_weighted"))


def cosine_mse(df: DataFrame, a: str, b: str, of_zeros: float = 0.0) -> DataFrame:
    """Mean cosine and mean squared error of two vector columns; the cosine of a vector of zeros counts as ``of_zeros``."""
    from ..functions.vectors import cosine
    se = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
                     F.lit(0.0), lambda acc, t: acc + t) / F.size(a)
    return df.agg(F.avg(cosine(a, b, of_zeros)).alias("cosine"), F.avg(se).alias("mse"), F.count(F.lit(1)).alias("n"))


def label_space(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_distinct(label).alias("n_classes"), (F.max(label) + 1).alias("num_classes"),
                  F.array_sort(F.collect_set(label)).alias("classes"))
