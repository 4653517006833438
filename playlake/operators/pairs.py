"""Pair generation and pair distances (E1-E6) without materialising all pairs.

* Sampled pairs (E4/E5): a dense 0..N-1 index is put on the rows, a range
  of attempt ids draws two indexes each from md5(attempt, seed), and two
  equi-joins on the index fetch the two rows.  The first n accepted
  attempts (in attempt order) are kept, at most ``max_attempts`` tried.
* Class-pair mean distances (E6/F12, silhouette): each class is reduced to a
  bounded stratified sample first; then every class pair is one group of at
  most 2 x n vectors, reduced to one mean by a vectorised distance matrix
  inside ``applyInPandas``.  No pair rows are ever emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_u60
from ..functions.vectors import euclid

_LOCAL_BITS = 33


def dense_index(df: DataFrame, order_cols, name: str = "idx") -> DataFrame:
    """Add a dense 0..N-1 index following ``order_cols`` (a total order).

    Rows are range-partitioned and sorted on the order, then checkpointed
    (reliable, to ``spark.checkpoint.dir``) so partition contents are fixed
    even if executors are lost.  ``monotonically_increasing_id`` then
    encodes (partition, position); the row counts of earlier partitions
    (a table with one row per partition) give the offset.
    """
    spark = df.sparkSession
    order_cols = list(order_cols)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols)
    ordered = ordered.checkpoint(eager=True)
    mid = F.monotonically_increasing_id()
    tagged = ordered.withColumn("_mid", mid).withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)) \
                    .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    # One row per partition: a size bound fixed by the partition count.
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_pos")).cast("bigint")).drop("_mid", "_pid", "_pos", "_off")


def pair_index(df: DataFrame, key: str, label: str, vec: str) -> DataFrame:
    """(idx, key, label) of the rows with a vector and a label, idx dense from 0; vectors stay where they are."""
    base = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(key, label)
    return dense_index(base, [key])


def sample_pairs(df: DataFrame, key: str, label: str, vec: str, n_pairs: int, same: bool,
                 seed: int = 42, max_attempts: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Random ordered pairs (i != j) with equal (``same``) or different labels.

    Draws are made and judged on the narrow ``index`` (see :func:`pair_index`;
    give the same one to both kinds of pairs); vectors are joined for the
    accepted rows only.  After ``max_attempts`` draws (ten a pair) there may
    be fewer than ``n_pairs``: count the result.  Output: attempt, key_1,
    key_2, label_1, label_2, distance (Euclidean).
    """
    spark = df.sparkSession
    max_attempts = max_attempts or n_pairs * 10
    index = index if index is not None else pair_index(df, key, label, vec)
    n_rows = max(index.count(), 1)  # one number; the attempts need the range size
    tag = "s" if same else "d"
    att = spark.range(max_attempts).withColumnRenamed("id", "attempt")
    att = att.select("attempt",
                     F.pmod(md5_u60(F.lit(f"{tag}i"), "attempt", F.lit(seed)), F.lit(n_rows)).alias("i"),
                     F.pmod(md5_u60(F.lit(f"{tag}j"), "attempt", F.lit(seed)), F.lit(n_rows)).alias("j"))
    att = att.where(F.col("i") != F.col("j"))
    a = index.select(F.col("idx").alias("i"), F.col(key).alias("key_1"), F.col(label).alias("label_1"))
    b = index.select(F.col("idx").alias("j"), F.col(key).alias("key_2"), F.col(label).alias("label_2"))
    # the attempts are ten per pair wanted, so they can be sent to the index
    j = index_join(index_join(a, att, "i"), b, "j", swap=True)
    cond = (F.col("label_1") == F.col("label_2")) if same else (F.col("label_1") != F.col("label_2"))
    acc = j.where(cond).orderBy("attempt").limit(n_pairs)
    acc = acc.select("attempt", "key_1", "key_2", "label_1", "label_2").checkpoint(eager=True)
    # n_pairs rows at most: sent to the vectors
    v = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    one = v.select(F.col(key).alias("key_1"), F.col(vec).alias("_v1")).join(F.broadcast(acc), "key_1")
    two = v.select(F.col(key).alias("key_2"), F.col(vec).alias("_v2")) \
           .join(F.broadcast(acc.select("attempt", "key_2")), "key_2").drop("key_2")
    return one.join(two, "attempt").select("attempt", "key_1", "key_2", "label_1", "label_2",
                                           euclid("_v1", "_v2").alias("distance"))


def index_join(left: DataFrame, right: DataFrame, on: str, swap: bool = False) -> DataFrame:
    """Join draws (a number set by the caller) with the index: the draws are broadcast."""
    return right.join(F.broadcast(left), on) if swap else left.join(F.broadcast(right), on)


# Most classes of which every pair is compared; the work grows with their square.
MAX_CLASSES = 2_000


def _class_pairs(samples: DataFrame, label: str) -> DataFrame:
    # Every sample row is sent to each class pair it belongs to.  The class
    # list (bounded by the number of classes) is a scalar subquery: computed
    # once, no join.
    k = samples.select(label).distinct().limit(MAX_CLASSES + 1).count()
    if k > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: a matrix of all class pairs is not meant for that")
    classes = samples.agg(F.array_sort(F.collect_set(label)).alias("_classes")).scalar()
    s = samples.select("*", F.explode(classes).alias("_other"))
    lo, hi = F.least(F.col(label), F.col("_other")), F.greatest(F.col(label), F.col("_other"))
    return s.select(lo.alias("class_i"), hi.alias("class_j"),
                    (F.col(label) == lo).alias("_is_i"), (F.col(label) == hi).alias("_is_j"), "*")


def class_pair_mean_distance(samples: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean Euclidean distance over all (a in class i, b in class j), i <= j.

    The diagonal includes self pairs (distance 0), as a full distance matrix
    of a class with itself does.  ``samples`` must already be bounded per
    class (``stratified_sample``): each group holds at most 2 x n vectors.
    """
    pairs = _class_pairs(samples.select(label, vec), label)

    def mean_dist(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(pdf.loc[pdf["_is_i"], vec].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        b = np.stack(pdf.loc[pdf["_is_j"], vec].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
        d = np.sqrt(np.clip(d2, 0.0, None))
        return pd.DataFrame({"class_i": [pdf["class_i"].iloc[0]], "class_j": [pdf["class_j"].iloc[0]],
                             "mean_distance": [float(d.mean())], "n_i": [len(a)], "n_j": [len(b)]})

    ltype = samples.schema[label].dataType.simpleString()
    schema = f"class_i {ltype}, class_j {ltype}, mean_distance double, n_i long, n_j long"
    return pairs.select("class_i", "class_j", "_is_i", "_is_j", vec) \
                .groupBy("class_i", "class_j").applyInPandas(mean_dist, schema)
