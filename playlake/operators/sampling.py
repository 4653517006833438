"""Class weights, weighted / stratified samples and splits.

Randomness comes from md5 of (key, seed): reproducible under any
partitioning or executor retry, and checkable by a SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import dictionary_join
from ..functions.hashing import md5_u60, md5_uniform


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str, mode: str = "inverse") -> DataFrame:
    """Per-class weight table (position, weight), one row per position 0..max.

    ``inverse``: w[c] = 1 / count[c] (1.0 when the class is absent).
    ``reference``: the shifted layout of the original trainer:
    w[0] = 0.5 and w[i + 1] = 1 / count[i] (1.0 when absent), for i < max.
    Built from the per-class counts (a small aggregate) and a generated
    position range; nothing per-row.
    """
    counts = class_counts(df, label)
    top = counts.agg(F.max(label).cast("int").alias("_max"))
    pos = top.select(F.explode(F.sequence(F.lit(0), F.col("_max"))).alias("position"))
    if mode == "inverse":
        j = pos.join(counts.select(F.col(label).cast("int").alias("position"), "n"), "position", "left")
        return j.select("position", F.when(F.col("n") > 0, 1.0 / F.col("n")).otherwise(F.lit(1.0)).alias("weight"))
    if mode == "reference":
        j = pos.join(counts.select((F.col(label).cast("int") + 1).alias("position"), "n"), "position", "left")
        w = F.when(F.col("position") == 0, F.lit(0.5)).when(F.col("n") > 0, 1.0 / F.col("n")).otherwise(F.lit(1.0))
        return j.select("position", w.alias("weight"))
    raise ValueError("mode must be 'inverse' or 'reference'")


def log_scale_weights(weights: DataFrame, col: str = "weight") -> DataFrame:
    """log(w + 1e-6), shifted to min 0, divided by the max; zeros -> 0.01.

    ``weights`` is the small per-class table, so the global window is over
    the number of classes.
    """
    w = Window.partitionBy()
    lg = F.log(F.col(col) + F.lit(1e-6))
    out = weights.withColumn("_l", lg).withColumn("_l", F.col("_l") - F.min("_l").over(w))
    out = out.withColumn("_l", F.col("_l") / F.max("_l").over(w))
    return out.withColumn(col, F.when(F.col("_l") == 0, F.lit(0.01)).otherwise(F.col("_l"))).drop("_l")


def weighted_sample(df: DataFrame, key: str, weight, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, P proportional to ``weight`` (Efraimidis-Spirakis).

    Each row gets key ln(u) / w with u = md5 uniform of (key, seed); the n
    largest keys are the sample.  ``orderBy(...).limit(n)`` plans as a
    per-partition top-n then a merge of n x partitions rows: no full sort.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    es = F.log(md5_uniform(key, F.lit(seed))) / w
    return df.withColumn("_es", es).orderBy(F.col("_es").desc(), F.col(key)).limit(n).drop("_es")


def inverse_sqrt_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach 1/sqrt(class count) per row (per-class table joined on the label)."""
    cw = class_counts(df, label).select(label, (1.0 / F.sqrt(F.col("n"))).alias(out))
    return dictionary_join(df, cw, label)


def split_3way(df: DataFrame, key: str, fractions=(0.8, 0.1, 0.1), seed: int = 42, out: str = "split") -> DataFrame:
    """Hash-bucket split into train/dev/test; a wrong-length list falls back to 0.8/0.1/0.1."""
    if len(fractions) != 3:
        fractions = (0.8, 0.1, 0.1)
    tot = float(sum(fractions))
    a, b = fractions[0] / tot, (fractions[0] + fractions[1]) / tot
    u = md5_uniform(key, F.lit(seed))
    return df.withColumn(out, F.when(u < a, "train").when(u < b, "dev").otherwise("test"))


def stratified_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows per class, without replacement, chosen by md5 order.

    ``row_number() <= n`` over a class partition is planned with a partial
    WindowGroupLimit before the shuffle, so a hot class ships at most n rows
    per map partition instead of all its rows.
    """
    h = md5_u60(key, F.lit(seed))
    w = Window.partitionBy(label).orderBy(h, F.col(key))
    return df.where(F.col(label).isNotNull()).withColumn("_rn", F.row_number().over(w)) \
             .where(F.col("_rn") <= n).drop("_rn")
