"""Ranking, top-k and cumulative steps (G1-G9) and per-class rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import distance_stats


def category_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def top_n_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """n most frequent values (value breaks ties): TakeOrderedAndProject on counts."""
    return category_counts(df, col).orderBy(F.col("n").desc(), F.col(col)).limit(n)


def bottom_n_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    return category_counts(df, col).orderBy(F.col("n").asc(), F.col(col)).limit(n)


def rare_categories(df: DataFrame, col: str, threshold: int) -> DataFrame:
    return category_counts(df, col).where(F.col("n") < threshold)


def closest_pairs(matrix: DataFrame, k: int = 5) -> DataFrame:
    """k nearest and k farthest class pairs of the upper triangle."""
    up = matrix.where(F.col("class_i") < F.col("class_j")).select("class_i", "class_j", "mean_distance")
    near = up.orderBy("mean_distance", "class_i", "class_j").limit(k).withColumn("kind", F.lit("closest"))
    far = up.orderBy(F.col("mean_distance").desc(), "class_i", "class_j").limit(k).withColumn("kind", F.lit("farthest"))
    return near.unionByName(far)


def argmax_k(scores: DataFrame, k: str = "k", score: str = "score") -> DataFrame:
    """k with the best score; the smallest k wins a tie."""
    return scores.agg(F.max_by(F.col(k), F.struct(F.col(score), -F.col(k))).alias(f"best_{k}"),
                      F.max(score).alias(f"best_{score}"))


def cumulative_share(df: DataFrame, order: str, value: str, out: str = "cumulative") -> DataFrame:
    """Running sum in ``order`` (used on short lists such as explained variance)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def first_reaching(df: DataFrame, order: str, cum: str, thresholds) -> DataFrame:
    return df.agg(*[F.min(F.when(F.col(cum) >= t, F.col(order))).alias(f"first_{int(round(t * 100))}")
                    for t in thresholds])


def highlight_role(df: DataFrame, col: str, n_top: int = 2, n_bottom: int = 3) -> DataFrame:
    """Tag rows top-common / bottom-rare / other (a value in both keeps 'common')."""
    top = top_n_categories(df, col, n_top).select(col, F.lit(1).alias("_p"), F.lit("common").alias("role"))
    bot = bottom_n_categories(df, col, n_bottom).select(col, F.lit(2).alias("_p"), F.lit("rare").alias("role"))
    roles = top.unionByName(bot).groupBy(col).agg(F.min_by("role", "_p").alias("role"))
    # At most n_top + n_bottom rows: broadcast is bounded by the parameters.
    return df.join(F.broadcast(roles), col, "left").withColumn("role", F.coalesce("role", F.lit("other")))


def per_class_distance_stats(pairs: DataFrame, base: DataFrame, label: str, min_pairs: int = 10) -> DataFrame:
    """F9 per class of same-class pairs, classes with >= ``min_pairs`` pairs, plus class sizes."""
    st = distance_stats(pairs.withColumnRenamed("label_1", label), "distance", group=[label]) \
        .withColumnRenamed("n", "n_pairs").where(F.col("n_pairs") >= min_pairs)
    sizes = base.groupBy(label).agg(F.count(F.lit(1)).alias("n_samples"))
    return st.join(sizes, label)


def variation(per_class: DataFrame, label: str) -> DataFrame:
    """Spread of per-class mean distances: tightest, loosest, range / mean in %."""
    v = per_class.agg(F.min_by(label, "mean").alias("tightest"), F.max_by(label, "mean").alias("loosest"),
                      ((F.max("mean") - F.min("mean")) / F.avg("mean") * 100.0).alias("variation_pct"))
    return v.withColumn("variation", F.when(F.col("variation_pct") < 10, "very_little")
                        .when(F.col("variation_pct") < 25, "moderate").otherwise("substantial"))
