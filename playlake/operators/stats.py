"""Two-sample tests on distance samples.

All statistics come out of aggregates over the two samples (tagged and
unioned: one pass, no join).  p-values are one number per test; they are
computed by an Arrow UDF on the one-row result, so nothing is collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import normal_two_sided_p, t_two_sided_p


def tagged(a: DataFrame, b: DataFrame, col: str = "distance") -> DataFrame:
    return a.select(F.col(col).cast("double").alias("x"), F.lit(1).alias("g")) \
            .unionByName(b.select(F.col(col).cast("double").alias("x"), F.lit(0).alias("g")))


def two_sample_summary(ab: DataFrame) -> DataFrame:
    one, two = F.col("g") == 1, F.col("g") == 0
    return ab.agg(
        F.count(F.when(one, F.col("x"))).alias("n_1"), F.count(F.when(two, F.col("x"))).alias("n_2"),
        F.avg(F.when(one, F.col("x"))).alias("mean_1"), F.avg(F.when(two, F.col("x"))).alias("mean_2"),
        F.var_samp(F.when(one, F.col("x"))).alias("var_1"), F.var_samp(F.when(two, F.col("x"))).alias("var_2"),
        F.stddev_pop(F.when(one, F.col("x"))).alias("std_1"), F.stddev_pop(F.when(two, F.col("x"))).alias("std_2"),
        F.median(F.when(one, F.col("x"))).alias("median_1"), F.median(F.when(two, F.col("x"))).alias("median_2"))


def t_statistic(s: DataFrame) -> DataFrame:
    """Student t, equal variances (pooled)."""
    n1, n2 = F.col("n_1"), F.col("n_2")
    sp2 = ((n1 - 1) * F.col("var_1") + (n2 - 1) * F.col("var_2")) / (n1 + n2 - 2)
    t = (F.col("mean_1") - F.col("mean_2")) / F.sqrt(sp2 * (1.0 / n1 + 1.0 / n2))
    return s.withColumn("t_stat", t).withColumn("t_df", (n1 + n2 - 2).cast("double"))


def mann_whitney(ab: DataFrame) -> DataFrame:
    """U of the first sample with tie-averaged ranks, plus the tie term.

    Rows are pre-aggregated to distinct values; the running count is a
    window over distinct values of the (bounded) pair samples.
    """
    vc = ab.groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.sum("g").alias("c1"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    vc = vc.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    vc = vc.withColumn("avg_rank", F.col("before") + (F.col("c") + 1) / 2.0)
    return vc.agg(F.sum(F.col("c1") * F.col("avg_rank")).alias("rank_sum_1"),
                  F.sum(F.col("c1")).alias("m1"), F.sum("c").alias("m"),
                  F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("tie_term")) \
             .select((F.col("rank_sum_1") - F.col("m1") * (F.col("m1") + 1) / 2.0).alias("u_stat"),
                     "m1", "m", "tie_term")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided_p(a) for a in z])


def distance_report(a: DataFrame, b: DataFrame, col: str = "distance", alpha: float = 0.05) -> DataFrame:
    """One-row comparison of sample a (same-class) vs b (different-class).

    t-test (I1), Mann-Whitney U (I2, normal approximation with tie and
    continuity correction, two-sided), Cohen's d with population std (I3),
    mean difference in percent of b's mean (I4), verdict labels (I5).
    """
    ab = tagged(a, b, col)
    s = t_statistic(two_sample_summary(ab))
    u = mann_whitney(ab)
    # the rank statistics are one row: attached as a scalar subquery
    us = u.select(F.struct("u_stat", "tie_term").alias("_u")).scalar()
    r = s.withColumn("u_stat", us["u_stat"]).withColumn("tie_term", us["tie_term"])
    n1, n2 = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    mu = n1 * n2 / 2.0
    nn = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12.0 * ((nn + 1) - F.col("tie_term") / (nn * (nn - 1))))
    u_big = F.greatest(F.col("u_stat"), n1 * n2 - F.col("u_stat"))
    r = r.withColumn("u_z", (u_big - mu - 0.5) / sigma)
    r = r.withColumn("t_pvalue", t_pvalue("t_stat", "t_df")).withColumn("u_pvalue", normal_pvalue("u_z"))
    r = with_effects(r)
    sig = F.when(F.col("t_pvalue") < alpha,
                 F.when(F.col("mean_diff") < 0, F.lit("significant_closer")).otherwise(F.lit("significant_opposite"))) \
           .otherwise(F.lit("not_significant"))
    return r.withColumn("verdict", sig).select(
        "n_1", "n_2", F.col("mean_1").alias("same_mean"), F.col("mean_2").alias("diff_mean"),
        F.col("median_1").alias("same_median"), F.col("median_2").alias("diff_median"),
        "t_stat", "t_pvalue", "u_stat", "u_pvalue", "cohens_d", "mean_diff_pct", "effect_size", "verdict")


def with_effects(s: DataFrame) -> DataFrame:
    """Cohen's d (population std), mean difference and its percentage, size label."""
    pooled = F.sqrt((F.col("std_1") ** 2 + F.col("std_2") ** 2) / 2.0)
    out = s.withColumn("mean_diff", F.col("mean_1") - F.col("mean_2")) \
           .withColumn("cohens_d", (F.col("mean_1") - F.col("mean_2")) / pooled) \
           .withColumn("mean_diff_pct", (F.col("mean_1") - F.col("mean_2")) / F.col("mean_2") * 100.0)
    d = F.abs(F.col("cohens_d"))
    return out.withColumn("effect_size", F.when(d < 0.2, "negligible").when(d < 0.5, "small")
                          .when(d < 0.8, "medium").otherwise("large"))
