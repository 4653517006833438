"""Profiling aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import dictionary_join
from ..session import written


def value_counts(df: DataFrame, col: str, by: str = "count") -> DataFrame:
    """Count per non-null category; ordered by count desc (value breaks ties) or by value."""
    out = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col(col)] if by == "count" else [F.col(col)]
    return out.orderBy(*order)


def value_freq(df: DataFrame, col: str, top: int = 20) -> DataFrame:
    """Normalised counts (nulls outside the denominator), top ``top``.

    The total is a scalar subquery over the column; no window.
    """
    rows = df.where(F.col(col).isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("freq", F.col("n") / total).orderBy(F.col("n").desc(), F.col(col)).limit(top)


def null_pct(df: DataFrame, cols=None, top: int = 20) -> DataFrame:
    """Null percentage per column in ONE pass, unpivoted, descending."""
    cols = list(cols or df.columns)
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(c) for c in cols])
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_pct")) for c in cols])).alias("s")).select("s.*")
    return stacked.orderBy(F.col("null_pct").desc(), F.col("column_name")).limit(top)


def head(df: DataFrame, n: int = 5, *order) -> DataFrame:
    """``n`` sample rows: the first by ``order``, or any."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))


def crosstab_counts(df: DataFrame, a: str, b: str, b_values=None) -> DataFrame:
    """a x b counts with zeros filled, b pivoted to columns.

    Pass ``b_values`` to skip the distinct-values job; the long form
    (``crosstab_long``) is the safe choice for an unbounded ``b``.
    """
    g = df.groupBy(a)
    p = g.pivot(b, list(b_values)) if b_values is not None else g.pivot(b)
    out = p.agg(F.count(F.lit(1)))
    return out.na.fill(0, subset=[c for c in out.columns if c != a])


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Non-zero cells of the a x b table as rows (a, b, n)."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab_rownorm(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row-normalised cells: n / row total (window over the small cell table)."""
    cells = crosstab_long(df, a, b)
    return cells.withColumn("row_pct", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def event_cluster_report(df: DataFrame, event: str, cluster: str, threshold: float = 0.4) -> DataFrame:
    """Per event: n, max cluster share, its cluster (smallest on tie), concentrated flag."""
    cells = crosstab_rownorm(df, event, cluster)
    return cells.groupBy(event).agg(
        F.sum("n").alias("n"),
        F.max("row_pct").alias("max_share"),
        F.max_by(F.col(cluster), F.struct(F.col("row_pct"), -F.col(cluster))).alias("top_cluster"),
        F.count(F.lit(1)).alias("n_clusters"),
    ).withColumn("concentrated", F.col("max_share") > F.lit(threshold))


def cluster_profile(df: DataFrame, cluster: str, event: str, x: str, y: str) -> DataFrame:
    """Centroid of (x, y), dominant event (smallest on tie) and its share per cluster."""
    cent = df.groupBy(cluster).agg(F.avg(x).alias("center_x"), F.avg(y).alias("center_y"),
                                   F.count(F.lit(1)).alias("n"))
    cells = df.groupBy(cluster, event).agg(F.count(F.lit(1)).alias("m"))
    dom = cells.groupBy(cluster).agg(
        F.max_by(F.col(event), F.struct(F.col("m"), -F.col(event))).alias("dominant_event"),
        F.max("m").alias("dominant_n"))
    return cent.join(dom, cluster).withColumn("dominant_pct", F.col("dominant_n") * 100.0 / F.col("n"))


def distance_stats(df: DataFrame, col: str = "distance", group=None, exact: bool = True) -> DataFrame:
    """mean, median, population std, min, max (optionally per group)."""
    med = F.median(col) if exact else F.percentile_approx(col, 0.5, 10000)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), med.alias("median"),
            F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def box_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme data inside the fences) and outlier count per group.

    Exact quartiles come from ``exact_quantiles``; the whiskers need one more
    pass over the data, with the fences attached by ``dictionary_join``.
    """
    q = exact_quantiles(df, value, group, [0.25, 0.5, 0.75])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lo_fence", F.col("q1") - 1.5 * F.col("iqr")) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * F.col("iqr"))
    q = written(q, "quantiles")
    j = dictionary_join(df.select(group, value), q.select(group, "lo_fence", "hi_fence"), group, "inner")
    inside = (F.col(value) >= F.col("lo_fence")) & (F.col(value) <= F.col("hi_fence"))
    w = j.groupBy(group).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.sum(F.when(~inside, 1).otherwise(0)).cast("bigint").alias("n_outliers"))
    return q.join(w, group)


def exact_quantiles(df: DataFrame, value: str, group: str | None, probs, names=None, accuracy: int = 10_000) -> DataFrame:
    """Exact linear-interpolated quantiles (``quantile_cont``) per group.

    A first pass brackets each quantile by approximate ones, whose rank error
    is at most n / ``accuracy``.  A second counts the rows below each bracket
    and gathers value counts inside it, about 4 n / ``accuracy`` rows a
    quantile; only these are ordered by a window.  So a group that holds a
    third of all rows is summed up in many tasks and never sorted in one.
    Rows with a null group are left out.
    """
    gcols = [group] if group else []
    probs = [float(p) for p in probs]
    default = {0.25: "q1", 0.5: "q2", 0.75: "q3"}
    names = list(names) if names else [default.get(p, f"p{int(round(p * 1000))}") for p in probs]
    rows = df.where(F.col(value).isNotNull()).select(*gcols, F.col(value).alias("_v"))
    eps = 2.0 / accuracy
    ends = F.array(*[F.lit(e) for p in probs for e in (max(0.0, p - eps), min(1.0, p + eps))])
    brackets = rows.groupBy(*gcols).agg(F.percentile_approx("_v", ends, F.lit(accuracy)).alias("_b"), F.count("*").alias("_n"))
    if group:
        x = dictionary_join(rows, brackets, group, "inner")
    else:
        one = brackets.select(F.struct("_b", "_n").alias("_r")).scalar()
        x = rows.withColumns({"_b": one["_b"], "_n": one["_n"]})
    # place of a value for each quantile: 0 below its bracket, 1 inside, 2 above
    place = [F.when(F.col("_v") < F.col("_b")[2 * i], 0).when(F.col("_v") <= F.col("_b")[2 * i + 1], 1).otherwise(2)
             for i in range(len(probs))]
    inside = F.array_compact(F.array(*[F.when(p == 1, F.lit(i)) for i, p in enumerate(place)]))
    below = x.groupBy(*gcols).agg(F.max("_n").alias("_n"), *[F.count_if(p == 0).alias(f"_below{i}") for i, p in enumerate(place)])
    vc = (x.select(*gcols, "_v", F.explode(inside).alias("_i")).groupBy(*gcols, "_i", "_v").agg(F.count("*").alias("_c")))
    w = Window.partitionBy(*gcols, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    vc = vc.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    below = written(below, "below")
    if group:
        j = dictionary_join(vc, below, group, "inner")
    else:
        one = below.select(F.struct(*below.columns).alias("_r")).scalar()
        j = vc.withColumns({c: one[c] for c in below.columns})
    aggs = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col("_lo") + F.col(f"_below{i}"), F.col("_hi") + F.col(f"_below{i}")
        at = lambda r: F.min(F.when((F.col("_i") == i) & (lo <= r) & (r < hi), F.col("_v")))  # noqa: B023, E731
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_fr_{name}")]
    out = j.groupBy(*gcols).agg(*aggs)
    return out.select(*gcols, *[(F.col(f"_lo_{n}") + F.col(f"_fr_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
                                for n in names])


def histogram(df: DataFrame, value: str, series: str | None = None, bins: int = 50) -> DataFrame:
    """Density histogram with ``bins`` equal bins over each series' own range."""
    gcols = [series] if series else []
    stats = [F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")]
    if gcols:
        j = dictionary_join(df.select(*gcols, value), df.groupBy(*gcols).agg(*stats), series, "inner")
    else:
        r = df.agg(*stats).select(F.struct("_lo", "_hi", "_n").alias("_r")).scalar()
        j = df.select(value).withColumns({"_lo": r["_lo"], "_hi": r["_hi"], "_n": r["_n"]})
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / width).cast("bigint") + 1, F.lit(bins))
    b = F.when(width == 0, F.lit(1)).otherwise(b)
    cells = j.where(F.col(value).isNotNull()).groupBy(*gcols, b.alias("bin"), "_lo", "_hi", "_n").agg(
        F.count(F.lit(1)).alias("count"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return cells.select(*gcols, "bin", "count",
                        (F.col("_lo") + (F.col("bin") - 1) * w).alias("bin_lo"),
                        (F.col("count") / (F.col("_n") * F.when(w == 0, F.lit(1.0)).otherwise(w))).alias("density"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every column pair, pairwise-complete, one pass."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs])).alias("s")).select("s.*")


def period_counts(df: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    """Row count per period (all periods in one aggregate)."""
    return df.groupBy(F.trunc(F.to_date(ts), unit).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def nunique(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    fn = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(*[fn(c).alias(f"n_{c}") for c in cols])
