"""Queries for profiling aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import md5_u32
from ..operators import profile as PF
from ..operators.nesting import nest_sequences
from ..plans import rollup as RO
from ..plans.slice import ITEM_COLS
from ..session import read_table, scratch_path
from ..sources import versions as V
from . import register


@register("f1_value_counts", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1
""")
def f1_value_counts(spark, sf):
    return PF.value_counts(read_table(spark, sf, "events"), "event_type")


@register("f2_value_freq", """
WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT user_id, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (), 9) AS freq FROM c ORDER BY n DESC, user_id LIMIT 20
""")
def f2_value_freq(spark, sf):
    return PF.value_freq(read_table(spark, sf, "events"), "user_id", 20).withColumn("freq", F.round("freq", 9))


def _li_nulls(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        F.when(F.col("l_linenumber") != 3, F.col("l_suppkey")).alias("l_suppkey"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus")


_LI_NULLS_SQL = """
WITH li AS (SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_suppkey END AS l_suppkey,
  CASE WHEN l_quantity > 10 THEN l_quantity END AS l_quantity,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem)
"""


@register("f3_null_pct", _LI_NULLS_SQL + """
SELECT column_name, round(null_pct, 6) AS null_pct FROM (
  SELECT 'l_orderkey' AS column_name, avg(CASE WHEN l_orderkey IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS null_pct FROM li
  UNION ALL SELECT 'l_suppkey', avg(CASE WHEN l_suppkey IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM li
  UNION ALL SELECT 'l_quantity', avg(CASE WHEN l_quantity IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM li
  UNION ALL SELECT 'l_returnflag', avg(CASE WHEN l_returnflag IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM li
  UNION ALL SELECT 'l_linestatus', avg(CASE WHEN l_linestatus IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM li)
""")
def f3_null_pct(spark, sf):
    return PF.null_pct(_li_nulls(spark, sf)).withColumn("null_pct", F.round("null_pct", 6))


@register("f4_shape_head", """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM events) AS n_rows, CAST(6 AS BIGINT) AS n_cols, event_id, event_type, value
FROM events ORDER BY event_id LIMIT 5
""")
def f4_shape_head(spark, sf):
    """The size of the table beside its first rows."""
    e = read_table(spark, sf, "events")
    size = PF.shape(e).select(F.struct("n_rows", "n_cols").alias("s")).scalar()
    return PF.head(e, 5, "event_id").select(size["n_rows"].alias("n_rows"), size["n_cols"].alias("n_cols"),
                                            "event_id", "event_type", "value")


@register("f5_crosstab_counts", """
SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS F,
       CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS O
FROM lineitem GROUP BY 1
""")
def f5_crosstab_counts(spark, sf):
    ct = PF.crosstab_counts(read_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])
    return ct.select("l_returnflag", F.col("F").cast("bigint"), F.col("O").cast("bigint"))


@register("f6_crosstab_rownorm", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS row_pct
FROM lineitem GROUP BY 1, 2
""")
def f6_crosstab_rownorm(spark, sf):
    return PF.crosstab_rownorm(read_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus") \
             .withColumn("row_pct", F.round("row_pct", 9))


def _bucketed(spark, sf, k=4):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.pmod(md5_u32("vec_id"), F.lit(k)).alias("cluster"),
                    F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_BUCKET_SQL = """
WITH b AS (SELECT vec_id, label, ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 4 AS cluster,
                  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
"""


@register("f7_event_cluster_report", _BUCKET_SQL + """
, cells AS (SELECT label, cluster, count(*) AS n FROM b GROUP BY 1, 2),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS pct FROM cells)
SELECT label, CAST(sum(n) AS BIGINT) AS n, round(max(pct), 9) AS max_share,
       arg_max(cluster, (pct, -cluster)) AS top_cluster, CAST(count(*) AS BIGINT) AS n_clusters,
       max(pct) > 0.4 AS concentrated
FROM p GROUP BY label
""")
def f7_event_cluster_report(spark, sf):
    r = PF.event_cluster_report(_bucketed(spark, sf), "label", "cluster")
    return r.withColumn("max_share", F.round("max_share", 9))


@register("f8_cluster_profile", _BUCKET_SQL + """
, c AS (SELECT cluster, avg(x) AS center_x, avg(y) AS center_y, count(*) AS n FROM b GROUP BY 1),
m AS (SELECT cluster, label, count(*) AS m FROM b GROUP BY 1, 2),
d AS (SELECT cluster, arg_max(label, (m, -label)) AS dominant_event, max(m) AS dominant_n FROM m GROUP BY 1)
SELECT cluster, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, CAST(n AS BIGINT) AS n,
       dominant_event, CAST(dominant_n AS BIGINT) AS dominant_n, round(dominant_n * 100.0 / n, 6) AS dominant_pct
FROM c JOIN d USING (cluster)
""")
def f8_cluster_profile(spark, sf):
    p = PF.cluster_profile(_bucketed(spark, sf), "cluster", "label", "x", "y")
    return p.withColumns({c: F.round(c, 6) for c in ["center_x", "center_y", "dominant_pct"]})


@register("f13_box_summary", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2,
                  quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT f.l_returnflag, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lo_fence, 6) AS lo_fence, round(hi_fence, 6) AS hi_fence,
       min(CASE WHEN l_quantity BETWEEN lo_fence AND hi_fence THEN l_quantity END) AS whisker_lo,
       max(CASE WHEN l_quantity BETWEEN lo_fence AND hi_fence THEN l_quantity END) AS whisker_hi,
       CAST(sum(CASE WHEN l_quantity BETWEEN lo_fence AND hi_fence THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM f JOIN lineitem l USING (l_returnflag) GROUP BY ALL
""")
def f13_box_summary(spark, sf):
    b = PF.box_summary(read_table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return b.withColumns({c: F.round(c, 6) for c in ["q1", "q2", "q3", "iqr", "lo_fence", "hi_fence"]})


@register("f13_month_sketches")
def f13_month_sketches(spark, sf):
    """Quartiles and distinct suppliers by flag from sketches stored by month (rows-only; tests/test_rollup.py)."""
    li = read_table(spark, sf, "lineitem").select("l_shipdate", "l_returnflag", "l_quantity", "l_suppkey")
    path, kept = scratch_path(spark, "f13_lines"), scratch_path(spark, "f13_sketches")
    V.commit(spark, path, li, F.date_format(F.trunc(F.to_date("l_shipdate"), "month"), "yyyy-MM-dd"))
    RO.refresh(spark, path, kept, lambda r: RO.sketches(r, ["l_quantity"], ["l_suppkey"], ["l_returnflag"]))
    p = RO.profile(RO.partials(spark, kept), ["l_quantity"], ["l_suppkey"], ["l_returnflag"])
    q = F.col("l_quantity_q")
    return p.select("l_returnflag", "rows", q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"),
                    F.col("l_suppkey_distinct").alias("n_l_suppkey"))


@register("f14_histogram", """
WITH r AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(l_extendedprice) AS n
           FROM lineitem GROUP BY 1),
j AS (SELECT l.l_returnflag, l_extendedprice AS v, lo, hi, n, (hi - lo) / 50 AS w FROM lineitem l JOIN r USING (l_returnflag)
      WHERE l_extendedprice IS NOT NULL),
b AS (SELECT l_returnflag, CASE WHEN w = 0 THEN 1 ELSE least(CAST(floor((v - lo) / w) AS BIGINT) + 1, 50) END AS bin,
             lo, hi, n, w FROM j)
SELECT l_returnflag, bin, CAST(count(*) AS BIGINT) AS count, round(lo + (bin - 1) * w, 6) AS bin_lo,
       round(count(*) / (n * CASE WHEN w = 0 THEN 1.0 ELSE w END), 12) AS density
FROM b GROUP BY l_returnflag, bin, lo, hi, n, w
""")
def f14_histogram(spark, sf):
    h = PF.histogram(read_table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", 50)
    return h.withColumn("bin_lo", F.round("bin_lo", 6)).withColumn("density", F.round("density", 12))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("f15_corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]))
def f15_corr_matrix(spark, sf):
    return PF.corr_matrix(read_table(spark, sf, "lineitem"), _CORR_COLS).withColumn("corr", F.round("corr", 6))


@register("f16_existing_count", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1
""")
def f16_existing_count(spark, sf):
    return PF.period_counts(read_table(spark, sf, "orders"), "o_orderdate", "month")


@register("f17_nunique", """
SELECT CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_l_suppkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_l_partkey,
       CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_l_returnflag FROM lineitem
""")
def f17_nunique(spark, sf):
    return PF.nunique(read_table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey", "l_returnflag"])


@register("f18_quality_counts", """
WITH li AS (
  SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_suppkey END AS l_suppkey,
                    CASE WHEN l_orderkey % 10 <> 7 THEN l_returnflag END AS l_returnflag)
  FROM lineitem
), g AS (
  SELECT l_orderkey, min(l_suppkey) <> max(l_suppkey) AS multi,
         bool_or(l_suppkey IS NULL) AS has_null,
         arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS hdr_flag,
         count(*) FILTER (WHERE l_quantity >= 10) AS n_kept
  FROM li GROUP BY l_orderkey
)
SELECT CASE WHEN coalesce(multi, false) THEN 'multi_valued' WHEN has_null THEN 'null_in_group'
            WHEN hdr_flag IS NULL THEN 'null_header' ELSE 'kept' END AS outcome,
       CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(n_kept) AS BIGINT) AS n_items,
       CAST(count(*) FILTER (WHERE n_kept = 0) AS BIGINT) AS n_empty
FROM g GROUP BY 1
""")
def f18_quality_counts(spark, sf):
    li = read_table(spark, sf, "lineitem")
    li = li.withColumn("l_suppkey", F.when(F.col("l_linenumber") != 3, F.col("l_suppkey"))) \
           .withColumn("l_returnflag", F.when(F.pmod("l_orderkey", F.lit(10)) != 7, F.col("l_returnflag"))) \
           .withColumn("l_quantity", F.when(F.col("l_quantity") >= 10, F.col("l_quantity")))
    nested = nest_sequences(li, ["l_orderkey"], ["l_linenumber"], ITEM_COLS, header_cols=["l_returnflag"],
                            required_item_cols=["l_quantity"], single_valued="l_suppkey",
                            no_null_cols=["l_suppkey"], header_required="l_returnflag",
                            items_name="lines", with_reason=True)
    return nested.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum(F.size("lines")).cast("bigint").alias("n_items"),
        F.count(F.when(F.size("lines") == 0, 1)).alias("n_empty"))


@register("f19_scatter_extract", """
WITH top AS (SELECT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1
             ORDER BY count(*) DESC, l_returnflag LIMIT 2)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IN (SELECT * FROM top)
""")
def f19_scatter_extract(spark, sf):
    from ..operators.joins import semi_top
    from ..operators.ranking import top_n_categories
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                                  "l_extendedprice", "l_returnflag").dropna(
        subset=["l_quantity", "l_extendedprice", "l_returnflag"])
    return semi_top(li, top_n_categories(li, "l_returnflag", 2), "l_returnflag")
