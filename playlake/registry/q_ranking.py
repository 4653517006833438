"""Queries for ranking, top-k and cumulative steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import md5_u32
from ..operators import ranking as RK
from ..operators import vectors as V
from ..operators.nesting import nest_sequences
from ..session import read_table
from . import register


@register("g1_top_n_categories", """
SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1
ORDER BY n DESC, user_id LIMIT 10
""")
def g1_top_n_categories(spark, sf):
    return RK.top_n_categories(read_table(spark, sf, "events"), "user_id", 10)


@register("g2_bottom_n_categories", """
SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1
ORDER BY n, user_id LIMIT 3
""")
def g2_bottom_n_categories(spark, sf):
    return RK.bottom_n_categories(read_table(spark, sf, "events"), "user_id", 3)


@register("g3_rare_categories", """
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1 HAVING count(*) < 600
""")
def g3_rare_categories(spark, sf):
    return RK.rare_categories(read_table(spark, sf, "lineitem"), "l_suppkey", 600)


@register("g5_sort_in_group", """
SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turn_seq,
       string_agg(role, ',' ORDER BY turn) AS role_seq FROM conversations GROUP BY conv_id
""")
def g5_sort_in_group(spark, sf):
    n = nest_sequences(read_table(spark, sf, "conversations"), ["conv_id"], ["turn"], ["role"], items_name="turns")
    return n.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"].cast("string")), ",").alias("turn_seq"),
                    F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("role_seq"))


@register("g7_argmax_k", """
WITH b AS (SELECT k, label, ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % k AS cluster
           FROM embeddings, range(2, 16) t(k) WHERE label IS NOT NULL),
cells AS (SELECT k, label, cluster, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
sc AS (SELECT k, sum(n * (n - 1) / 2) AS sc, sum(n) AS N FROM cells GROUP BY k),
sa AS (SELECT k, sum(a * (a - 1) / 2) AS sa FROM (SELECT k, label, sum(n) AS a FROM cells GROUP BY ALL) GROUP BY k),
sb AS (SELECT k, sum(b * (b - 1) / 2) AS sb FROM (SELECT k, cluster, sum(n) AS b FROM cells GROUP BY ALL) GROUP BY k),
ari AS (SELECT k, CASE WHEN (sa + sb) / 2 = sa * sb / (N * (N - 1) / 2) THEN 1.0
            ELSE (sc - sa * sb / (N * (N - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (N * (N - 1) / 2)) END AS score
        FROM sc JOIN sa USING (k) JOIN sb USING (k))
SELECT CAST(arg_max(k, (score, -k)) AS INTEGER) AS best_k, round(max(score), 9) AS best_score FROM ari
""")
def g7_argmax_k(spark, sf):
    e = read_table(spark, sf, "embeddings").where(F.col("label").isNotNull())
    b = e.select("vec_id", "label", F.explode(F.sequence(F.lit(2), F.lit(15))).alias("k")) \
         .withColumn("cluster", F.pmod(md5_u32("vec_id"), F.col("k").cast("bigint")))
    scores = V.adjusted_rand(b, "label", "cluster", by=["k"]).withColumnRenamed("ari", "score")
    best = RK.argmax_k(scores, "k", "score")
    return best.select(F.col("best_k").cast("int"), F.round("best_score", 9).alias("best_score"))


@register("g8_cumulative_variance", """
WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings
           WHERE embedding IS NOT NULL),
v AS (SELECT pos, var_pop(x) AS v FROM x GROUP BY pos),
r AS (SELECT row_number() OVER (ORDER BY v DESC, pos) AS rk, v / sum(v) OVER () AS share FROM v),
c AS (SELECT rk, sum(share) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM r)
SELECT CAST(min(CASE WHEN cum >= 0.9 THEN rk END) AS INTEGER) AS first_90,
       CAST(min(CASE WHEN cum >= 0.95 THEN rk END) AS INTEGER) AS first_95 FROM c
""")
def g8_cumulative_variance(spark, sf):
    from pyspark.sql import Window
    e = read_table(spark, sf, "embeddings").where(F.col("embedding").isNotNull())
    v = e.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos") \
         .agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    # One row per dimension from here on (bounded by d).
    r = v.select(F.row_number().over(Window.orderBy(F.col("v").desc(), "pos")).alias("rk"),
                 (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("share"))
    c = RK.cumulative_share(r, "rk", "share", "cum")
    return RK.first_reaching(c, "rk", "cum", [0.9, 0.95]).select(
        F.col("first_90").cast("int"), F.col("first_95").cast("int"))


@register("g9_highlight_role", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1),
top AS (SELECT label, 1 AS p, 'common' AS role FROM c ORDER BY n DESC, label LIMIT 2),
bot AS (SELECT label, 2 AS p, 'rare' AS role FROM c ORDER BY n, label LIMIT 3),
roles AS (SELECT label, arg_min(role, p) AS role FROM (SELECT * FROM top UNION ALL SELECT * FROM bot) GROUP BY label)
SELECT vec_id, label, coalesce(role, 'other') AS role FROM embeddings LEFT JOIN roles USING (label)
""")
def g9_highlight_role(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "label")
    return RK.highlight_role(e, "label", 2, 3)
