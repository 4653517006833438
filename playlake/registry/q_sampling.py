"""Queries for weights, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as SA
from ..session import read_table
from . import register

_COUNTS = "SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label"


@register("d9_class_weights", f"""
WITH c AS ({_COUNTS}), p AS (SELECT unnest(range(0, (SELECT max(label) FROM c) + 1)) AS position)
SELECT CAST(position AS INTEGER) AS position,
       CASE WHEN c.n > 0 THEN 1.0 / c.n ELSE 1.0 END AS weight
FROM p LEFT JOIN c ON c.label = p.position
""")
def d9_class_weights(spark, sf):
    return SA.class_weights(read_table(spark, sf, "embeddings"), "label", mode="inverse")


_REF_SQL = f"""
WITH c AS ({_COUNTS}), p AS (SELECT unnest(range(0, (SELECT max(label) FROM c) + 1)) AS position),
w AS (SELECT CAST(position AS INTEGER) AS position,
       CASE WHEN position = 0 THEN 0.5 WHEN c.n > 0 THEN 1.0 / c.n ELSE 1.0 END AS weight
      FROM p LEFT JOIN c ON c.label + 1 = p.position)
"""


@register("d9_class_weights_reference", _REF_SQL + "SELECT * FROM w")
def d9_class_weights_reference(spark, sf):
    return SA.class_weights(read_table(spark, sf, "embeddings"), "label", mode="reference")


@register("d10_log_scale_weights", _REF_SQL + """
, l AS (SELECT position, ln(weight + 1e-6) AS l FROM w),
s AS (SELECT position, l - min(l) OVER () AS l FROM l),
m AS (SELECT position, l / max(l) OVER () AS l FROM s)
SELECT position, CASE WHEN l = 0 THEN 0.01 ELSE l END AS weight FROM m
""")
def d10_log_scale_weights(spark, sf):
    w = SA.class_weights(read_table(spark, sf, "embeddings"), "label", mode="reference")
    return SA.log_scale_weights(w)


@register("d11_weighted_sample", """
WITH c AS (SELECT event_type, 1.0 / sqrt(count(*)) AS weight FROM events GROUP BY event_type)
SELECT event_id, event_type FROM events JOIN c USING (event_type)
ORDER BY ln((('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 15))::BIGINT + 0.5) / 1152921504606846976.0) / weight DESC,
         event_id
LIMIT 500
""")
def d11_weighted_sample(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    weighted = SA.inverse_sqrt_class_weight(ev, "event_type")
    return SA.weighted_sample(weighted, "event_id", "weight", 500, seed=42).select("event_id", "event_type")


@register("d12_split_3way", """
WITH u AS (SELECT event_id, (('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':7'), 1, 15))::BIGINT + 0.5) / 1152921504606846976.0 AS u
           FROM events)
SELECT event_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM u
""")
def d12_split_3way(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id")
    return SA.split_3way(ev, "event_id", [0.8, 0.1, 0.1], seed=7)


@register("j9_label_distribution", """
WITH u AS (SELECT event_type, (('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':7'), 1, 15))::BIGINT + 0.5) / 1152921504606846976.0 AS u
           FROM events)
SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split, event_type,
       CAST(count(*) AS BIGINT) AS n
FROM u GROUP BY 1, 2
""")
def j9_label_distribution(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    s = SA.split_3way(ev, "event_id", [0.8, 0.1, 0.1], seed=7)
    return s.groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("g6_stratified_sample", """
SELECT vec_id, label FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY
     ('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 15))::BIGINT, vec_id) AS rn
  FROM embeddings WHERE label IS NOT NULL) WHERE rn <= 20
""")
def g6_stratified_sample(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "label")
    return SA.stratified_sample(e, "label", "vec_id", 20, seed=42)
