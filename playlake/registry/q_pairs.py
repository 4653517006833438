"""Queries for keyed attachment, pair sampling, pair distances and the
distance tests (E1-E6, F9-F12, G4, I1-I6) on ``embeddings`` (label = event)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators import joins as J
from ..operators import pairs as PR
from ..operators import profile as PF
from ..operators import sampling as SA
from ..operators import stats as ST
from ..session import read_table
from . import register

N_PAIRS, SEED = 10_000, 42
N_PER_CLASS = 100


def _base(spark, sf):
    return read_table(spark, sf, "embeddings").where(F.col("embedding").isNotNull() & F.col("label").isNotNull())


def same_pairs(spark, sf, index=None):
    return PR.sample_pairs(_base(spark, sf), "vec_id", "label", "embedding", N_PAIRS, same=True, seed=SEED, index=index)


def diff_pairs(spark, sf, index=None):
    return PR.sample_pairs(_base(spark, sf), "vec_id", "label", "embedding", N_PAIRS, same=False, seed=SEED, index=index)


def both_pairs(spark, sf):
    """Same-class and different-class pairs, drawn on one index."""
    index = PR.pair_index(_base(spark, sf), "vec_id", "label", "embedding")
    return same_pairs(spark, sf, index), diff_pairs(spark, sf, index)


def _pairs_sql(name, tag, op):
    return f"""
{name} AS (
  SELECT attempt, a.vec_id AS key_1, b.vec_id AS key_2, a.label AS label_1, b.label AS label_2,
         list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM (SELECT range AS attempt,
          ('0x' || substr(md5('{tag}i:' || range || ':{SEED}'), 1, 15))::BIGINT % nn.n AS i,
          ('0x' || substr(md5('{tag}j:' || range || ':{SEED}'), 1, 15))::BIGINT % nn.n AS j
        FROM range(0, {N_PAIRS * 10}), nn) att
  JOIN ix a ON a.idx = att.i JOIN ix b ON b.idx = att.j
  WHERE att.i <> att.j AND a.label {op} b.label
  ORDER BY attempt LIMIT {N_PAIRS})"""


_PAIRS_CTE = f"""
WITH base AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
ix AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM base),
nn AS (SELECT count(*) AS n FROM base),
{_pairs_sql('same', 's', '=')},
{_pairs_sql('diff', 'd', '<>')}
"""


def _round(df, cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


@register("e1_attach_by_key", """
SELECT e.vec_id, e.label, round(sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS vec_norm,
       d.n_chars
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
""")
def e1_attach_by_key(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "label", F.round(norm("embedding"), 6).alias("vec_norm"))
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars")
    return J.attach_by_key(e, d, ["vec_id"])


@register("e2_semi_top", """
WITH top AS (SELECT event_type FROM events WHERE event_type IS NOT NULL GROUP BY 1
             ORDER BY count(*) DESC, event_type LIMIT 2)
SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM top)
""")
def e2_semi_top(spark, sf):
    from ..operators.ranking import top_n_categories
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    return J.semi_top(ev, top_n_categories(ev, "event_type", 2), "event_type")


@register("e3_map_lookup", """
WITH c AS (SELECT event_type, 1.0 / sqrt(count(*)) AS weight FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT event_id, event_type, round(weight, 9) AS weight FROM events LEFT JOIN c USING (event_type)
""")
def e3_map_lookup(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    return SA.inverse_sqrt_class_weight(ev, "event_type").withColumn("weight", F.round("weight", 9))


@register("e4_same_event_pairs", _PAIRS_CTE + """
SELECT attempt, key_1, key_2, label_1, label_2, round(distance, 6) AS distance FROM same
""")
def e4_same_event_pairs(spark, sf):
    return _round(same_pairs(spark, sf), ["distance"])


@register("e5_diff_event_pairs", _PAIRS_CTE + """
SELECT attempt, key_1, key_2, label_1, label_2, round(distance, 6) AS distance FROM diff
""")
def e5_diff_event_pairs(spark, sf):
    return _round(diff_pairs(spark, sf), ["distance"])


_CLASS_SQL = f"""
WITH s AS (
  SELECT vec_id, label, embedding FROM (
    SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY
       ('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':{SEED}'), 1, 15))::BIGINT, vec_id) AS rn
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL) WHERE rn <= {N_PER_CLASS}),
m AS (
  SELECT a.label AS class_i, b.label AS class_j,
         avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS mean_distance
  FROM s a JOIN s b ON a.label <= b.label GROUP BY 1, 2)
"""


def class_matrix(spark, sf):
    samples = SA.stratified_sample(_base(spark, sf), "label", "vec_id", N_PER_CLASS, seed=SEED)
    return PR.class_pair_mean_distance(samples, "label", "embedding")


@register("e6_class_cross", _CLASS_SQL + "SELECT class_i, class_j, round(mean_distance, 6) AS mean_distance FROM m")
def e6_class_cross(spark, sf):
    return _round(class_matrix(spark, sf).select("class_i", "class_j", "mean_distance"), ["mean_distance"])


@register("f12_interclass_matrix", _CLASS_SQL + """
SELECT class_i, class_j, round(mean_distance, 6) AS mean_distance FROM m
UNION ALL SELECT class_j, class_i, round(mean_distance, 6) FROM m WHERE class_i < class_j
""")
def f12_interclass_matrix(spark, sf):
    m = class_matrix(spark, sf).select("class_i", "class_j", "mean_distance")
    mirrored = m.where(F.col("class_i") < F.col("class_j")).select(
        F.col("class_j").alias("class_i"), F.col("class_i").alias("class_j"), "mean_distance")
    return _round(m.unionByName(mirrored), ["mean_distance"])


@register("g4_closest_pairs", _CLASS_SQL + """
SELECT * FROM (SELECT 'closest' AS kind, class_i, class_j, round(mean_distance, 6) AS mean_distance FROM m
               WHERE class_i < class_j ORDER BY mean_distance, class_i, class_j LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'farthest', class_i, class_j, round(mean_distance, 6) FROM m
               WHERE class_i < class_j ORDER BY mean_distance DESC, class_i, class_j LIMIT 5)
""")
def g4_closest_pairs(spark, sf):
    from ..operators.ranking import closest_pairs
    return _round(closest_pairs(class_matrix(spark, sf), 5), ["mean_distance"])


_STATS_COLS = ["mean", "median", "std", "min", "max"]


@register("f9_distance_stats", _PAIRS_CTE + """
SELECT 'same' AS kind, CAST(count(*) AS BIGINT) AS n, round(avg(distance), 6) AS mean, round(median(distance), 6) AS median,
       round(stddev_pop(distance), 6) AS std, round(min(distance), 6) AS min, round(max(distance), 6) AS max FROM same
UNION ALL
SELECT 'diff', count(*), round(avg(distance), 6), round(median(distance), 6), round(stddev_pop(distance), 6),
       round(min(distance), 6), round(max(distance), 6) FROM diff
""")
def f9_distance_stats(spark, sf):
    same, diff = both_pairs(spark, sf)
    s = PF.distance_stats(same).withColumn("kind", F.lit("same"))
    d = PF.distance_stats(diff).withColumn("kind", F.lit("diff"))
    return _round(s.unionByName(d), _STATS_COLS)


_PER_EVENT_SQL = _PAIRS_CTE + """
, pe AS (
  SELECT label_1 AS label, CAST(count(*) AS BIGINT) AS n_pairs, avg(distance) AS mean, median(distance) AS median,
         stddev_pop(distance) AS std, min(distance) AS min, max(distance) AS max
  FROM same GROUP BY 1 HAVING count(*) >= 10),
pe2 AS (SELECT pe.*, CAST(c.n_samples AS BIGINT) AS n_samples FROM pe JOIN
        (SELECT label, count(*) AS n_samples FROM base GROUP BY 1) c USING (label))
"""


def per_event(spark, sf):
    from ..operators.ranking import per_class_distance_stats
    return per_class_distance_stats(same_pairs(spark, sf), _base(spark, sf), "label")


@register("f10_per_event_stats", _PER_EVENT_SQL + """
SELECT label, n_pairs, n_samples, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
       round(min, 6) AS min, round(max, 6) AS max FROM pe2
""")
def f10_per_event_stats(spark, sf):
    return _round(per_event(spark, sf), _STATS_COLS)


@register("f11_variation_pct", _PER_EVENT_SQL + """
, v AS (SELECT arg_min(label, mean) AS tightest, arg_max(label, mean) AS loosest,
               (max(mean) - min(mean)) / avg(mean) * 100 AS variation_pct FROM pe2)
SELECT tightest, loosest, round(variation_pct, 6) AS variation_pct,
       CASE WHEN variation_pct < 10 THEN 'very_little' WHEN variation_pct < 25 THEN 'moderate'
            ELSE 'substantial' END AS variation FROM v
""")
def f11_variation_pct(spark, sf):
    from ..operators.ranking import variation
    return _round(variation(per_event(spark, sf), "label"), ["variation_pct"])


_SUMMARY_SQL = _PAIRS_CTE + """
, s AS (SELECT
   (SELECT count(*) FROM same) AS n_1, (SELECT count(*) FROM diff) AS n_2,
   (SELECT avg(distance) FROM same) AS mean_1, (SELECT avg(distance) FROM diff) AS mean_2,
   (SELECT var_samp(distance) FROM same) AS var_1, (SELECT var_samp(distance) FROM diff) AS var_2,
   (SELECT stddev_pop(distance) FROM same) AS std_1, (SELECT stddev_pop(distance) FROM diff) AS std_2)
"""


def _summary(spark, sf):
    ab = ST.tagged(*both_pairs(spark, sf))
    return ab, ST.two_sample_summary(ab)


@register("i1_ttest_ind", _SUMMARY_SQL + """
SELECT CAST(n_1 + n_2 - 2 AS DOUBLE) AS t_df,
  round((mean_1 - mean_2) / sqrt(((n_1 - 1) * var_1 + (n_2 - 1) * var_2) / (n_1 + n_2 - 2) * (1.0 / n_1 + 1.0 / n_2)), 6) AS t_stat
FROM s
""")
def i1_ttest_ind(spark, sf):
    _, s = _summary(spark, sf)
    return _round(ST.t_statistic(s).select("t_df", "t_stat"), ["t_stat"])


@register("i2_mann_whitney_u", _PAIRS_CTE + """
, ab AS (SELECT distance AS x, 1 AS g FROM same UNION ALL SELECT distance, 0 FROM diff),
vc AS (SELECT x, count(*) AS c, sum(g) AS c1 FROM ab GROUP BY x),
r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM vc)
SELECT round(sum(c1 * (before + (c + 1) / 2.0)) - sum(c1) * (sum(c1) + 1) / 2.0, 6) AS u_stat,
       round(CAST(sum(c * c * c - c) AS DOUBLE), 6) AS tie_term FROM r
""")
def i2_mann_whitney_u(spark, sf):
    ab, _ = _summary(spark, sf)
    return _round(ST.mann_whitney(ab).select("u_stat", "tie_term"), ["u_stat", "tie_term"])


@register("i3_cohens_d", _SUMMARY_SQL + """
SELECT round((mean_1 - mean_2) / sqrt((std_1 * std_1 + std_2 * std_2) / 2), 6) AS cohens_d FROM s
""")
def i3_cohens_d(spark, sf):
    _, s = _summary(spark, sf)
    return _round(ST.with_effects(s).select("cohens_d"), ["cohens_d"])


@register("i4_mean_diff_pct", _SUMMARY_SQL + """
SELECT round(mean_1 - mean_2, 6) AS mean_diff, round((mean_1 - mean_2) / mean_2 * 100, 6) AS mean_diff_pct FROM s
""")
def i4_mean_diff_pct(spark, sf):
    _, s = _summary(spark, sf)
    return _round(ST.with_effects(s).select("mean_diff", "mean_diff_pct"), ["mean_diff", "mean_diff_pct"])


@register("i5_effect_label", _SUMMARY_SQL + """
, d AS (SELECT (mean_1 - mean_2) / sqrt((std_1 * std_1 + std_2 * std_2) / 2) AS cd, mean_1 - mean_2 AS md FROM s)
SELECT CASE WHEN abs(cd) < 0.2 THEN 'negligible' WHEN abs(cd) < 0.5 THEN 'small' WHEN abs(cd) < 0.8 THEN 'medium'
            ELSE 'large' END AS effect_size,
       CASE WHEN md < 0 THEN 'closer' ELSE 'farther' END AS direction FROM d
""")
def i5_effect_label(spark, sf):
    _, s = _summary(spark, sf)
    e = ST.with_effects(s)
    return e.select("effect_size", F.when(F.col("mean_diff") < 0, "closer").otherwise("farther").alias("direction"))


@register("i6_distance_report", _SUMMARY_SQL + """
, ab AS (SELECT distance AS x, 1 AS g FROM same UNION ALL SELECT distance, 0 FROM diff),
vc AS (SELECT x, count(*) AS c, sum(g) AS c1 FROM ab GROUP BY x),
r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM vc),
u AS (SELECT sum(c1 * (before + (c + 1) / 2.0)) - sum(c1) * (sum(c1) + 1) / 2.0 AS u_stat FROM r),
e AS (SELECT *, (mean_1 - mean_2) / sqrt((std_1 * std_1 + std_2 * std_2) / 2) AS cd,
             (mean_1 - mean_2) / sqrt(((n_1 - 1) * var_1 + (n_2 - 1) * var_2) / (n_1 + n_2 - 2) * (1.0 / n_1 + 1.0 / n_2)) AS t
      FROM s)
SELECT n_1, n_2, round(mean_1, 6) AS same_mean, round(mean_2, 6) AS diff_mean,
       (SELECT round(median(distance), 6) FROM same) AS same_median, (SELECT round(median(distance), 6) FROM diff) AS diff_median,
       round(t, 6) AS t_stat, round(u_stat, 6) AS u_stat, round(cd, 6) AS cohens_d,
       round((mean_1 - mean_2) / mean_2 * 100, 6) AS mean_diff_pct,
       CASE WHEN abs(cd) < 0.2 THEN 'negligible' WHEN abs(cd) < 0.5 THEN 'small' WHEN abs(cd) < 0.8 THEN 'medium'
            ELSE 'large' END AS effect_size
FROM e, u
""")
def i6_distance_report(spark, sf):
    """One-row report without its p-values and verdict (checked in tests/test_units.py)."""
    r = ST.distance_report(*both_pairs(spark, sf))
    return _round(r, ["same_mean", "diff_mean", "same_median", "diff_median", "t_stat", "u_stat", "cohens_d",
                      "mean_diff_pct"]).drop("t_pvalue", "u_pvalue", "verdict")
