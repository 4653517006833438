"""Queries of the row-wise operators: url rules (2) and mixing (9)."""

from __future__ import annotations

from .common import read_table
from .mixing import mix_plan
from .registry import register
from .urls import filter_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register("op2_url_filter", r"""
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS rid
  FROM pages),
r(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT p.rid, r.rh || r.rp AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.rid ORDER BY length(r.rh || r.rp) DESC, length(r.rh) DESC,
                            r.verdict DESC) AS i
  FROM p JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.rid = m.rid AND m.i = 1
""")
def op2(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(read_table(spark, sf_dir, "pages"), rules)


@register("op9_mixing", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))
           ::BIGINT / 4503599627370496.0 AS coin
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
q AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS fill FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM q WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN fill <= level THEN cap
              ELSE w * max(CASE WHEN fill > level THEN level END) OVER () END AS target
  FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
""")
def op9(spark, sf_dir):
    plan = mix_plan(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_rate=2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")
