"""Queries over whole texts: line chunks (8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read_table
from .contamination import contamination
from .lines import dedup_lines
from .minhash import near_duplicates
from .registry import register


@register("op8_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS v FROM l),
r AS (SELECT *, (lag(v) OVER w * 31 + v) % 2147483648 % 2 = 0 AS f FROM h WINDOW w AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT *, coalesce(f, false) AND NOT coalesce(lag(f) OVER w, false) AS cut
      FROM r WINDOW w AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY rid ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c),
k AS (SELECT rid, doc_id, chunk, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body
      FROM g GROUP BY ALL),
o AS (SELECT rid, chunk, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1 AS gone
      FROM k WHERE n > 1),
e AS (SELECT g.rid, string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)) AS body,
             count(*) FILTER (coalesce(gone, false)) AS n_removed
      FROM g LEFT JOIN o ON g.rid = o.rid AND g.chunk = o.chunk GROUP BY g.rid)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN text IS NOT NULL THEN coalesce(body, '') END) AS kept_sha256
FROM d LEFT JOIN e ON d.rid = e.rid
""")
def op8(spark, sf_dir):
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op3_near_duplicates", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
           THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
      FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * i >= 85 * (na.n + nb.n - i)),
c AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON c.v = e.a),
m AS (SELECT v, min(r) AS component_id FROM c GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op3(spark, sf_dir):
    out = near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@register("op5_decontamination", r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS x
  FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2),
           lambda i: {'a': i, 'x': array_to_string(w[i:i + n - 1], ' ')})) AS s
  FROM d, ns WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, dw.n, s.a AS a FROM dw JOIN bw ON dw.n = bw.n AND s.x = bw.x),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
""")
def op5(spark, sf_dir):
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
