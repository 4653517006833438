"""Queries of the other operators: nearest vectors (1), quality (4), substrings (6), archives (7), personal data (10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .ann import nearest
from .common import read_table
from .pii import personal_data
from .quality import score_quality
from .registry import register
from .substrings import dedup_substrings
from .warc import read_warc, write_warc


@register("op4_quality")
def op4(spark, sf_dir):
    out = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "rejected")


@register("op7_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS low
      FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> low THEN low END AS refers_to
FROM h
""")
def op7(spark, sf_dir):
    records = read_warc(spark, write_warc(read_table(spark, sf_dir, "pages")), with_data=False)
    page = lambda c: F.regexp_extract(c, "urn:page:([^>]*)", 1).try_cast("long")
    return records.where("last").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                                        "record_type", page("refers_to").alias("refers_to"))


@register("op6_substring_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT rid, unnest(list_transform(range(1, len(w) - 33), lambda i: {'i': i, 's': array_to_string(w[i:i + 34], ' ')})) AS s
      FROM d WHERE len(w) >= 35),
r AS (SELECT rid, i FROM (SELECT rid, s.i AS i, count(*) OVER (PARTITION BY s.s) AS m FROM x) WHERE m > 1),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r),
l AS (SELECT rid, list(p ORDER BY p) AS gone FROM g GROUP BY rid),
p AS (SELECT d.rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d SEMI JOIN l ON d.rid = l.rid),
k AS (SELECT p.rid, string_agg(word, ' ' ORDER BY p.p) AS kept FROM p ANTI JOIN g ON p.rid = g.rid AND p.p = g.p
      GROUP BY p.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN l ON d.rid = l.rid LEFT JOIN k ON d.rid = k.rid
""")
def op6(spark, sf_dir):
    out = dedup_substrings(read_table(spark, sf_dir, "documents"), n=35, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op10_personal_data")
def op10(spark, sf_dir):
    out = personal_data(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@register("op1_nearest")
def op1(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"), k=10)
