"""Queries of conversations (11), source divergence (12) and byte-level BPE (13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import read_table
from .divergence import divergence
from .registry import register
from .turns import damaged, repair_conversations

# One row per conversation and step; a state is the least (cost, audit) with its text, null where it can't be.
_ADD = "{{'c': {p}.c + {c}, 'a': {p}.a || '{a}', 't': {p}.t || chr(10) || {t}}}"


def _sql_edit(p, cost, letter, text):
    made = _ADD.format(p=p, c=cost, a=letter, t=text)
    return f"CASE WHEN {p} IS NOT NULL THEN {made} END"


def _sql_row(p, role, to):
    delete = f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + 4, 'a': {p}.a || 'D', 't': {p}.t}} END"
    keep = f"CASE WHEN i = '{role}' AND NOT gone THEN {_sql_edit(p, '3 * cut::INT', 'K', 'line')} END"
    if to is None:
        return delete, keep
    text = f"('{to}:' || text)"
    return delete, keep, f"CASE WHEN NOT gone THEN {_sql_edit(p, '3 + 3 * cut::INT', 'R', text)} END"


_D0, _S = _sql_row("p0", "s", None)
_D1, _D2, _D3 = (_sql_row(p, "s", None)[0] for p in ("p1", "p2", "p3"))
_TO_USER = [x for p in ("p0", "p1", "p3") for x in _sql_row(p, "u", "user")[1:]]
_TO_ASSISTANT = list(_sql_row("p2", "a", "assistant")[1:])
_INSERT_USER = ", ".join(_sql_edit(q, 3, "I", "'user:'") for q in ("q0", "q1", "q3"))
_INSERT_ASSISTANT = _sql_edit("p2", 3, "I", "'assistant:'")
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda j: ascii(k[j])::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@register("op11_conversation_repair", rf"""
WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS f FROM k),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c),
o AS (SELECT *, role || ':' || text AS line, left(role, 1) AS i, coalesce(conv_id::VARCHAR, '') AS conv, conv_id IS NULL AS no,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
x AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
             row_number() OVER (PARTITION BY conv, no, role, text ORDER BY n) > 1 AS again,
             regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') AS cut,
             lag(i) OVER (PARTITION BY conv, no ORDER BY n) AS before FROM o),
r AS (SELECT *, blank OR again AS gone FROM x),
s(conv, no, n, p0, p1, p2, p3) AS (
  SELECT DISTINCT conv, no, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}, NULL::STRUCT(c INT, a VARCHAR, t VARCHAR),
         {{'c': 3, 'a': 'I', 't': chr(10) || 'user:'}}, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} FROM r
  UNION ALL
  SELECT conv, no, n, p0, p1, p2, list_min([p3, {_INSERT_ASSISTANT}]) FROM (
    SELECT conv, no, n, q0 AS p0, q1 AS p1, list_min([q2, {_INSERT_USER}]) AS p2, q3 AS p3 FROM (
      SELECT r.conv, r.no, r.n, {_D0} AS q0, list_min([{_D1}, {_S}]) AS q1,
             list_min([{_D2}, {", ".join(_TO_USER)}]) AS q2, list_min([{_D3}, {", ".join(_TO_ASSISTANT)}]) AS q3
      FROM s JOIN r ON r.conv = s.conv AND r.no = s.no AND r.n = s.n + 1))),
t AS (SELECT conv, no, list_min([p0, p3]) AS best FROM (
        SELECT *, max(n) OVER (PARTITION BY conv, no) AS last FROM s) WHERE n = last),
g AS (SELECT conv, no, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
             count_if(cut AND NOT again AND NOT blank) AS truncated, count_if(before || i NOT IN ('su', 'ua', 'au')) AS illegal,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv, no),
a AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv, conv_id IS NULL AS no FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM a LEFT JOIN t USING (conv, no) LEFT JOIN g USING (conv, no)
""")
def op11(spark, sf_dir):
    convs = read_table(spark, sf_dir, "conversations")
    kind = dict(convs.dtypes)["conv_id"]
    repair = repair_conversations(damaged(convs))
    named = lambda df, c: df.withColumnRenamed("conv", c)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    every = convs.select(F.col("conv_id").cast("string").alias("id")).distinct()
    out = (every.join(named(repair.report, "a"), F.col("id").eqNullSafe(F.col("a")), "left")
           .join(named(repair.digests(), "b"), F.col("id").eqNullSafe(F.col("b")), "left"))
    return out.select(F.col("id").cast(kind).alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@register("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
g AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT rid) AS m FROM w GROUP BY ALL),
t AS (SELECT lang, term, sum(c)::BIGINT AS c FROM g GROUP BY ALL HAVING sum(m) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM t GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT s.lang, s.source, coalesce(sum(g.c), 0)::BIGINT AS n
      FROM s LEFT JOIN (SELECT * FROM g SEMI JOIN t USING (lang, term)) g USING (lang, source) GROUP BY ALL),
k AS (SELECT n.lang, n.source, t.term, coalesce(g.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(g.c, 0) + 5)) // (n.n + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (t.c + 5)) // (l.n + 5 * l.v) AS q
      FROM n JOIN l USING (lang) JOIN t USING (lang)
      LEFT JOIN g ON g.lang = n.lang AND g.source = n.source AND g.term = t.term),
p AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM k WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
""")
def op12(spark, sf_dir):
    return divergence(read_table(spark, sf_dir, "documents"), min_docs=30, top=50)


@register("op13_byte_bpe")
def op13(spark, sf_dir):
    import public_tokenizers

    out = encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                           public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
