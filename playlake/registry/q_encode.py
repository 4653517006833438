"""Queries for feature encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as EN
from ..session import read_table, scratch_path
from . import register

_MD5_DICT_SQL = """
WITH d AS (SELECT DISTINCT coalesce(CAST({col} AS VARCHAR), 'None') AS label FROM {table}),
w AS (SELECT label, count(*) OVER () AS k FROM d),
h AS (SELECT label, CASE WHEN k % 2 = 1 THEN k + 1 ELSE k END AS width,
             ('0x' || substr(md5('{col}=' || label), 1, 8))::BIGINT AS hv FROM w),
dict AS (SELECT label, width,
   list_transform(range(0, width), lambda i: CASE WHEN i = hv % width THEN
        (CASE WHEN (hv // width) % 2 = 0 THEN 1 ELSE -1 END) ELSE 0 END) AS vec
   FROM h)
"""


@register("d1_feature_hash", _MD5_DICT_SQL.format(col="l_returnflag", table="lineitem") + """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, array_to_string(d.vec, ',') AS hash_vec
FROM lineitem l LEFT JOIN dict d ON coalesce(CAST(l.l_returnflag AS VARCHAR), 'None') = d.label
""")
def d1_feature_hash(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    out, _ = EN.feature_hash(li, "l_returnflag", method="md5")
    return out.select("l_orderkey", "l_linenumber", "l_partkey",
                      F.array_join(EN.dense("l_returnflag").cast("array<string>"), ",").alias("hash_vec"))


# Signed MurmurHash3 slots of "event_type=<value>" in width 6 (fixed values, from the public algorithm).
@register("d1_feature_hash_murmur3", """
WITH k(event_type, hash_vec) AS (VALUES ('click', '1,0,0,0,0,0'), ('error', '0,0,0,0,0,-1'), ('purchase', '0,0,-1,0,0,0'),
  ('signup', '0,-1,0,0,0,0'), ('view', '0,1,0,0,0,0'))
SELECT event_id, hash_vec FROM events LEFT JOIN k USING (event_type)
""")
def d1_feature_hash_murmur3(spark, sf):
    """Signed MurmurHash3 vectors (checked against public test vectors in tests/)."""
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    out, _ = EN.feature_hash(ev, "event_type", method="murmur3")
    return out.select("event_id", F.array_join(EN.dense("event_type").cast("array<string>"), ",").alias("hash_vec"))


@register("d2_expand_vector", _MD5_DICT_SQL.format(col="o_orderpriority", table="orders") + """
SELECT o.o_orderkey, d.vec[1] AS o_orderpriority0, d.vec[2] AS o_orderpriority1, d.vec[3] AS o_orderpriority2,
       d.vec[4] AS o_orderpriority3, d.vec[5] AS o_orderpriority4, d.vec[6] AS o_orderpriority5, o.o_totalprice
FROM orders o LEFT JOIN dict d ON coalesce(CAST(o.o_orderpriority AS VARCHAR), 'None') = d.label
""")
def d2_expand_vector(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    dictionary = EN.hash_dictionary(o, "o_orderpriority", method="md5")
    width = dictionary.agg(F.max("width")).first()[0]  # one number for the column layout
    hashed, _ = EN.feature_hash(o, "o_orderpriority", dictionary=dictionary)
    return EN.expand_vector(hashed, "o_orderpriority", width)


@register("d3_category_codes", """
SELECT o_orderkey, coalesce(c.code, -1) AS o_orderpriority, o_orderstatus
FROM orders o LEFT JOIN (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code
  FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)) c USING (o_orderpriority)
""")
def d3_category_codes(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    coded, _ = EN.category_codes(o, "o_orderpriority")
    return coded


@register("d3_stable_codes", """
WITH f AS (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' AND o_orderpriority > '2'),
n AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM f),
m AS (SELECT p, (SELECT count(*) FROM f) + row_number() OVER (ORDER BY p) - 1 AS code
      FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority NOT IN (SELECT p FROM f)))
SELECT o_orderkey, CAST(coalesce(c.code, -1) AS BIGINT) AS priority_code
FROM orders LEFT JOIN (SELECT * FROM n UNION ALL SELECT * FROM m) c ON c.p = o_orderpriority
""")
def d3_stable_codes(spark, sf):
    """A dictionary of a first load, grown by a later one: the first codes stay."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    path = scratch_path(spark, "d3_codes")
    EN.stable_dictionary(o.where("o_orderdate < timestamp_ntz '1993-01-01' AND o_orderpriority > '2'"), "o_orderpriority", path)
    dictionary = EN.stable_dictionary(o, "o_orderpriority", path)
    return EN.category_codes(o, "o_orderpriority", "priority_code", dictionary)[0].select("o_orderkey", "priority_code")


@register("d4_presence_flag", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(CASE WHEN l_linenumber <> 3 THEN 1 ELSE 0 END AS BIGINT) AS on_base FROM lineitem
""")
def d4_presence_flag(spark, sf):
    li = read_table(spark, sf, "lineitem")
    runner = F.when(F.col("l_linenumber") != 3, F.col("l_suppkey"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", EN.presence_flag(runner).alias("on_base"))


# Analog outcome map over the event types (the production map is EN.OUTCOME_MAP).
EVENT_TYPE_MAP = {"click": "single", "purchase": "homerun", "view": "out", "signup": "walk"}


@register("d5_outcome_recode", """
SELECT event_id, event_type, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 4
       WHEN 'view' THEN 6 WHEN 'signup' THEN 8 ELSE 0 END AS BIGINT) AS outcome_code FROM events
""")
def d5_outcome_recode(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    return EN.outcome_recode(ev, "event_type", mapping=EVENT_TYPE_MAP)


_KEY_SQL = _MD5_DICT_SQL.format(col="l_returnflag", table="lineitem") + """
SELECT 'l_linestatus' AS feature, CAST(row_number() OVER (ORDER BY l_linestatus) - 1 AS BIGINT) AS code,
       l_linestatus AS label, NULL AS hash_vec
FROM (SELECT DISTINCT l_linestatus FROM lineitem WHERE l_linestatus IS NOT NULL)
UNION ALL
SELECT 'l_returnflag', NULL, label, array_to_string(vec, ',') FROM dict
UNION ALL
SELECT 'events', CAST(i AS BIGINT), g, NULL FROM (SELECT unnest(range(0, 11)) AS i,
  unnest(['other','single','double','triple','homerun','strikeout','out','multi_out','walk','awarded_first','field_play']) AS g)
"""


def _key_table(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    codes = EN.category_dictionary(li, "l_linestatus")
    hashes = EN.hash_dictionary(li, "l_returnflag", method="md5")
    kt = EN.key_table(EN.code_key(codes, "l_linestatus", "l_linestatus"),
                      EN.hash_key(hashes, "l_returnflag"), EN.outcome_key(spark))
    return kt


def _key_out(kt):
    return kt.select("feature", "code", "label", F.array_join(EN.dense("hash").cast("array<string>"), ",").alias("hash_vec"))


@register("d6_key_table", _KEY_SQL)
def d6_key_table(spark, sf):
    return _key_out(_key_table(spark, sf))


@register("a13_write_key_table", _KEY_SQL)
def a13_write_key_table(spark, sf):
    path = scratch_path(spark, "a13_key")
    _key_table(spark, sf).write.mode("overwrite").parquet(path)
    return _key_out(spark.read.parquet(path))


@register("d7_apply_columns", """
SELECT c_custkey, upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment, c_acctbal FROM customer
""")
def d7_apply_columns(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    out, missing = EN.apply_columns(c, ["c_name", "c_mktsegment", "c_phone"], lambda n: F.upper(F.col(n)))
    assert missing == ["c_phone"]
    return out


@register("d8_label_encode", """
SELECT c_custkey, c_mktsegment, coalesce(d.code, -1) AS segment_code
FROM customer LEFT JOIN (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code
  FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)) d USING (c_mktsegment)
""")
def d8_label_encode(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return EN.label_encode(c, "c_mktsegment", "segment_code")
