"""Queries for projection, predicates and scalar cleaning.

Raw text input is made from the given tables: numeric columns are rendered
as strings and a fixed rule (by line number / key) swaps in null spellings,
padding, and junk, so the cleaning rules have something to act on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as CL
from ..functions.hashing import md5_u32
from ..operators import projection as P
from ..session import read_table
from . import register


@register("b1_select_existing", "SELECT l_orderkey, l_quantity, l_returnflag, l_shipdate FROM lineitem")
def b1_select_existing(spark, sf):
    df, missing = P.select_existing(read_table(spark, sf, "lineitem"),
                                    ["l_orderkey", "l_quantity", "no_such_col", "l_returnflag", "l_shipdate"])
    assert missing == ["no_such_col"]
    return df


@register("b2_rename", "SELECT l_orderkey AS order_id, l_linenumber AS line_id, l_quantity FROM lineitem")
def b2_rename(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return P.rename(li, {"l_orderkey": "order_id", "l_linenumber": "line_id", "absent": "x"})


# Raw-text rendering of lineitem used by B3/B5/B6: tokens chosen by line number.
_RAW_SQL = """
WITH raw AS (
  SELECT l_orderkey, l_linenumber,
    CASE l_linenumber WHEN 1 THEN ' NA ' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN '#N/A'
         WHEN 5 THEN '  ' || l_returnflag || chr(9) ELSE l_returnflag END AS flag_txt,
    CASE WHEN l_linenumber = 6 THEN 'abc' WHEN l_linenumber = 7 THEN 'NaN'
         ELSE CAST(l_quantity AS VARCHAR) END AS qty_txt,
    CASE WHEN l_linenumber = 2 THEN CAST(l_partkey AS VARCHAR) || '.0'
         WHEN l_linenumber = 4 THEN 'x' || CAST(l_partkey AS VARCHAR)
         ELSE CAST(l_partkey AS VARCHAR) END AS part_txt
  FROM lineitem
)
"""


def _raw(spark, sf):
    li = read_table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    flag = (F.when(ln == 1, " NA ").when(ln == 2, "").when(ln == 3, "NaN").when(ln == 4, "#N/A")
            .when(ln == 5, F.concat(F.lit("  "), F.col("l_returnflag"), F.lit("\t"))).otherwise(F.col("l_returnflag")))
    qty = F.when(ln == 6, "abc").when(ln == 7, "NaN").otherwise(F.col("l_quantity").cast("string"))
    part = (F.when(ln == 2, F.concat(F.col("l_partkey").cast("string"), F.lit(".0")))
            .when(ln == 4, F.concat(F.lit("x"), F.col("l_partkey").cast("string")))
            .otherwise(F.col("l_partkey").cast("string")))
    return li.select("l_orderkey", "l_linenumber", flag.alias("flag_txt"), qty.alias("qty_txt"),
                     part.alias("part_txt"))


_TOKENS_SQL = "('#N/A','#N/A N/A','#NA','-1.#IND','-1.#QNAN','-NaN','-nan','1.#IND','1.#QNAN','<NA>','N/A','NA','NULL','NaN','None','n/a','nan','null','')"
_TRIM_SQL = "regexp_replace({c}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')"


@register("b3_null_tokens", _RAW_SQL + f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN {_TRIM_SQL.format(c='flag_txt')} IN {_TOKENS_SQL} THEN NULL ELSE {_TRIM_SQL.format(c='flag_txt')} END AS flag
FROM raw
""")
def b3_null_tokens(spark, sf):
    return _raw(spark, sf).select("l_orderkey", "l_linenumber", CL.null_tokens("flag_txt").alias("flag"))


@register("b4_trim_text", f"""
SELECT doc_id, {_TRIM_SQL.format(c='text')} AS text_clean, {_TRIM_SQL.format(c="'  ' || lang || chr(10)")} AS lang
FROM documents
""")
def b4_trim_text(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", CL.strip_ws("text").alias("text_clean"),
                    CL.strip_ws(F.concat(F.lit("  "), F.col("lang"), F.lit("\n"))).alias("lang"))


@register("b5_to_numeric", _RAW_SQL + """
SELECT l_orderkey, l_linenumber,
  CASE WHEN isnan(TRY_CAST(qty_txt AS DOUBLE)) THEN NULL ELSE TRY_CAST(qty_txt AS DOUBLE) END AS qty,
  CAST(trunc(TRY_CAST(part_txt AS DOUBLE)) AS BIGINT) AS partkey
FROM raw
""")
def b5_to_numeric(spark, sf):
    return _raw(spark, sf).select("l_orderkey", "l_linenumber", CL.to_double("qty_txt").alias("qty"),
                                  CL.to_bigint("part_txt").alias("partkey"))


@register("b6_drop_missing_required", _RAW_SQL + f"""
SELECT * FROM (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN {_TRIM_SQL.format(c='flag_txt')} IN {_TOKENS_SQL} THEN NULL ELSE {_TRIM_SQL.format(c='flag_txt')} END AS flag,
    CASE WHEN isnan(TRY_CAST(qty_txt AS DOUBLE)) THEN NULL ELSE TRY_CAST(qty_txt AS DOUBLE) END AS qty
  FROM raw) WHERE flag IS NOT NULL AND qty IS NOT NULL
""")
def b6_drop_missing_required(spark, sf):
    typed = _raw(spark, sf).select("l_orderkey", "l_linenumber", CL.null_tokens("flag_txt").alias("flag"),
                                   CL.to_double("qty_txt").alias("qty"))
    out, _obs = P.drop_missing_required(typed, ["flag", "qty", "not_present"])
    return out


@register("b7_dropna_any", """
SELECT * FROM (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <> 3 THEN l_suppkey END AS supp, CASE WHEN l_quantity > 5 THEN l_quantity END AS qty
  FROM lineitem) WHERE supp IS NOT NULL AND qty IS NOT NULL
""")
def b7_dropna_any(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_suppkey")).alias("supp"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("qty"))
    return P.dropna_any(li)


@register("b8_column_order", "SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem")
def b8_column_order(spark, sf):
    return P.order_columns(read_table(spark, sf, "lineitem"),
                           ["l_shipdate", "missing", "l_orderkey", "l_linenumber", "l_quantity"])


@register("b9_drop_existing", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def b9_drop_existing(spark, sf):
    return P.drop_existing(read_table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority", "not_there"])


@register("b10_not_null_filter", """
SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
""")
def b10_not_null_filter(spark, sf):
    return P.not_null_filter(read_table(spark, sf, "embeddings"), "embedding", "label").select("vec_id", "label")


@register("b11_bernoulli_sample", """
SELECT event_id, event_type, value FROM events
WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 15))::BIGINT < 11529215046068470
""")
def b11_bernoulli_sample(spark, sf):
    ev = read_table(spark, sf, "events")
    return P.bernoulli_sample(ev, "event_id", 0.01, seed=42).select("event_id", "event_type", "value")


@register("b12_limit", "SELECT event_id, user_id, event_type FROM events ORDER BY ts, event_id LIMIT 50")
def b12_limit(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return P.limit_ordered(ev, 50, "ts", "event_id").drop("ts")


@register("b13_isin_filter", """
SELECT vec_id, label FROM (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN NULL ELSE label END AS label FROM embeddings)
WHERE label IS NULL OR label NOT IN (4, 6)
""")
def b13_isin_filter(spark, sf):
    e = read_table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.pmod("vec_id", F.lit(50)) != 0, F.col("label")).alias("label"))
    return P.isin_filter(e, "label", [4, 6], exclude=True, keep_nulls=True)


@register("b14_contains_filter", "SELECT doc_id, lang FROM documents WHERE contains(text, '.')")
def b14_contains_filter(spark, sf):
    return P.contains_filter(read_table(spark, sf, "documents"), "text", ".").select("doc_id", "lang")


@register("b15_regex_strip", """
SELECT doc_id, regexp_replace(text, '\\([0-9]+\\)', '', 'g') AS text_clean FROM documents
""")
def b15_regex_strip(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", CL.strip_paren_numbers("text").alias("text_clean"))


@register("b16_date_to_int", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS date_int,
       CAST(replace(strftime(o_orderdate, '%Y-%m-%d'), '-', '') AS BIGINT) AS date_int_str
FROM orders
""")
def b16_date_to_int(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", CL.date_to_int("o_orderdate").alias("date_int"),
                    CL.date_string_to_int(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_int_str"))


_DATE_TXT_SQL = """
WITH t AS (SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                      WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
                      WHEN 2 THEN strftime(o_orderdate, '%Y-%m') || '-31'
                      WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'x'
                      ELSE strftime(o_orderdate, '%Y-%m') || '-30' END AS d_txt
  FROM orders)
"""


def _date_txt(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.pmod("o_orderkey", F.lit(5))
    d = F.col("o_orderdate")
    txt = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM/dd"))
           .when(k == 2, F.concat(F.date_format(d, "yyyy-MM"), F.lit("-31")))
           .when(k == 3, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("x")))
           .otherwise(F.concat(F.date_format(d, "yyyy-MM"), F.lit("-30"))))
    return o.select("o_orderkey", txt.alias("d_txt"))


@register("b17_validate_date", _DATE_TXT_SQL + """
SELECT o_orderkey, d_txt, CAST(try_strptime(d_txt, '%Y-%m-%d') AS DATE) AS d_valid FROM t
""")
def b17_validate_date(spark, sf):
    t = _date_txt(spark, sf)
    return t.select("o_orderkey", "d_txt", CL.valid_iso_date("d_txt").alias("d_valid"))


@register("b18_month_series", """
SELECT CAST(m AS DATE) AS month_start
FROM (SELECT date_trunc('month', min(o_orderdate)) AS s, date_trunc('month', max(o_orderdate)) AS e FROM orders),
     LATERAL unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS g(m)
""")
def b18_month_series(spark, sf):
    from ..plans.ingest import month_series_from
    return month_series_from(read_table(spark, sf, "orders"), "o_orderdate")


@register("b19_month_bounds", """
SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day,
       CAST(last_day(o_orderdate) AS DATE) AS last_day
FROM orders
""")
def b19_month_bounds(spark, sf):
    from ..plans.ingest import month_bounds
    return month_bounds(read_table(spark, sf, "orders"), "o_orderdate")


@register("b20_category_label", "SELECT vec_id, 'Event_' || CAST(label AS VARCHAR) AS category FROM embeddings")
def b20_category_label(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", CL.category_label("label").alias("category"))


@register("b21_int_events", """
SELECT event_id, CAST(trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS INTEGER) AS k
FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL
""")
def b21_int_events(spark, sf):
    ev = read_table(spark, sf, "events")
    k = CL.to_double(F.get_json_object("props", "$.k")).cast("int")
    return ev.select("event_id", k.alias("k")).where(F.col("k").isNotNull())
