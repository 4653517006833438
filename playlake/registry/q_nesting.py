"""Queries for nested data (C1-C10) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nesting as N
from ..plans import rollup as RO
from ..plans.slice import ITEM_COLS, nested_orders, returnflag_status_crosstab
from ..session import read_table, scratch_path
from ..sources import versions as V
from . import register


@register("slice_returnflag_crosstab", """
WITH single AS (
  SELECT l_orderkey FROM lineitem GROUP BY l_orderkey
  HAVING min(l_suppkey) = max(l_suppkey)
), flat AS (
  SELECT l.* FROM lineitem l JOIN single s USING (l_orderkey)
), codes AS (
  SELECT l_returnflag, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS returnflag_code
  FROM (SELECT DISTINCT l_returnflag FROM flat WHERE l_returnflag IS NOT NULL)
)
SELECT coalesce(c.returnflag_code, -1) AS returnflag_code,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_f,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_o
FROM flat f LEFT JOIN codes c USING (l_returnflag)
GROUP BY 1
""")
def slice_returnflag_crosstab(spark, sf):
    return returnflag_status_crosstab(read_table(spark, sf, "lineitem"))


_NEST_SQL_SINGLE = """
WITH g AS (
  SELECT l_orderkey,
         count(*) AS n_items,
         min(l_suppkey) = max(l_suppkey) AS single_supp,
         list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS parts,
         arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS hdr_flag
  FROM lineitem GROUP BY l_orderkey
)
"""


@register("c1_nest_pitches", _NEST_SQL_SINGLE + """
SELECT l_orderkey, CAST(n_items AS BIGINT) AS n_items, parts[1] AS first_part,
       parts[len(parts)] AS last_part, array_to_string(parts, ',') AS part_seq
FROM g
""")
def c1_nest_pitches(spark, sf):
    li = read_table(spark, sf, "lineitem")
    nested = N.nest_sequences(li, ["l_orderkey"], ["l_linenumber"], ITEM_COLS, items_name="lines")
    return nested.select(
        "l_orderkey", F.size("lines").cast("bigint").alias("n_items"),
        F.col("lines")[0]["l_partkey"].alias("first_part"),
        F.element_at("lines", -1)["l_partkey"].alias("last_part"),
        F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("part_seq"))


@register("c2_atbat_header", _NEST_SQL_SINGLE + """
SELECT l_orderkey, hdr_flag AS l_returnflag FROM g
""")
def c2_atbat_header(spark, sf):
    li = read_table(spark, sf, "lineitem")
    nested = N.nest_sequences(li, ["l_orderkey"], ["l_linenumber"], ITEM_COLS,
                              header_cols=["l_returnflag"], items_name="lines")
    return nested.select("l_orderkey", "l_returnflag")


@register("c3_drop_multi_pitcher", _NEST_SQL_SINGLE + """
SELECT l_orderkey, CAST(n_items AS BIGINT) AS n_items FROM g WHERE single_supp
""")
def c3_drop_multi_pitcher(spark, sf):
    nested = nested_orders(read_table(spark, sf, "lineitem"))
    return nested.select("l_orderkey", F.size("lines").cast("bigint").alias("n_items"))


# Null cases are injected by a fixed rule: line 3 loses its supplier, and
# orders whose key ends in 7 lose their header flag on the last line.
def _with_nulls(li):
    return li.withColumn("l_suppkey", F.when(F.col("l_linenumber") != 3, F.col("l_suppkey"))) \
             .withColumn("l_returnflag", F.when(F.pmod("l_orderkey", F.lit(10)) != 7, F.col("l_returnflag")))


_NULLS_CTE = """
WITH li AS (
  SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_suppkey END AS l_suppkey,
                    CASE WHEN l_orderkey % 10 <> 7 THEN l_returnflag END AS l_returnflag)
  FROM lineitem
), g AS (
  SELECT l_orderkey, count(*) AS n_items,
         bool_or(l_suppkey IS NULL OR l_partkey IS NULL) AS has_null,
         arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS hdr_flag,
         count(*) FILTER (WHERE l_quantity >= 10 AND l_discount > 0.0) AS n_kept
  FROM li GROUP BY l_orderkey
)
"""


@register("c4_drop_null_group", _NULLS_CTE + """
SELECT l_orderkey, CAST(n_items AS BIGINT) AS n_items, hdr_flag AS l_returnflag
FROM g WHERE NOT has_null AND hdr_flag IS NOT NULL
""")
def c4_drop_null_group(spark, sf):
    li = _with_nulls(read_table(spark, sf, "lineitem"))
    nested = N.nest_sequences(li, ["l_orderkey"], ["l_linenumber"], ITEM_COLS,
                              header_cols=["l_returnflag"], no_null_cols=["l_suppkey", "l_partkey"],
                              header_required="l_returnflag", items_name="lines")
    return nested.select("l_orderkey", F.size("lines").cast("bigint").alias("n_items"), "l_returnflag")


@register("c5_drop_bad_pitches", """
SELECT l_orderkey,
       CAST(count(*) FILTER (WHERE l_quantity >= 10 AND l_discount > 0.0) AS BIGINT) AS n_kept
FROM lineitem GROUP BY l_orderkey
""")
def c5_drop_bad_pitches(spark, sf):
    # Items failing the rule get their required field nulled, then skipped.
    li = read_table(spark, sf, "lineitem")
    li = li.withColumn("l_quantity", F.when(F.col("l_quantity") >= 10, F.col("l_quantity"))) \
           .withColumn("l_discount", F.when(F.col("l_discount") > 0.0, F.col("l_discount")))
    nested = N.nest_sequences(li, ["l_orderkey"], ["l_linenumber"], ITEM_COLS,
                              required_item_cols=["l_quantity", "l_discount"], items_name="lines")
    return nested.select("l_orderkey", F.size("lines").cast("bigint").alias("n_kept"))


@register("c6_typed_struct", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line,
       CAST(trunc(l_extendedprice) AS BIGINT) AS price_int, CAST(l_quantity AS DOUBLE) AS qty
FROM lineitem
""")
def c6_typed_struct(spark, sf):
    li = read_table(spark, sf, "lineitem")
    nested = N.nest_sequences(li, ["l_orderkey"], ["l_linenumber", "l_extendedprice"],
                              ["l_quantity", "l_partkey", "l_suppkey"],
                              item_casts={"l_linenumber": "bigint", "l_extendedprice": "bigint",
                                          "l_quantity": "double"},
                              item_renames={"l_linenumber": "line", "l_extendedprice": "price_int",
                                            "l_quantity": "qty"}, items_name="lines")
    return N.unnest(nested, "lines").select("l_orderkey", "line", "price_int", "qty")


@register("c7_unnest_pitches", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM lineitem
WHERE l_quantity >= 10
""")
def c7_unnest_pitches(spark, sf):
    li = read_table(spark, sf, "lineitem")
    li = li.withColumn("l_quantity", F.when(F.col("l_quantity") >= 10, F.col("l_quantity")))
    nested = N.nest_sequences(li, ["l_orderkey"], ["l_linenumber"], ITEM_COLS,
                              required_item_cols=["l_quantity"], items_name="lines")
    return N.unnest(nested, "lines").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_quantity", "l_extendedprice")


@register("c8_season_stats", """
SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS period, CAST(count(*) AS BIGINT) AS n_orders,
       round(sum(o_totalprice), 4) AS total_price, round(max(o_totalprice), 4) AS max_price
FROM orders GROUP BY 1, 2
""")
def c8_season_stats(spark, sf):
    o = read_table(spark, sf, "orders")
    nested = N.nest_periods(o, "o_custkey", F.year("o_orderdate").cast("bigint"),
                            [F.count(F.lit(1)).alias("n_orders"),
                             F.round(F.sum("o_totalprice"), 4).alias("total_price"),
                             F.round(F.max("o_totalprice"), 4).alias("max_price")])
    return N.unnest(nested, "seasonal_stats")


@register("c8_stored_stats", """
SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS period, CAST(count(*) AS BIGINT) AS n_orders,
       round(sum(o_totalprice), 4) AS total_price, round(max(o_totalprice), 4) AS max_price
FROM orders GROUP BY 1, 2
""")
def c8_stored_stats(spark, sf):
    """Sums stored by month: a first load lacks a year and has another one wrong; after the loads that mend it, two refreshes."""
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    path, sums = scratch_path(spark, "c8_orders"), scratch_path(spark, "c8_sums")
    month, year = F.date_format(F.trunc(F.to_date("o_orderdate"), "month"), "yyyy-MM-dd"), F.year("o_orderdate")
    period = F.year("o_orderdate").cast("bigint")

    def partial(rows):
        return rows.groupBy(RO.PART, "o_custkey", period.alias("period")).agg(
            F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("most"))

    wrong = o.where(year != 1994).withColumn("o_totalprice", F.when(year == 1995, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    V.commit(spark, path, wrong, month)
    RO.refresh(spark, path, sums, partial)
    V.commit(spark, path, o.where(year == 1994), month)
    RO.refresh(spark, path, sums, partial)
    V.commit(spark, path, o.where(year == 1995), month, default="replace")
    RO.refresh(spark, path, sums, partial)
    return RO.partials(spark, sums).groupBy("o_custkey", "period").agg(
        F.sum("n").alias("n_orders"), F.round(F.sum("total"), 4).alias("total_price"), F.round(F.max("most"), 4).alias("max_price"))


@register("c9_unwrap_list_record", """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n_dims,
       round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS vsum
FROM embeddings WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL))
""")
def c9_unwrap_list_record(spark, sf):
    from ..functions.vectors import vsum
    e = read_table(spark, sf, "embeddings")
    wrapped = e.select("vec_id", F.struct(F.transform("embedding", lambda x: F.struct(x.alias("element")))
                                          .alias("list")).alias("emb"))
    un = N.unwrap_list_record(wrapped, "emb", "vec", require_any=True)
    return un.select("vec_id", F.size("vec").cast("bigint").alias("n_dims"), F.round(vsum("vec"), 6).alias("vsum"))


@register("c10_vector_assemble", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(l_quantity + l_extendedprice + l_discount + l_tax, 6) AS feature_sum, 4::BIGINT AS n_features
FROM lineitem
""")
def c10_vector_assemble(spark, sf):
    from ..functions.vectors import vsum
    li = read_table(spark, sf, "lineitem")
    v = N.vector_assemble(li, exclude=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(vsum("features"), 6).alias("feature_sum"),
                    F.size("features").cast("bigint").alias("n_features"))
