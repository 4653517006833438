"""Queries for sources, sinks and catalog operations.

Round-trip queries write the given table to a fresh folder under the
session's checkpoint location, read it back through the operator and return
the typed rows, so the oracle is the source table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.nesting import nest_sequences
from ..session import read_table, scratch_path, written
from ..sources import catalog as C
from ..sources import files as S
from ..sources import scans as R
from ..sources import versions as V
from . import register

_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("a1_read_raw_csv", "SELECT * FROM lineitem")
def a1_read_raw_csv(spark, sf):
    li = read_table(spark, sf, "lineitem")
    path = scratch_path(spark, "a1_csv")
    S.write_csv(li, path)
    raw = S.read_raw_csv(spark, path, columns=_LI_COLS)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in li.schema.fields])


@register("a2_read_date_range", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'
""")
def a2_read_date_range(spark, sf):
    return R.scan_range(read_table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-20")


_EVENT_ORDER = ["event_id", "user_id", "ts", "event_type", "value"]


@register("a3_write_clean", "SELECT event_id, user_id, ts, event_type, value FROM events")
def a3_write_clean(spark, sf):
    path = scratch_path(spark, "a3_clean")
    S.write_clean(read_table(spark, sf, "events"), path, order=_EVENT_ORDER)
    return spark.read.parquet(path)


_CONV_SQL = """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       string_agg(role, ',' ORDER BY turn) AS roles,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM conversations GROUP BY conv_id
"""


def _nested_conversations(spark, sf):
    conv = read_table(spark, sf, "conversations")
    return nest_sequences(conv, ["conv_id"], ["turn"], ["role", "text"], items_name="turns")


def _conv_summary(df):
    return df.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                     F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"),
                     F.aggregate(F.transform("turns", lambda t: F.length(t["text"]).cast("bigint")),
                                 F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_chars"))


_TURNS_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turns", T.ArrayType(T.StructType([
        T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType())]))),
])


@register("a4_write_nested_jsonl", _CONV_SQL)
def a4_write_nested_jsonl(spark, sf):
    path = scratch_path(spark, "a4_jsonl")
    S.write_nested_jsonl(_nested_conversations(spark, sf), path)
    return _conv_summary(S.read_jsonl(spark, path, _TURNS_SCHEMA))


@register("a5_load_json_append", _CONV_SQL)
def a5_load_json_append(spark, sf):
    jpath, tpath = scratch_path(spark, "a5_jsonl"), scratch_path(spark, "a5_table")
    S.write_nested_jsonl(_nested_conversations(spark, sf), jpath)
    spark.createDataFrame([], _TURNS_SCHEMA).write.mode("errorifexists").parquet(tpath)
    return _conv_summary(S.load_json_append(spark, jpath, tpath, _TURNS_SCHEMA))


@register("a6_load_csv_append", "SELECT conv_id, turn, role, text FROM conversations")
def a6_load_csv_append(spark, sf):
    conv = read_table(spark, sf, "conversations")
    cpath, tpath = scratch_path(spark, "a6_csv"), scratch_path(spark, "a6_table")
    S.write_csv(conv, cpath)
    spark.createDataFrame([], conv.schema).write.mode("errorifexists").parquet(tpath)
    return S.load_csv_append(spark, cpath, tpath, conv.columns,
                             cast={"conv_id": "bigint", "turn": "bigint"}, multi_line=True)


@register("a7_create_table", """
SELECT strftime(o_orderdate, '%Y-%m') AS order_month, CAST(count(*) AS BIGINT) AS n,
       CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_customers
FROM orders GROUP BY 1
""")
def a7_create_table(spark, sf):
    import uuid
    db = f"playlake_{uuid.uuid4().hex[:8]}"
    C.create_database(spark, db, location=scratch_path(spark, "a7_db"))
    assert C.database_exists(spark, db)
    name = f"{db}.orders_by_month"
    C.create_table(spark, name, "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, order_month STRING",
                   partition_by="order_month", location=scratch_path(spark, "a7_table"),
                   comment="orders partitioned by month, clustered by customer")
    assert C.table_exists(spark, name)
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("order_month"))
    C.write_clustered(o, name, "order_month", ["o_custkey", "o_orderkey"])
    out = written(spark.table(name).groupBy("order_month").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers")), "a7_result")
    C.drop_database(spark, db)
    return out


@register("a10_scan_range", """
SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1998-07-01'
""")
def a10_scan_range(spark, sf):
    """From a table partitioned by month: only the folders inside the bounds are opened."""
    li = read_table(spark, sf, "lineitem")
    path = scratch_path(spark, "a10_table")
    (li.withColumn("ship_month", F.trunc(F.to_date("l_shipdate"), "month")).hint("rebalance", "ship_month")
     .write.partitionBy("ship_month").parquet(path))
    months = R.read_partitioned(spark, path, "ship_month", "1997-03-01", "1998-06-01")
    return R.scan_range(months, "l_shipdate", "1997-03-01", "1998-06-30").select(*li.columns)


@register("a11_scan_since", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def a11_scan_since(spark, sf):
    return R.scan_since(read_table(spark, sf, "orders"), "o_orderdate", "2000-01-01")


@register("a12_write_disposition", """
SELECT 'partitions' AS step, CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 2
UNION ALL
SELECT 'append', CAST(year(o_orderdate) AS INTEGER), CAST(count(*) * CASE WHEN year(o_orderdate) = 1996 THEN 2 ELSE 1 END AS BIGINT)
FROM orders GROUP BY year(o_orderdate)
UNION ALL
SELECT 'truncate', 1996, CAST(count(*) AS BIGINT) FROM orders WHERE year(o_orderdate) = 1996
""")
def a12_write_disposition(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    one_year = o.where(F.col("order_year") == 1996)
    steps = []
    for step in ("append", "partitions", "truncate"):
        path = scratch_path(spark, f"a12_{step}")
        S.write_disposition(o, path, "WRITE_EMPTY", partition_by=["order_year"])
        S.write_disposition(one_year, path, "WRITE_APPEND", partition_by=["order_year"])  # 1996 twice
        if step == "partitions":
            S.write_disposition(one_year, path, "WRITE_TRUNCATE_PARTITIONS", partition_by=["order_year"])  # 1996 anew
        elif step == "truncate":
            S.write_disposition(one_year, path, "WRITE_TRUNCATE", partition_by=["order_year"])  # 1996 alone is left
        steps.append(V.read(spark, path).groupBy("order_year").agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit(step).alias("step"), "order_year", "n"))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


@register("a14_write_once_cache", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1
""")
def a14_write_once_cache(spark, sf):
    path = scratch_path(spark, "a14_cache")
    ev = read_table(spark, sf, "events")

    def build():
        return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))

    S.write_once_cache(spark, path, build)
    return S.write_once_cache(spark, path, lambda: (_ for _ in ()).throw(AssertionError("rebuilt")))


@register("a8_create_database", """
SELECT CAST(count(*) AS BIGINT) AS n, true AS database_exists, true AS second_create_failed FROM orders
""")
def a8_create_database(spark, sf):
    import uuid
    db = f"playlake_{uuid.uuid4().hex[:8]}"
    C.create_database(spark, db, location=scratch_path(spark, "a8_db"))
    try:
        C.create_database(spark, db)
        failed = False
    except ValueError:
        failed = True
    read_table(spark, sf, "orders").write.option("path", scratch_path(spark, "a8_t")).saveAsTable(f"{db}.orders_copy")
    out = written(spark.table(f"{db}.orders_copy").agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(C.database_exists(spark, db)).alias("database_exists"), F.lit(failed).alias("second_create_failed")),
        "a8_result")
    C.drop_database(spark, db)
    return out


@register("a9_table_exists", """
SELECT 'orders_copy' AS table_name, true AS table_exists, CAST(count(*) AS BIGINT) AS n FROM orders
UNION ALL SELECT 'never_created', false, CAST(0 AS BIGINT)
""")
def a9_table_exists(spark, sf):
    import uuid
    db = f"playlake_{uuid.uuid4().hex[:8]}"
    C.create_database(spark, db, location=scratch_path(spark, "a9_db"))
    read_table(spark, sf, "orders").write.option("path", scratch_path(spark, "a9_t")).saveAsTable(f"{db}.orders_copy")
    have = spark.table(f"{db}.orders_copy").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("orders_copy").alias("table_name"), F.lit(C.table_exists(spark, f"{db}.orders_copy")).alias("table_exists"), "n")
    missing = spark.createDataFrame([("never_created", C.table_exists(spark, f"{db}.never_created"), 0)],
                                    "table_name string, table_exists boolean, n bigint")
    out = written(have.unionByName(missing), "a9_result")
    C.drop_database(spark, db)
    return out
