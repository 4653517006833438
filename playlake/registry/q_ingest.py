"""Queries for incremental ingestion and the feature load (K1-K5).

The analog feed is ``lineitem`` written as raw CSV: an order is the
sequence, line number the order within it, ship date the event date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as EN
from ..plans import ingest as IG
from ..plans.features import build_features
from ..session import read_table, scratch_path
from ..sources import files as S
from ..sources import versions as V
from . import register

LINEITEM_SPEC = IG.IngestSpec(
    date_col="l_shipdate",
    keys=["l_orderkey"],
    order_cols=["l_linenumber"],
    header_cols=["l_returnflag", "l_linestatus"],
    item_cols=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    numeric_cols=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax"],
    id_cols=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    required_rows=["l_orderkey", "l_linenumber", "l_shipdate"],
    required_items=["l_quantity"],
    int_items=["l_linenumber"],
    partition_col="ship_date",
    items_name="lines",
)


@register("k1_plan_months", """
WITH m AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
                                               INTERVAL 1 MONTH)) AS DATE) AS month_start FROM orders),
h AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start, count(*) AS existing FROM lineitem GROUP BY 1)
SELECT month_start, CAST(coalesce(existing, 0) AS BIGINT) AS existing,
       CASE WHEN coalesce(existing, 0) = 0 THEN 'ingest' ELSE 'skip' END AS action
FROM m LEFT JOIN h USING (month_start)
""")
def k1_plan_months(spark, sf):
    months = IG.month_series_from(read_table(spark, sf, "orders"), "o_orderdate")
    return IG.plan_months(months, read_table(spark, sf, "lineitem"), "l_shipdate", on_existing="skip")


# Sequences of a set of feed rows, by month; header values come from the last row of a sequence.
_SEQUENCES = """
g AS (SELECT feed, l_orderkey, arg_max(l_shipdate, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS d
      FROM r GROUP BY ALL),
n AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(count(*) AS BIGINT) AS sequences FROM g GROUP BY 1),
m AS (SELECT CAST(unnest(generate_series(DATE '{s}', DATE '{e}', INTERVAL 1 MONTH)) AS DATE) AS month_start)
"""
_ROWS = "SELECT {feed} AS feed, * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{s}' AND l_shipdate < DATE '{e}' + INTERVAL 1 MONTH"
_FIRST_LOAD = """
SELECT m.month_start, 'ingest' AS action, CAST(0 AS BIGINT) AS existing, coalesce(sequences, 0) AS sequences,
       CASE WHEN sequences > 0 THEN 'loaded' ELSE 'empty' END AS status
FROM m LEFT JOIN n USING (month_start)
"""


def _first_load_sql(s, e):
    return "WITH r AS (" + _ROWS.format(feed=1, s=s, e=e) + ")," + _SEQUENCES.format(s=s, e=e) + _FIRST_LOAD


def _load(spark, feed, table, start, end, on_existing="skip"):
    """Land a feed by month, plan the months against the table, load them; returns the report."""
    landing = scratch_path(spark, "k_landing")
    IG.write_landing(feed, landing, "l_shipdate")
    plan = IG.plan_load(IG.month_series(spark, start, end), spark, table, on_existing)
    # the plan is a calendar list: fixed here, before the table changes
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    raw = IG.read_landing(spark, landing, plan, feed.columns)
    return IG.ingest(spark, raw, table, plan, LINEITEM_SPEC)


@register("k2_ingest_month", _first_load_sql("1996-03-01", "1996-03-01"))
def k2_ingest_month(spark, sf):
    return _load(spark, read_table(spark, sf, "lineitem"), scratch_path(spark, "k_facts"), "03-1996", "03-1996")


@register("k3_ingest_range", _first_load_sql("1996-01-01", "1997-12-01"))
def k3_ingest_range(spark, sf):
    return _load(spark, read_table(spark, sf, "lineitem"), scratch_path(spark, "k_facts"), "01-1996", "12-1997")


def _second_load(spark, sf, on_existing, feed_of=lambda li: li):
    li, table = read_table(spark, sf, "lineitem"), scratch_path(spark, "k_facts")
    _load(spark, li, table, "01-1997", "04-1997")
    return _load(spark, feed_of(li), table, "01-1997", "06-1997", on_existing)


def _second_load_sql(action, first, second, sequences, status, feed="2"):
    """Report of a second load over 01..06-1997 after a first one over 01..04-1997.

    ``feed`` tells rows of the second load apart that are nested apart.
    """
    return f"""
    WITH r AS ({_ROWS.format(feed=1, s='1997-01-01', e='1997-06-01')} AND ({first}) UNION ALL
               {_ROWS.format(feed=feed, s='1997-01-01', e='1997-06-01')} AND ({second})),
    {_SEQUENCES.format(s='1997-01-01', e='1997-06-01')},
    o AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month_start, count(*) FILTER (feed = 1) AS a,
                 count(*) FILTER (feed > 1) AS b FROM g GROUP BY 1)
    SELECT m.month_start, CASE WHEN coalesce(a, 0) > 0 THEN '{action}' ELSE 'ingest' END AS action,
           CAST(coalesce(a, 0) AS BIGINT) AS existing,
           CAST(CASE WHEN coalesce(a, 0) > 0 THEN {sequences} ELSE coalesce(b, 0) END AS BIGINT) AS sequences,
           CASE WHEN coalesce(a, 0) > 0 THEN {status} WHEN coalesce(b, 0) > 0 THEN 'loaded' ELSE 'empty' END AS status
    FROM m LEFT JOIN o USING (month_start)
    """


_BEFORE_MAY = "l_shipdate < TIMESTAMP '1997-05-01'"


@register("k4_duplicate_guard", _second_load_sql("skip", _BEFORE_MAY, f"NOT {_BEFORE_MAY}", "a", "'skipped'"))
def k4_duplicate_guard(spark, sf):
    return _second_load(spark, sf, "skip")


@register("k4_append", _second_load_sql("append", _BEFORE_MAY, "true", "a + b", "'loaded'"))
def k4_append(spark, sf):
    """Months that have rows get the feed's rows as well."""
    return _second_load(spark, sf, "append")


@register("k4_replace", _second_load_sql(
    "replace", _BEFORE_MAY, "day(l_shipdate) > 9 AND NOT (month(l_shipdate) = 2)", "b",
    "CASE WHEN b > 0 THEN 'loaded' ELSE 'empty' END", feed=f"CASE WHEN {_BEFORE_MAY} THEN 2 ELSE 3 END"))
def k4_replace(spark, sf):
    """A later feed without the first nine days of each month, and without February: those days go."""
    return _second_load(spark, sf, "replace", lambda li: li.where((F.dayofmonth("l_shipdate") > 9)
                                                                  & (F.month("l_shipdate") != 2)))


_K5_EVENTS = {"A": "single", "R": "strikeout"}

# header values come from the last line of an order; one row per line; the md5 form of the hash
_K5_FEATURES = """
WITH h AS (SELECT l_orderkey, arg_max(l_returnflag, o) AS event, arg_max(l_shipdate, o) AS d
           FROM (SELECT *, (l_linenumber, l_partkey, l_quantity, l_extendedprice) AS o FROM lineitem) GROUP BY 1),
k AS (SELECT label, count(*) OVER () + count(*) OVER () % 2 AS width,
             ('0x' || substr(md5('l_tax_band=' || label), 1, 8))::BIGINT AS hv
      FROM (SELECT DISTINCT CAST(l_tax > 0.04 AS VARCHAR) AS label FROM lineitem)),
c AS (SELECT l_linestatus, row_number() OVER (ORDER BY l_linestatus) - 1 AS code
      FROM (SELECT DISTINCT l_linestatus FROM lineitem WHERE l_linestatus IS NOT NULL))
"""


@register("k5_load_features", _K5_FEATURES + """
SELECT l.l_orderkey, CAST(strftime(h.d, '%Y%m%d') AS BIGINT) AS l_shipdate_int,
       CAST(CASE event WHEN 'A' THEN 1 WHEN 'R' THEN 5 ELSE 0 END AS BIGINT) AS l_returnflag,
       l.l_linenumber, l_quantity, l_extendedprice, CAST(c.code AS BIGINT) AS l_linestatus,
       CAST(CASE WHEN l_linenumber <> 3 THEN 1 ELSE 0 END AS BIGINT) AS runner,
       CASE WHEN hv % width = 0 THEN CASE WHEN (hv // width) % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS l_tax_band0,
       CASE WHEN hv % width = 1 THEN CASE WHEN (hv // width) % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS l_tax_band1,
       true AS embedding_is_null
FROM lineitem l JOIN h USING (l_orderkey) JOIN c USING (l_linestatus) JOIN k ON k.label = CAST(l.l_tax > 0.04 AS VARCHAR)
""")
def k5_load_features(spark, sf):
    """Nested facts -> encoded, expanded feature rows, truncate-loaded and read back."""
    feats, _ = _k5(spark, sf)
    return feats.withColumn("embedding_is_null", F.col("embedding_vector").isNull()).drop("embedding_vector", "l_shipdate")


@register("k5_key_table", _K5_FEATURES + """
SELECT 'l_tax_band' AS feature, CAST(NULL AS BIGINT) AS code, label,
       array_to_string(list_transform(range(0, width), lambda i: CASE WHEN i = hv % width THEN
         (CASE WHEN (hv // width) % 2 = 0 THEN 1 ELSE -1 END) ELSE 0 END), ',') AS hash FROM k
UNION ALL SELECT 'l_linestatus', CAST(code AS BIGINT), l_linestatus, NULL FROM c
UNION ALL SELECT 'l_returnflag', CAST(i AS BIGINT), g, NULL FROM (SELECT unnest(range(0, 11)) AS i, unnest(
  ['other', 'single', 'double', 'triple', 'homerun', 'strikeout', 'out', 'multi_out', 'walk', 'awarded_first', 'field_play']) AS g)
""")
def k5_key_table(spark, sf):
    _, key = _k5(spark, sf)
    return key.select("feature", "code", "label", F.array_join(EN.dense("hash").cast("array<string>"), ",").alias("hash"))


def _k5(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("runner", F.when(F.col("l_linenumber") != 3, F.col("l_suppkey"))) \
        .withColumn("l_tax_band", (F.col("l_tax") > 0.04).cast("string"))
    facts = IG.nest(li, IG.IngestSpec(
        date_col="l_shipdate", keys=["l_orderkey"], order_cols=["l_linenumber"], header_cols=["l_returnflag"],
        item_cols=["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus", "runner", "l_tax_band"],
        partition_col="l_shipdate", items_name="lines"))
    feats, key = build_features(facts, items="lines", date_col="l_shipdate", nominals=["l_tax_band"],
                                binaries=["l_linestatus"], players=["runner"], events_col="l_returnflag",
                                outcome_map=_K5_EVENTS, remove=["l_partkey"], hash_method="md5")
    path = scratch_path(spark, "k5_features")
    S.write_disposition(feats, path, "WRITE_TRUNCATE")
    S.write_disposition(key, path + "_key", "WRITE_TRUNCATE")
    return V.read(spark, path), V.read(spark, path + "_key")
