"""Incremental monthly ingestion (K1-K4): raw feed -> clean -> nest -> load.

The per-month process pool of a shell-driven loader becomes ONE Spark job
over all planned months: months are a column and the facts table is
partitioned by date.  The plan (which months to ingest or skip) is itself a
DataFrame computed with an anti-join against the loaded table.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import cleaning as CL
from ..operators import projection as P
from ..operators.nesting import nest_sequences
from ..sources import files as FS
from ..sources import versions as V


# ------------------------------------------------------------------ months
def month_series(spark: SparkSession, start_month: str, end_month: str) -> DataFrame:
    """All months from ``MM-YYYY`` to ``MM-YYYY`` inclusive, as first days."""
    def first_day(mm_yyyy):
        mm, yyyy = mm_yyyy.split("-")
        if not (len(mm) == 2 and len(yyyy) == 4 and 1 <= int(mm) <= 12):
            raise ValueError(f"month {mm_yyyy!r} is not MM-YYYY")
        return f"{yyyy}-{mm}-01"
    s, e = first_day(start_month), first_day(end_month)
    if s > e:
        raise ValueError(f"start month {start_month} is after end month {end_month}")
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(s)), F.to_date(F.lit(e)),
                                                      F.expr("INTERVAL 1 MONTH"))).alias("month_start"))


def month_series_from(df: DataFrame, date_col: str) -> DataFrame:
    """Months spanned by a table's dates (one small aggregate, then a generator)."""
    b = df.agg(F.trunc(F.to_date(F.min(date_col)), "month").alias("s"),
               F.trunc(F.to_date(F.max(date_col)), "month").alias("e"))
    return b.select(F.explode(F.sequence("s", "e", F.expr("INTERVAL 1 MONTH"))).alias("month_start"))


def month_bounds(df: DataFrame, date_col: str) -> DataFrame:
    """Distinct (first day, last day) of the months present (leap years included)."""
    d = F.to_date(date_col)
    return df.select(F.trunc(d, "month").alias("first_day"), F.last_day(d).alias("last_day")).distinct()


# ------------------------------------------------------------------ K1
def plan_months(months: DataFrame, loaded: DataFrame, date_col: str, on_existing: str = "skip") -> DataFrame:
    """Requested months vs months already holding rows -> (month_start, existing, action).

    ``on_existing`` (K4): ``skip`` (default), ``append`` or ``replace``
    decides the action for months that already have rows.
    """
    if on_existing not in ("skip", "append", "replace"):
        raise ValueError("on_existing must be skip, append or replace")
    have = loaded.groupBy(F.trunc(F.to_date(date_col), "month").alias("month_start")) \
                 .agg(F.count(F.lit(1)).alias("existing"))
    return _plan(months, have, on_existing)


def plan_load(months: DataFrame, spark: SparkSession, table_path: str, on_existing: str = "skip") -> DataFrame:
    """:func:`plan_months` against a versioned table, whose rows are counted in its list of parts: no scan."""
    if on_existing not in ("skip", "append", "replace"):
        raise ValueError("on_existing must be skip, append or replace")
    return _plan(months, loaded_months(spark, table_path).withColumnRenamed("rows", "existing"), on_existing)


def _plan(months: DataFrame, have: DataFrame, on_existing: str) -> DataFrame:
    plan = months.join(have, "month_start", "left").withColumn("existing", F.coalesce("existing", F.lit(0)).cast("bigint"))
    return plan.withColumn("action", F.when(F.col("existing") == 0, F.lit("ingest"))
                           .otherwise(F.lit(on_existing if on_existing != "skip" else "skip")))


# ------------------------------------------------------------------ spec
@dataclass
class IngestSpec:
    """Column roles of an event feed (production values in ``PITCH_SPEC``)."""
    date_col: str
    keys: list
    order_cols: list
    header_cols: list
    item_cols: list
    text_cols: list = field(default_factory=list)
    numeric_cols: list = field(default_factory=list)
    id_cols: list = field(default_factory=list)
    required_rows: list = field(default_factory=list)
    required_items: list = field(default_factory=list)
    single_valued: str | None = None
    no_null_cols: list = field(default_factory=list)
    header_required: str | None = None
    keep: list | None = None
    renames: dict = field(default_factory=dict)
    item_renames: dict = field(default_factory=dict)
    int_items: list = field(default_factory=list)
    final_order: list | None = None
    partition_col: str = "game_date"
    items_name: str = "pitches"


PITCH_SPEC = IngestSpec(
    date_col="game_date",
    keys=["game_id", "at_bat_number"],
    order_cols=["pitch_number"],
    header_cols=[c for c in S.ATBAT_COLUMNS if c not in ("game_id", "at_bat_number")],
    item_cols=S.PITCH_COLUMNS,
    text_cols=S.TEXT_COLUMNS,
    numeric_cols=S.NUMERIC_COLUMNS,
    id_cols=["game_id", "at_bat_number", "inning", "batter", "pitcher"],
    required_rows=S.REQUIRED_COLUMNS,
    required_items=S.REQUIRED_PITCH_FIELDS,
    single_valued="pitcher",
    no_null_cols=["pitcher", "batter"],
    header_required="events",
    keep=S.KEEP_COLUMNS,
    renames=S.CLEAN_RENAMES,
    item_renames=S.NEST_RENAMES,
    int_items=S.PITCH_INT_FIELDS,
    final_order=S.FINAL_ORDER,
)


# ------------------------------------------------------------------ clean
def clean(raw: DataFrame, spec: IngestSpec = PITCH_SPEC):
    """B1-B8 in one projection chain: keep, rename, null spellings, trim,
    numeric coercion, required-row drop, fixed order.  Returns (df, observation)."""
    df, _missing = P.select_existing(raw, spec.keep) if spec.keep else (raw, [])
    df = P.rename(df, spec.renames)
    typed = {}
    for c in df.columns:
        if c in spec.numeric_cols:
            typed[c] = CL.to_bigint(CL.null_tokens(c)) if c in spec.id_cols else CL.to_double(CL.null_tokens(c))
        elif c == spec.date_col:
            typed[c] = F.try_to_date(CL.null_tokens(c))
        else:
            typed[c] = CL.null_tokens(c)
    df = df.withColumns(typed)
    df, obs = P.drop_missing_required(df, spec.required_rows, name="clean_rows")
    if spec.final_order:
        df = P.order_columns(df, spec.final_order)
    return df, obs


def nest(clean_df: DataFrame, spec: IngestSpec = PITCH_SPEC, with_reason: bool = False) -> DataFrame:
    """C1-C6 as one aggregate over one shuffle on the sequence keys."""
    present = set(clean_df.columns)
    casts = {c: "bigint" for c in spec.int_items if c in present}
    return nest_sequences(
        clean_df, spec.keys, spec.order_cols,
        [c for c in spec.item_cols if c in present],
        header_cols=[c for c in spec.header_cols if c in present] + [spec.date_col] * (spec.date_col not in spec.header_cols),
        required_item_cols=[c for c in spec.required_items if c in present],
        single_valued=spec.single_valued if spec.single_valued in present else None,
        no_null_cols=[c for c in spec.no_null_cols if c in present],
        header_required=spec.header_required if spec.header_required in present else None,
        items_name=spec.items_name, item_casts=casts, item_renames=spec.item_renames,
        with_reason=with_reason)


# ------------------------------------------------------------------ K2/K3
ACTIONS = ("ingest", "append", "replace", "skip")
# Column that tells rows of replaced months while they are nested.
ANEW = "_month_anew"


def planned(plan: DataFrame) -> dict:
    """Months of each action, ``{action: [first days]}`` (a calendar list); an unknown action is an error."""
    by: dict = {a: [] for a in ACTIONS}
    for r in plan.select("month_start", "action").collect():
        if r["action"] not in by:
            raise ValueError(f"unknown action {r['action']!r} for {r['month_start']}")
        by[r["action"]].append(r["month_start"])
    return by


def _in_months(col: str, months: list):
    """A condition on a date column that prunes partitions: one range per month."""
    cond = F.lit(False)
    for m in sorted(months):
        after = (m.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        cond = cond | ((F.col(col) >= F.lit(m)) & (F.col(col) < F.lit(after)))
    return cond


def month_part(col: str) -> Column:
    """The part of a versioned facts table that a row belongs to: the first day of its month."""
    return F.date_format(F.trunc(F.to_date(col), "month"), "yyyy-MM-dd")


def ingest(spark: SparkSession, raw: DataFrame, table_path: str, plan: DataFrame,
           spec: IngestSpec = PITCH_SPEC) -> DataFrame:
    """Clean + nest the raw rows of the planned months and load them into a versioned table.

    The feed is parsed and nested once and becomes visible in one commit
    (``sources/versions.py``).  ``ingest`` and ``append`` months are appended
    to what the table holds; a ``replace`` month is replaced as a whole: days
    that the feed no longer has go too, and all of it if the feed has none.
    ``skip`` months are not read.  A feed without rows makes an empty table,
    or leaves the table as it is.  Rows of one day are dealt to as many tasks
    as their size asks for.  Returns the report of :func:`ingest_report`.
    """
    by = planned(plan)
    col = spec.partition_col
    months = by["ingest"] + by["append"] + by["replace"]
    cleaned, _ = clean(raw, spec)
    # rows of months that are added and of months that are replaced are nested apart
    cleaned = cleaned.where(_in_months(spec.date_col, months)).withColumn(ANEW, _in_months(spec.date_col, by["replace"]))
    facts = nest(cleaned, replace(spec, keys=[*spec.keys, ANEW])).drop(ANEW)
    facts = facts.withColumn(col, F.col(spec.date_col)) if col != spec.date_col else facts
    V.commit(spark, table_path, facts.hint("rebalance", col), month_part(col), [col],
             actions={str(m): "replace" for m in by["replace"]})
    return ingest_report(spark, table_path, plan)


def loaded_months(spark: SparkSession, table_path: str) -> DataFrame:
    """(month_start, rows) of a versioned facts table, from its list of parts: nothing is scanned."""
    return V.counts(spark, table_path).select(F.to_date("part").alias("month_start"), "rows")


def ingest_report(spark: SparkSession, table_path: str, plan: DataFrame) -> DataFrame:
    """month_start, action, existing (rows before), sequences (rows now) and status of each planned month.

    ``loaded``; ``skipped``; ``empty`` if the month was to be loaded and the
    feed had nothing of it, which is a success.  A load that fails raises.
    Counts come from the table's list of parts.
    """
    now = loaded_months(spark, table_path).withColumnRenamed("rows", "sequences")
    out = plan.join(now, "month_start", "left").withColumn("sequences", F.coalesce("sequences", F.lit(0)).cast("bigint"))
    gained = F.when(F.col("action") == "append", F.col("sequences") > F.col("existing")).otherwise(F.col("sequences") > 0)
    status = F.when(F.col("action") == "skip", "skipped").when(gained, "loaded").otherwise("empty")
    return out.select("month_start", "action", "existing", "sequences", status.alias("status"))


# ------------------------------------------------------------------ landing
def write_landing(df: DataFrame, path: str, date_col: str) -> None:
    """Raw CSV files of a feed, one folder per month (``landing_month=YYYY-MM-01``)."""
    month = F.trunc(F.to_date(date_col), "month")
    (df.withColumn("landing_month", month).write.partitionBy("landing_month").option("header", True)
     .option("quote", '"').option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def read_landing(spark: SparkSession, path: str, plan: DataFrame, columns: list) -> DataFrame:
    """The raw rows of the months that ``plan`` loads; other folders are not opened."""
    by = planned(plan)
    months = by["ingest"] + by["append"] + by["replace"]
    folders = [f for f in (f"{path}/landing_month={m}" for m in sorted(months)) if FS.table_path_exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], S.raw_string_schema(columns))
    return FS.read_raw_csv(spark, folders, columns)
