"""Bounded scans: date ranges with mandatory bounds (partition pruning / pushdown)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parse(d) -> dt.date:
    if isinstance(d, dt.date):
        return d
    try:
        return dt.datetime.strptime(str(d), "%Y-%m-%d").date()
    except ValueError as e:
        raise ValueError(f"date {d!r} is not YYYY-MM-DD") from e


def check_range(start, end) -> tuple[dt.date, dt.date]:
    s, e = _parse(start), _parse(end)
    if s > e:
        raise ValueError(f"start {s} is after end {e}")
    return s, e


def _typed(value, dtype):
    # A literal of the column's own type keeps the predicate pushable.
    return F.lit(str(value)).cast(dtype)


def date_range_filter(df: DataFrame, col: str, start, end):
    """Inclusive [start, end] on a date or timestamp column.

    Timestamps use the half-open form ``ts >= start AND ts < end + 1 day``
    with literals of the column's type, so it reaches the scan as
    ``PushedFilters`` (and as partition filters on a partitioned table).
    """
    s, e = check_range(start, end)
    dtype = df.schema[col].dataType
    c = F.col(col)
    if dtype.typeName() == "date":
        return (c >= _typed(s, dtype)) & (c <= _typed(e, dtype))
    return (c >= _typed(dt.datetime.combine(s, dt.time()), dtype)) & \
           (c < _typed(dt.datetime.combine(e + dt.timedelta(days=1), dt.time()), dtype))


def scan_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """Date-bounded scan; both bounds are required arguments."""
    return df.where(date_range_filter(df, col, start, end))


def read_partitioned(spark: SparkSession, path: str, part_col: str, start, end) -> DataFrame:
    """Read a ``part_col``-partitioned table; the bounds prune partitions."""
    s, e = check_range(start, end)
    return spark.read.parquet(path).where(F.col(part_col).between(F.lit(s), F.lit(e)))


def scan_since(df: DataFrame, col: str, since) -> DataFrame:
    s = _parse(since)
    dtype = df.schema[col].dataType
    lit = s if dtype.typeName() == "date" else dt.datetime.combine(s, dt.time())
    return df.where(F.col(col) >= _typed(lit, dtype))
