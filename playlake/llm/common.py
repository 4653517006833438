"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.session import read_table, scratch_path  # noqa: F401  (re-exported)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are runs of anything but ASCII white space: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """128 bits that name a row by its id and text: rows that repeat both share a key."""
    return [F.xxhash64(id_col, text).alias("k1"), F.xxhash64(text, F.lit("row"), id_col).alias("k2")]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage by files that every executor can reach, so a lost
    executor costs a re-read and not a re-run.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


# The shuffle files of a finished write are of no more use: its result is a table that all executors reach.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared scratch space."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession):
    """``write(df, name, *by)`` for tables, in folders by the columns ``by``, that are needed inside the block only.

    Like :func:`saved`, but the shuffle files of each write go when it has
    ended and the tables when the block ends, so that a chain of steps takes
    the disk of its largest and not of all.  Nothing lazy that reads such a
    table may leave the block.  With ``buckets`` the table lies in so many
    buckets of the columns ``by`` instead: grouped by them, it isn't moved
    again.
    """
    folder = scratch_path(spark, "scratch")

    def write(df: DataFrame, name: str, *by: str, buckets: int = 0) -> DataFrame:
        tag = uuid.uuid4().hex[:12]
        path = f"{folder}/{name}-{tag}"
        with settings(spark, DROP_SHUFFLES):
            if buckets:
                # the name in the catalog goes again at once; the files stay
                table = f"playlake_{tag}"
                df.write.bucketBy(buckets, *by).option("path", path).saveAsTable(table)
                out = spark.table(table)
                spark.sql(f"DROP TABLE {table}")
                return out
            (df.write.partitionBy(*by) if by else df.write).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield write
    finally:
        remove(spark, folder)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """At most ``rows`` rows in one Arrow batch, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def evaluated(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` renamed to ``name`` and computed once a row.

    Spark copies an expression into each place that uses it, also into a
    lambda, where it would run again for each element; an expression is not
    moved past a generator.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(F.col(column))).alias(name))


# Most row keys (16 bytes each) that are broadcast to pick rows; more are joined by shuffle.
BROADCAST_KEYS = 500_000


# Most rows of a table of numbers that is sent to the tasks instead of moving the rows that it is joined with.
FEW_ROWS = 200_000


def sent_if_few(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The broadcast hint if ``df``, a written table, has at most ``FEW_ROWS`` rows, else nothing: for it and for what has no more rows."""
    return F.broadcast if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else lambda x: x


def pick_rows(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` with (``left_semi``) or without (``left_anti``) one of ``keys``, by k1 and k2.

    Few keys, by a count of them, go to the rows, and no text is moved.
    """
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys, ["k1", "k2"], how)


def non_empty(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    """``run`` without the frames that have no rows: Arrow cannot always tell their types."""
    @wraps(run)
    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in run(batches):
            if len(pdf):
                yield pdf
    return only


def filter_rows(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with or without the rows that ``keys`` (k1, k2) name; see :func:`pick_rows`."""
    a, b = free_name(docs, "row_k1"), free_name(docs, "row_k2")
    k1, k2 = row_keys(docs[id_col], docs[text_col])
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    named = keys.select(F.col("k1").alias(a), F.col("k2").alias(b))
    rows = docs.select("*", k1.alias(a), k2.alias(b))
    return rows.join(F.broadcast(named) if small else named, [a, b], how).select(*docs.columns)
