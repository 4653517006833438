"""File sources and sinks: raw CSV, clean output, nested JSON lines, caches."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import versions as V
from ..schemas import raw_string_schema

DISPOSITIONS = ("WRITE_TRUNCATE", "WRITE_TRUNCATE_PARTITIONS", "WRITE_APPEND", "WRITE_EMPTY")


def _csv_reader(spark: SparkSession, columns=None, mode: str = "PERMISSIVE", multi_line: bool = False):
    r = (spark.read.option("header", True).option("multiLine", multi_line)
         .option("quote", '"').option("escape", '"').option("mode", mode))
    if columns is not None:
        r = r.schema(raw_string_schema(columns))
    return r


def read_raw_csv(spark: SparkSession, path, columns=None, multi_line: bool = False) -> DataFrame:
    """Raw feed CSV (one path or a list), every column as string (typing happens in cleaning).

    Without ``columns`` the header decides the names and all are strings
    (no schema inference pass over the data).  ``multi_line`` is for feeds
    with quoted newlines: each file is then read by one task.
    """
    return _csv_reader(spark, columns, multi_line=multi_line).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def write_clean(df: DataFrame, path: str, order=None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write cleaned rows in a fixed column order (no index column)."""
    if order is not None:
        df = df.select(*[c for c in order if c in df.columns])
    if fmt == "csv":
        write_csv(df, path, mode)
    else:
        df.write.mode(mode).parquet(path)


def write_nested_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; null fields written as ``null``."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Strict JSON-lines read against a known schema (malformed -> error)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def table_path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def load_json_append(spark: SparkSession, json_path: str, table_path: str, schema) -> DataFrame:
    """Append JSON lines to an existing table; fail if the table is missing."""
    if not table_path_exists(spark, table_path):
        raise FileNotFoundError(f"table {table_path} does not exist")
    df = read_jsonl(spark, json_path, schema)
    df.write.mode("append").parquet(table_path)
    return spark.read.parquet(table_path)


def load_csv_append(spark: SparkSession, csv_path: str, table_path: str, columns, cast=None,
                    multi_line: bool = False, observation: Observation | None = None) -> DataFrame:
    """Append a CSV (header skipped, short rows padded with nulls).

    Cells that do not fit their type become null; ``observation`` gets their
    number as ``rejected_cells`` when the append has run.
    """
    if not table_path_exists(spark, table_path):
        raise FileNotFoundError(f"table {table_path} does not exist")
    df = _csv_reader(spark, columns, multi_line=multi_line).csv(csv_path)
    if cast:
        bad = sum((F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).cast("bigint") for c, t in cast.items())
        if observation is not None:
            df = df.observe(observation, F.coalesce(F.sum(bad), F.lit(0)).alias("rejected_cells"))
        df = df.select(*[F.col(c).try_cast(cast.get(c, "string")).alias(c) for c in columns])
    df.write.mode("append").parquet(table_path)
    return spark.read.parquet(table_path)


def write_disposition(df: DataFrame, path: str, disposition: str = "WRITE_TRUNCATE", partition_by=None) -> None:
    """WRITE_TRUNCATE / WRITE_APPEND / WRITE_EMPTY / WRITE_TRUNCATE_PARTITIONS into a versioned table.

    WRITE_TRUNCATE replaces the whole table, also partitions that ``df``
    lacks; WRITE_TRUNCATE_PARTITIONS only those that it has; WRITE_EMPTY
    is an error if the table holds rows.  Readers (``versions.read``) see
    the table before or after, and a job that stops leaves it as it was.
    """
    if disposition not in DISPOSITIONS:
        raise ValueError(f"unknown disposition {disposition!r}")
    spark = df.sparkSession
    if disposition == "WRITE_EMPTY":
        now = V.manifest(spark, path)
        if now is not None and now["parts"]:
            raise ValueError(f"table {path} is not empty")
    keys = list(partition_by or [])
    part = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in keys]) if keys else None
    V.commit(spark, path, df, part, keys, truncate=disposition == "WRITE_TRUNCATE",
             default="replace" if disposition == "WRITE_TRUNCATE_PARTITIONS" else "append")


def write_once_cache(spark: SparkSession, path: str, build, fingerprint: str = "") -> DataFrame:
    """Build and write if absent, else load (``build`` is only called when needed).

    A build that fails leaves nothing that counts as built.  A cache of
    another ``fingerprint`` (see :func:`fingerprint`) is built anew.
    """
    now = V.manifest(spark, path)
    if now is None or now["tags"].get("built from", {}).get("mark") != fingerprint:
        V.commit(spark, path, build(), truncate=True, tag=("built from", fingerprint))
    return V.read(spark, path)


def fingerprint(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that ``df`` reads: it changes when they are rewritten."""
    spark = df.sparkSession
    found = []
    for f in sorted(df.inputFiles()):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        found.append(f"{f} {s.getLen()} {s.getModificationTime()}")
    return hashlib.md5("\n".join(found).encode()).hexdigest()


def save_clusters(df: DataFrame, path: str, columns) -> None:
    """Keep the result columns that exist and write one keyed table."""
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").parquet(path)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"cluster results not found at {path}: run the clustering job first") from e
