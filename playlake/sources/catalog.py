"""Catalog operations: databases and partitioned, clustered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def create_database(spark: SparkSession, name: str, if_not_exists: bool = False,
                    location: str | None = None) -> None:
    """Create a database; error if it exists (unless ``if_not_exists``)."""
    if spark.catalog.databaseExists(name):
        if if_not_exists:
            return
        raise ValueError(f"database {name} already exists")
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE `{name}`{loc}")


def database_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create_table(spark: SparkSession, name: str, ddl_columns: str, partition_by: str,
                 location: str | None = None, comment: str | None = None) -> None:
    """``CREATE TABLE`` partitioned by a date column; error if it exists."""
    if spark.catalog.tableExists(name):
        raise ValueError(f"table {name} already exists")
    loc = f" LOCATION '{location}'" if location else ""
    cmt = f" COMMENT '{comment}'" if comment else ""
    spark.sql(f"CREATE TABLE {name} ({ddl_columns}) USING parquet PARTITIONED BY ({partition_by}){cmt}{loc}")


def write_clustered(df: DataFrame, name: str, partition_col: str, cluster_cols, mode: str = "append") -> None:
    """Insert with clustering: rows are brought together by partition value and
    range of the cluster keys, and sorted by them, so Parquet row-group
    min/max statistics can skip data on those keys.  A partition value that
    holds much of the data is split by ranges and written by many tasks."""
    (df.repartitionByRange(partition_col, *cluster_cols).sortWithinPartitions(partition_col, *cluster_cols)
     .write.mode(mode).insertInto(name))


def drop_database(spark: SparkSession, name: str) -> None:
    """Drop a database with its tables."""
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
