"""Join helpers.

A dictionary (distinct categories, per-class tables) is built once, written,
and counted.  A small one is broadcast, so that fact rows stay where they
are; a larger one meets salted fact rows, so that a category that holds a
third of them is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def attach_by_key(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    return left.join(right, on=list(keys), how=how)


def lookup(fact: DataFrame, dim: DataFrame, keys, how: str = "left") -> DataFrame:
    return fact.join(dim, on=list(keys), how=how)


# Most rows of a dictionary that are broadcast, and most bytes of them (as text).
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000
SALTS = 64


def dictionary_join(fact: DataFrame, dictionary: DataFrame, on: str, how: str = "left",
                    limit: int = BROADCAST_ROWS) -> DataFrame:
    """Attach a dictionary with one row per value of ``on`` to fact rows; null values meet nothing."""
    dictionary = written(dictionary, "dictionary")
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = dictionary.limit(limit + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if rows <= limit and size <= BROADCAST_BYTES:
        return fact.join(F.broadcast(dictionary), on, how)
    salted = fact.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    every = dictionary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [on, "_salt"], how).drop("_salt")


def semi_top(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Keep rows whose category appears in ``top`` (a top-n list: n rows)."""
    return df.join(F.broadcast(top.select(key)), on=key, how="left_semi")
