"""Projection, predicates and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.hashing import md5_u60


def select_existing(df: DataFrame, columns) -> tuple[DataFrame, list[str]]:
    """Keep the listed columns that exist (in list order); report the missing."""
    present = set(df.columns)
    keep = [c for c in columns if c in present]
    missing = [c for c in columns if c not in present]
    return df.select(*keep), missing


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_missing_required(df: DataFrame, required, name: str = "drop_missing_required"):
    """Drop rows null in any required column present.

    Returns (clean_df, observation); the observation is filled with
    ``rows_in`` / ``rows_out`` by the first action on ``clean_df``, so the
    counts cost no extra job.
    """
    subset = [c for c in required if c in df.columns]
    obs = Observation(name)
    counted = df.observe(obs, F.count(F.lit(1)).alias("rows_in"),
                         F.sum(F.when(F.greatest(*[F.col(c).isNull() for c in subset]) if len(subset) > 1
                                      else F.col(subset[0]).isNull(), 1).otherwise(0)).alias("rows_dropped"))
    return counted.dropna(how="any", subset=subset), obs


def dropna_any(df: DataFrame, subset=None) -> DataFrame:
    return df.dropna(how="any", subset=subset)


def order_columns(df: DataFrame, order) -> DataFrame:
    present = set(df.columns)
    return df.select(*[c for c in order if c in present])


def drop_existing(df: DataFrame, columns, strict: bool = False) -> DataFrame:
    if strict:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*columns)


def not_null_filter(df: DataFrame, *cols) -> DataFrame:
    cond = None
    for c in cols:
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    return df.where(cond)


def bernoulli_sample(df: DataFrame, key: str, fraction: float, seed: int = 42,
                     reproducible: bool = True) -> DataFrame:
    """Keep each row with probability ``fraction``.

    The reproducible form decides per row from md5(key:seed), so the same
    rows come out whatever the partitioning or engine; ``reproducible=False``
    uses Spark's sampler.
    """
    if not reproducible:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    return df.where(md5_u60(key, F.lit(seed)) < F.lit(int(round(fraction * 2 ** 60))))


def limit_ordered(df: DataFrame, n: int, *order) -> DataFrame:
    """Deterministic LIMIT: top-n by the given order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def isin_filter(df: DataFrame, col: str, values, exclude: bool = False, keep_nulls: bool = True) -> DataFrame:
    """Keep (or exclude) a value list.

    ``keep_nulls`` gives the pandas ``~isin`` behaviour on exclusion (nulls
    stay), where SQL ``NOT IN`` would drop them.
    """
    c = F.col(col)
    if not exclude:
        return df.where(c.isin(list(values)))
    cond = ~c.isin(list(values))
    if keep_nulls:
        cond = c.isNull() | cond
    return df.where(cond)


def contains_filter(df: DataFrame, col: str, needle: str) -> DataFrame:
    return df.where(F.col(col).contains(needle))
