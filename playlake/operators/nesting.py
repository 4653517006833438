"""Nest event rows into one row per sequence, and un-nest again.

All group-level decisions (header row, drop rules, item filtering) are made
in ONE aggregate over one shuffle on the group keys.  Sequences are short by
nature of the data (an at-bat has a handful of pitches), so the per-group
array is small; map-side partial aggregation is used for the scalar parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all_not_null(cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def nest_sequences(df: DataFrame, keys, order_cols, item_cols, header_cols=(),
                   required_item_cols=(), single_valued=None, no_null_cols=(),
                   header_required=None, items_name: str = "items",
                   item_casts: dict | None = None, item_renames: dict | None = None,
                   with_reason: bool = False) -> DataFrame:
    """Group rows by ``keys`` into ``items: array<struct>`` sorted by ``order_cols``.

    * header: scalar ``header_cols`` taken from the *last* row in sequence
      order (``max_by`` over the order columns, remaining item columns break
      ties), which is where an at-level outcome is recorded (C2).
    * ``single_valued``: drop groups with more than one distinct non-null
      value of this column (C3), tested as min <> max in the same aggregate.
    * ``no_null_cols``: drop groups with any null in these columns (C4).
    * ``header_required``: drop groups whose header value is null (C4).
    * ``required_item_cols``: items null in any of them are skipped; a group
      left with no item is kept with an empty array (C5).
    * ``item_casts`` / ``item_renames``: typed struct fields (C6).
    * ``with_reason``: keep every group and add ``drop_reason`` (F18)
      instead of filtering.
    """
    keys, order_cols = list(keys), list(order_cols)
    item_casts = item_casts or {}
    item_renames = item_renames or {}
    fields = order_cols + [c for c in item_cols if c not in order_cols]

    def field(c):
        e = F.col(c)
        if c in item_casts:
            e = e.cast(item_casts[c])
        return e.alias(item_renames.get(c, c))

    item = F.struct(*[field(c) for c in fields])
    keep_item = _all_not_null(required_item_cols)
    tie = F.struct(*[F.col(c) for c in fields])
    aggs = [F.array_sort(F.collect_list(F.when(keep_item, item))).alias(items_name)]
    if header_cols:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in header_cols]), tie).alias("_hdr"))
    if single_valued:
        aggs.append((F.min(single_valued) != F.max(single_valued)).alias("_multi"))
    if no_null_cols:
        aggs.append(F.max(~_all_not_null(no_null_cols)).alias("_has_null"))
    out = df.groupBy(*keys).agg(*aggs)
    reason = F.lit(None).cast("string")
    conds = []
    if single_valued:
        conds.append((F.coalesce(F.col("_multi"), F.lit(False)), "multi_valued"))
    if no_null_cols:
        conds.append((F.col("_has_null"), "null_in_group"))
    if header_required:
        conds.append((F.col("_hdr")[header_required].isNull(), "null_header"))
    for cond, name in reversed(conds):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    out = out.withColumn("drop_reason", reason)
    if not with_reason:
        out = out.where(F.col("drop_reason").isNull()).drop("drop_reason")
    cols = keys + ([F.col(f"_hdr.{c}").alias(c) for c in header_cols if c not in keys] if header_cols else [])
    rest = [items_name] + (["drop_reason"] if with_reason else [])
    return out.select(*cols, *rest)


def unnest(df: DataFrame, items: str = "items", outer: bool = False, keep=None) -> DataFrame:
    """One row per array element with the struct fields as columns.

    ``explode`` (not outer) by default: empty sequences vanish, as in
    ``FROM t, UNNEST(items)``.
    """
    keep = [c for c in df.columns if c != items] if keep is None else list(keep)
    gen = F.explode_outer(items) if outer else F.explode(items)
    return df.select(*keep, gen.alias("_it")).select(*keep, "_it.*")


def nest_periods(df: DataFrame, entity: str, period: Column, aggs: list, name: str = "seasonal_stats") -> DataFrame:
    """Two-level rollup: entity x period aggregates, nested per entity.

    First ``groupBy(entity, period)`` with map-side partial aggregation, then
    one row per entity holding ``array<struct<period, ...>>`` sorted by
    period (periods per entity are few: seasons).
    """
    per = df.groupBy(F.col(entity), period.alias("period")).agg(*aggs)
    fields = [c for c in per.columns if c != entity]
    return per.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def unwrap_list_record(df: DataFrame, col: str, out: str | None = None, require_any: bool = False) -> DataFrame:
    """``struct<list: array<struct<element: x>>>`` or a plain array -> array<double>.

    Rows whose vector is null or holds a null element are dropped (the whole
    vector is unusable then).  ``require_any``: an error if none is left.
    """
    out = out or col
    dtype = df.schema[col].dataType.simpleString()
    if dtype.startswith("struct"):
        vec = F.transform(F.col(f"{col}.list"), lambda x: x["element"].cast("double"))
    else:
        vec = F.transform(F.col(col), lambda x: x.cast("double"))
    res = df.withColumn(out, vec)
    ok = F.col(out).isNotNull() & ~F.exists(F.col(out), lambda x: x.isNull() | F.isnan(x))
    res = res.where(ok)
    if require_any and res.isEmpty():
        raise ValueError(f"no usable vector in {col}")
    return res


def vector_assemble(df: DataFrame, exclude, out: str = "features") -> DataFrame:
    """Numeric columns (minus ``exclude``) -> one array<double> column."""
    numeric = [f.name for f in df.schema.fields
               if f.name not in set(exclude) and f.dataType.typeName() in
               ("integer", "long", "double", "float", "short", "byte", "decimal")]
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in numeric]))
