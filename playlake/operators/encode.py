"""Feature encoding (D1-D8): hashing, category codes, flags, outcome groups, key table.

Every dictionary is built from the DISTINCT values of a column (a small
aggregate with map-side combine) and joined back to the fact rows on the
value; codes are numbered by ranges of the dictionary, never over fact rows.
See ``joins.dictionary_join`` for how dictionaries of either size are joined.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import dictionary_join
from .pairs import dense_index
from ..functions.hashing import md5_u32, murmur3_32
from ..session import written
from ..sources import versions as V

# --- fixed values: outcome groups, in code order 0..10 ----------------------
OUTCOME_GROUPS = ["other", "single", "double", "triple", "homerun", "strikeout",
                  "out", "multi_out", "walk", "awarded_first", "field_play"]

# --- fixed values: outcome event name -> group (anything else: "other") ----
OUTCOME_MAP = {
    "single": "single",
    "double": "double",
    "triple": "triple",
    "home_run": "homerun",
    "strikeout": "strikeout",
    "field_out": "out", "fielders_choice_out": "out", "force_out": "out",
    "sac_bunt": "out", "sac_fly": "out",
    "double_play": "multi_out", "grounded_into_double_play": "multi_out",
    "sac_bunt_double_play": "multi_out", "sac_fly_double_play": "multi_out",
    "strikeout_double_play": "multi_out", "triple_play": "multi_out",
    "intent_walk": "walk", "walk": "walk",
    "catcher_interf": "awarded_first", "hit_by_pitch": "awarded_first",
    "field_error": "field_play", "fielders_choice": "field_play",
    "truncated_pa": "other",
}


def _text(col: str, null_label: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(null_label))


# ---------------------------------------------------------------- D3 / D8
def category_dictionary(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values -> code 0..k-1 (k = category count); numbered by ranges, not by one task."""
    return dense_index(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], "code").select(col, "code")


def stable_dictionary(df: DataFrame, col: str, path: str) -> DataFrame:
    """The dictionary kept at ``path``, grown by the values of ``col`` that it lacks: old codes never change.

    New values take the next codes in their order, in one commit of a
    versioned table; values that are gone keep their codes.
    """
    spark = df.sparkSession
    new = df.select(col).where(F.col(col).isNotNull()).distinct()
    first = 0
    if V.manifest(spark, path) is not None:
        known = V.read(spark, path)
        new = new.join(known, col, "left_anti")
        first = sum(r["rows"] for r in V.counts(spark, path).collect())
    new = dense_index(new, [col], "code").select(col, (F.col("code") + first).alias("code"))
    V.commit(spark, path, new)
    return V.read(spark, path)


def category_codes(df: DataFrame, col: str, out: str | None = None, dictionary: DataFrame | None = None):
    """Replace ``col`` by its code (null -> -1). Returns (df, dictionary)."""
    out = out or col
    dictionary = dictionary if dictionary is not None else category_dictionary(df, col)
    coded = dictionary_join(df, dictionary.withColumnRenamed("code", "_code"), col)
    coded = coded.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1).cast("bigint"))).drop("_code")
    return coded, dictionary


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    return category_codes(df, col, out)[0]


# ---------------------------------------------------------------- D4
def presence_flag(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull().cast("bigint")


# ---------------------------------------------------------------- D5
def outcome_recode(df: DataFrame, col: str, out: str = "outcome_code", mapping: dict | None = None,
                   groups=None) -> DataFrame:
    """Name-based recode of outcome events to group codes; null/unknown -> 0.

    The map is a constant of the code, so it is inlined as a CASE-like
    ``map`` literal lookup: no join, no shuffle.
    """
    mapping = OUTCOME_MAP if mapping is None else mapping
    groups = OUTCOME_GROUPS if groups is None else groups
    lut = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(groups.index(v)))])
    return df.withColumn(out, F.coalesce(F.try_element_at(lut, F.col(col)), F.lit(0)).cast("bigint"))


# ---------------------------------------------------------------- D1
def hash_width(k_col: Column, round_even: bool = True) -> Column:
    return F.when((k_col % 2 == 1) & F.lit(round_even), k_col + 1).otherwise(k_col)


@F.pandas_udf(T.LongType())
def _murmur(tokens: pd.Series) -> pd.Series:
    # Runs once per DISTINCT category, never per fact row.
    return tokens.map(lambda t: murmur3_32(t.encode("utf-8"), 0)).astype("int64")


# A hash vector: its width, the one slot that is not 0, and what stands there.
SPARSE = "struct<width: int, slot: int, sign: int>"


def hash_dictionary(df: DataFrame, col: str, null_label: str = "None", round_even: bool = True,
                    method: str = "murmur3") -> DataFrame:
    """Distinct categories of ``col`` -> signed hash vector of width k (or k+1): (label, width, hash).

    ``hash`` is sparse (width, slot, sign), so that the dictionary grows with
    k and not with its square; :func:`dense` and :func:`expand_vector` write
    it out.  Token hashed is ``"<col>=<value>"`` (null spelled
    ``null_label``).  ``method='murmur3'`` is the signed MurmurHash3 (seed 0)
    scheme of common feature hashers; ``method='md5'`` is a SQL-reproducible
    variant used for cross-engine checks.
    """
    d = written(df.select(_text(col, null_label).alias("label")).distinct(), "labels")
    d = d.withColumn("width", hash_width(d.agg(F.count(F.lit(1))).scalar(), round_even).cast("int"))
    token = F.concat(F.lit(f"{col}="), F.col("label"))
    if method == "murmur3":
        h = _murmur(token)
        # the least hash has no absolute value: it goes where the greatest one less the width goes
        slot = F.when(h == -(2 ** 31), 2 ** 31 - F.col("width")).otherwise(F.abs(h)) % F.col("width")
        sign = F.when(h >= 0, 1).otherwise(-1)
    else:
        h = md5_u32(token)
        slot = F.pmod(h, F.col("width"))
        sign = F.when(F.pmod(F.floor(h / F.col("width")), F.lit(2)) == 0, 1).otherwise(-1)
    return d.withColumn("hash", F.struct(F.col("width"), slot.cast("int").alias("slot"), sign.alias("sign")))


def feature_hash(df: DataFrame, col: str, out: str | None = None, dictionary: DataFrame | None = None,
                 null_label: str = "None", round_even: bool = True, method: str = "murmur3"):
    """Replace ``col`` by its sparse hash vector. Returns (df, dictionary)."""
    out = out or col
    dictionary = dictionary if dictionary is not None else hash_dictionary(df, col, null_label, round_even, method)
    keyed = df.withColumn("_label", _text(col, null_label))
    res = dictionary_join(keyed, dictionary.select(F.col("label").alias("_label"), F.col("hash").alias("_hash")), "_label")
    return res.withColumn(out, F.col("_hash")).drop("_label", "_hash"), dictionary


def dense(c) -> Column:
    """A sparse hash vector as array<int>."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.transform(F.sequence(F.lit(0), c["width"] - 1),
                                             lambda i: F.when(i == c["slot"], c["sign"]).otherwise(0)))


# ---------------------------------------------------------------- D2
def expand_vector(df: DataFrame, col: str, width: int) -> DataFrame:
    """Sparse hash vector or array column -> ``col0..col{width-1}`` in the column's place."""
    sparse = dict(df.dtypes)[col].startswith("struct")

    def slot(i: int) -> Column:
        if sparse:
            return F.when(F.col(col).isNotNull(), F.when(F.col(col)["slot"] == i, F.col(col)["sign"]).otherwise(0))
        return F.col(col)[i]

    cols = []
    for c in df.columns:
        if c == col:
            cols += [slot(i).alias(f"{col}{i}") for i in range(width)]
        else:
            cols.append(F.col(c))
    return df.select(*cols)


# ---------------------------------------------------------------- D6
def key_table(*parts: DataFrame) -> DataFrame:
    """Union of dictionaries as (feature, code, label, hash); hashes are sparse."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def code_key(dictionary: DataFrame, feature: str, col: str) -> DataFrame:
    return dictionary.select(F.lit(feature).alias("feature"), F.col("code").cast("bigint"),
                             F.col(col).cast("string").alias("label"),
                             F.lit(None).cast(SPARSE).alias("hash"))


def hash_key(dictionary: DataFrame, feature: str) -> DataFrame:
    return dictionary.select(F.lit(feature).alias("feature"), F.lit(None).cast("bigint").alias("code"),
                             F.col("label"), F.col("hash"))


def outcome_key(spark, mapping: dict | None = None, groups=None, feature: str = "events") -> DataFrame:
    groups = OUTCOME_GROUPS if groups is None else groups
    return spark.createDataFrame([(feature, i, g, None) for i, g in enumerate(groups)],
                                 f"feature string, code bigint, label string, hash {SPARSE}")


# ---------------------------------------------------------------- D7
def apply_columns(df: DataFrame, cols, fn) -> tuple[DataFrame, list[str]]:
    """Apply ``fn(col_name) -> Column`` to each listed column in ONE projection."""
    present = [c for c in cols if c in df.columns]
    missing = [c for c in cols if c not in df.columns]
    return df.withColumns({c: fn(c) for c in present}), missing
