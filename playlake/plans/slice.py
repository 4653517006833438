"""Flagship job: nest -> filter groups -> un-nest -> code -> cross-tab.

On lineitem as the event table: orders play the at-bat (sequence) role,
line numbers the pitch order, supplier the pitcher.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import category_codes
from ..operators.nesting import nest_sequences, unnest
from ..operators.profile import crosstab_counts

ITEM_COLS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def nested_orders(lineitem: DataFrame) -> DataFrame:
    """C1+C2+C3: one row per order, single-supplier orders only."""
    return nest_sequences(
        lineitem, keys=["l_orderkey"], order_cols=["l_linenumber"], item_cols=ITEM_COLS,
        header_cols=["l_returnflag", "l_shipdate"], single_valued="l_suppkey", items_name="lines")


def returnflag_status_crosstab(lineitem: DataFrame) -> DataFrame:
    # Only the columns used downstream travel in the nested items, so the
    # scan reads five columns.
    nested = nest_sequences(
        lineitem, keys=["l_orderkey"], order_cols=["l_linenumber"], item_cols=["l_returnflag", "l_linestatus"],
        single_valued="l_suppkey", items_name="lines")
    flat = unnest(nested.select("l_orderkey", "lines"), "lines")
    coded, _ = category_codes(flat.select("l_returnflag", "l_linestatus"), "l_returnflag", out="returnflag_code")
    ct = crosstab_counts(coded, "returnflag_code", "l_linestatus", ["F", "O"])
    return ct.select(F.col("returnflag_code"), F.col("F").cast("bigint").alias("n_f"),
                     F.col("O").cast("bigint").alias("n_o"))
