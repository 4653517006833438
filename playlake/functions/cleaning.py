"""Scalar cleaning expressions: null spellings, trimming, numeric coercion, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: text spellings read as missing (pandas' default na_values
# plus the empty string); cleaned text goes through a CSV read again, so all
# of them count as null ----------------------------------------------------
NULL_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null", "",
]

# ASCII whitespace characters stripped from both ends of text.
_WS = " \t\n\x0b\f\r"


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace (tabs and newlines included).

    ``btrim`` with a character set: a codegen'd scan from both ends, no regex.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(_WS))


def null_tokens(c, tokens=NULL_TOKENS) -> Column:
    """Trim first, then map any null spelling to null."""
    s = strip_ws(c)
    return F.when(s.isin(list(tokens)), F.lit(None).cast("string")).otherwise(s)


def to_double(c) -> Column:
    """String -> double; unparseable -> null; NaN -> null (pandas semantics)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def to_bigint(c) -> Column:
    """Ids arrive as '3' or '3.0': go through double, then truncate to bigint."""
    return to_double(c).try_cast("bigint")


def date_to_int(c) -> Column:
    """Date/timestamp -> yyyymmdd integer."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(F.to_date(c), "yyyyMMdd").cast("bigint")


def date_string_to_int(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit("-"), F.lit("")).try_cast("bigint")


def valid_iso_date(c) -> Column:
    """Strict YYYY-MM-DD check returning the date or null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def strip_paren_numbers(c) -> Column:
    """Remove every '(<digits>)' from a text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, "\\([0-9]+\\)", "")


def category_label(c, prefix: str = "Event_") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), c.cast("int").cast("string"))
