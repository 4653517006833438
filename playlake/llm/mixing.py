"""Mix sources to target weights: rates per source, whole copies plus a hashed coin per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, saved

# Hex digits of the md5 that make the coin: 52 bits, exact in a double.
COIN_DIGITS = 13


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by seed, id and text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"),
                   F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, COIN_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** COIN_DIGITS))


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_rate: float) -> DataFrame:
    """One row per source of ``sizes`` (source, source_size): its target and rate.

    Sources take ``weights`` in turn, in code-point order (null last).
    Together they are to hold ``share`` times all words; no source exceeds
    ``max_rate`` times its own, and what it may not take is dealt again by
    weight among the others.  The fixed point has a closed form: order the
    sources by cap / weight; a prefix of them is full, and the rest share
    what is left by weight.  The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
         .withColumn("fill", F.col("cap") / F.col("w")))
    everyone = Window.partitionBy()
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everyone) * F.lit(float(share))
    # what one unit of weight gets if all sources before this one are full
    level = ((total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", level).withColumn("full", F.col("fill") <= F.col("level"))
    # past the first source that is not full the levels fall
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(everyone)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * open_level)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "source_size", target.alias("target"), rate.alias("rate"))


# Most sources, and bytes of their names, whose targets are sent to the documents.
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 16_000_000


def _known(targets: DataFrame, source: str) -> DataFrame:
    """``targets`` written and counted: if they are few, documents stay where they are, also those of a hot source."""
    t = saved(targets, "targets")
    rows, size = t.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(source)), F.lit(0))).first()
    return F.broadcast(t) if rows <= BROADCAST_SOURCES and size <= BROADCAST_BYTES else t


def mix_plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_rate: float = 2.0, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns one row per row of ``docs``: doc_id, source, size (words),
    source_size, target (of its source), copies, taken (size * copies).
    ``copies`` is floor(rate) plus one more if a coin in [0, 1), hashed from
    seed, id and text, is below the fraction of the rate; so never above
    ``ceil(max_rate)``.  Rows that repeat id and text share their coin.

    Null text: size 0, like an empty one.  Null source: a source of its own,
    ordered last.  Null id: the coin comes from the text.  A source without
    words has target and rate 0.  Empty table: no rows.  Further columns of
    ``docs`` are not used.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                    word_count(F.col(text_col)).alias("size"),
                    coin(F.col(id_col), F.col(text_col), seed).alias("coin"))
    # the count alone: pre-aggregated per task, then one row per source
    sizes = (docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
             .groupBy("source").agg(F.sum("size").alias("source_size")))
    t = _known(source_targets(sizes, list(weights), share, max_rate).withColumnRenamed("source", "s"), "s")
    whole = F.floor("rate")
    copies = whole + (F.col("coin") < F.col("rate") - whole).cast("long")
    return (d.join(t, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (F.col("size") * copies).alias("taken")))


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_rate: float = 2.0, seed: int = 42,
                  id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every column of ``docs`` plus ``copy`` (from 1), a row for each copy taken.

    A document that the mix takes no copy of is absent.  Documents without
    words follow the rate of their source.  If ``docs`` has a column ``copy``
    the new one is ``_copy``.  Other cases as in :func:`mix_plan`.
    """
    copy, src, rate = (free_name(docs, c) for c in ("copy", "mix_source", "mix_rate"))
    sizes = (docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
             .groupBy("source").agg(F.sum("size").alias("source_size")))
    t = _known(source_targets(sizes, list(weights), share, max_rate)
               .select(F.col("source").alias(src), F.col("rate").alias(rate)), src)
    whole = F.floor(rate)
    copies = whole + (coin(docs[id_col], docs[text_col], seed) < F.col(rate) - whole).cast("long")
    taken = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))
    return (docs.join(t, docs[source_col].eqNullSafe(F.col(src)))
            .select(*[docs[c] for c in docs.columns], F.explode(taken).alias(copy)))
