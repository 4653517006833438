"""Quality by perplexity under an interpolated modified Kneser-Ney word model of trusted text, with spelt-out new words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, non_empty, row_keys, saved, scratch
from .wordmodel import END, RUNS, SHARD_GRAMS, START, block_words, discounts, score_documents, windows

# One in so many trusted documents sets the thresholds and is not trained on.
HOLD_OUT = 5
# Languages with fewer held-out documents take the quantiles of all languages together.
MIN_HELD_OUT = 20
# Distances of the quartiles by which a threshold lies outside them if there are too few documents for a quantile.
FENCE = 3.0
# No bound that is not a pure quantile rejects a smaller share of repeats (fixed value).
REPEATS = 0.5


def word_grams(word: str, n: int) -> list[str]:
    """The ``n``-grams that predict each character of a word and its end."""
    s = START * (n - 1) + word + END
    return [s[i:i + n] for i in range(len(word) + 1)]


def _gram_counts(n: int, distinct: bool):
    """The character grams of the words of each block of the vocabulary: of all once, or of the training words with their counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"]):
                words, count = block_words(x, y)
                if not distinct:
                    words = words[:np.count_nonzero(count)]
                joined, first, owner, keys = windows(words, n)
                codes, _ = pd.factorize(keys)
                seen = first[~pd.Series(codes).duplicated().to_numpy()]
                grams = [joined[i:i + n] for i in seen.tolist()]
                total = np.bincount(codes, count[owner], len(grams))
                yield pd.DataFrame({"gram": grams, "cnt": 1 if distinct else total.astype("int64")})
    return non_empty(run)


def kneser_ney(counts: DataFrame, n: int,
               keep: Callable[[DataFrame, str], DataFrame] = saved) -> list[tuple[DataFrame, DataFrame]]:
    """The model from the counts (gram, cnt) of order ``n``: for each order from 1 on, (gram, p) and (context, gamma).

    A gram is a string of ``n`` characters.  Lower orders count the different
    units that stand before a gram; below order 1 lies an equal share for
    each unit.  Each order has three discounts from its counts of counts.
    All tables are keyed by the n-gram and joined on it, hash-partitioned.
    ``keep`` writes the model; the counts go when it is done.
    """
    with scratch(counts.sparkSession) as write:
        return _kneser_ney(counts, n, write, keep)


def _kneser_ney(counts: DataFrame, n: int, write: Callable[[DataFrame, str], DataFrame],
                keep: Callable[[DataFrame, str], DataFrame]) -> list[tuple[DataFrame, DataFrame]]:
    after, ahead = F.expr("substr(gram, 2)"), F.expr("left(gram, length(gram) - 1)")
    orders = {n: write(counts.groupBy("gram").agg(F.sum("cnt").alias("cnt")), "grams")}
    for k in range(n - 1, 0, -1):
        orders[k] = write(orders[k + 1].groupBy(after.alias("gram")).agg(F.count("*").alias("cnt")), "grams")
    model: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, n + 1):
        nn = orders[k].agg(*[F.count_if(F.col("cnt") == i).alias(f"n{i}") for i in (1, 2, 3, 4)],
                           F.count("*").alias("types")).first()
        d = discounts(*nn[:4])
        discount = F.when(F.col("cnt") == 1, d[0]).when(F.col("cnt") == 2, d[1]).otherwise(d[2])
        # the discounts of a context added as counts, so that the order of rows does not show in the last digits
        c = orders[k].groupBy(ahead.alias("context")).agg(
            F.sum("cnt").alias("total"), F.count_if(F.col("cnt") == 1).alias("c1"),
            F.count_if(F.col("cnt") == 2).alias("c2"), F.count_if(F.col("cnt") > 2).alias("c3"))
        gamma = (F.col("c1") * d[0] + F.col("c2") * d[1] + F.col("c3") * d[2]) / F.col("total")
        c = c.select("context", "total", gamma.alias("gamma"))
        # contexts and suffixes are joined as expressions: no row carries its gram twice
        joined = orders[k].join(c, ahead == F.col("context")).select(
            "gram", ((F.col("cnt") - discount) / F.col("total")).alias("own"), "gamma")
        if k > 1:
            below = model[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = joined.join(below, after == F.col("suffix"))
        else:
            joined = joined.withColumn("below", F.lit(1.0 / (nn["types"] + 1)))
        grams = joined.select("gram", (F.col("own") + F.col("gamma") * F.col("below")).alias("p"))
        model.append((keep(grams, "model"), keep(c.select("context", "gamma"), "gamma")))
    return model


def gram_logs(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]], types: int) -> DataFrame:
    """(gram, logp) of the different ``grams`` (gram) of the model's highest order, seen or not."""
    q = grams.select("gram")
    n = len(model)
    for k in range(1, n + 1):
        # the last k characters: probability if seen, else backed off from the order below
        p, g = model[k - 1]
        q = q.withColumn("tail", F.expr(f"right(gram, {k})"))
        q = q.withColumn("context", F.expr(f"left(tail, {k - 1})"))
        q = (q.join(p.select(F.col("gram").alias("tail"), "p"), "tail", "left")
             .join(g, "context", "left"))
        below = F.lit(1.0 / (types + 1)) if k == 1 else F.col("below")
        q = q.select("gram", F.coalesce(F.col("p"), F.coalesce("gamma", F.lit(1.0)) * below).alias("below"))
    return q.select("gram", F.log("below").alias("logp"))


def _trusted_ids(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids to train on and ids to set thresholds by: together all trusted ones."""
    t = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
         .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0")
         .select(F.col("doc_id").cast("long").alias("id"),
                 (F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HOLD_OUT)) == 0).alias("held")))
    t = saved(t, "trusted")
    # few ids (8 bytes each) go to all tasks, more are joined by shuffle
    small = t.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return tuple(F.broadcast(x) if small else x for x in (t.where("NOT held").select("id"), t.where("held").select("id")))


def score_quality(docs: DataFrame, labels: DataFrame, order: int = 5, low: float = 0.0025, high: float = 0.995,
                  shard_grams: int = SHARD_GRAMS, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """Judge documents by their perplexity per character under a model of trusted text.

    Trusted are all documents that ``labels`` (doc_id, quality, toxic) calls
    good and not toxic; repeated labels must agree.  Four in five train an interpolated modified
    Kneser-Ney model of three words over the running text (white space ends
    a word).  Below single words lies a model of their spelling by
    character ``order``-grams, so that words never seen have a probability.
    The fifth sets, for each language, quantiles (:func:`thresholds`): a
    document is rejected if its perplexity is above ``high`` of them, if
    its words as spelt are below ``low`` (training texts and their copies
    are known by heart as words, so that their perplexity has no lower
    bound), if more of its word triples repeat inside it than in ``high`` of
    them, or if its worst run of words (of each length of ``RUNS``) is worse
    than that of ``high`` of them: clean text around a passage doesn't
    dilute it.

    Returns one row per row of ``docs``: doc_id, k1, k2 (row key), lang,
    n_chars (predicted characters), perplexity (null without words), rejected.
    Documents without words, and all documents if no trusted one is left or
    held out, are not rejected.  A null language is a language of its own.
    Rows that repeat id and text with one language come back each.  Empty
    table: no rows.  Other columns are not used.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                    F.col(lang_col).cast("string").alias("lang"), *row_keys(F.col(id_col), F.col(text_col)))
    train, held = _trusted_ids(labels)
    marked = (d.join(train.withColumn("trained", F.lit(True)), "id", "left")
              .withColumn("train", F.coalesce("trained", F.lit(False))).drop("trained"))
    scores = score_documents(marked, partial(_spelling, order), order, shard_grams)
    return _judged(scores, thresholds(scores.join(held, "id", "left_semi"), low, high))


def _spelling(order: int, vocabulary: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(gram, logp) of every character gram of the words of ``vocabulary``, by a model of those of its training words."""
    with scratch(vocabulary.sparkSession) as within:
        counts = vocabulary.mapInPandas(_gram_counts(order, distinct=False), "gram string, cnt long")
        model = kneser_ney(counts, order, within)
        grams = vocabulary.mapInPandas(_gram_counts(order, distinct=True), "gram string, cnt long")
        grams = within(grams.groupBy("gram").agg(F.count("*").alias("c")).select("gram"), "corpus-grams")
        return write(gram_logs(grams, model, model[0][0].count()), "logs")


# The scores that have an upper (True) or lower bound.
BOUNDED = {"cost": True, "spelling": False, "repeats": True, **{f"run{k}": True for k in RUNS}}


def thresholds(scores: DataFrame, low: float, high: float) -> DataFrame:
    """(lang, one bound for each of ``BOUNDED``) of the languages of ``scores``; every = true in one row for all others.

    The bound is the quantile ``low`` or ``high`` wherever the held-out
    documents support it, that is if one of them is expected beyond.  A few
    don't tell the outer quantiles: the fewer they are, the nearer the bound
    moves to the quartile moved out by ``FENCE`` times the quartiles'
    distance, if that is farther.
    """
    s = scores.where("cost IS NOT NULL")
    q = [F.percentile_approx(c, F.array(*[F.lit(x) for x in (0.25, 0.75, high if up else low)]), F.lit(10_000)).alias(c)
         for c, up in BOUNDED.items()]
    own = s.groupBy("lang").agg(*q, F.count("*").alias("m")).where(F.col("m") >= MIN_HELD_OUT).withColumn("every", F.lit(False))
    every = s.agg(*q, F.count("*").alias("m")).select(F.lit(None).cast("string").alias("lang"), *BOUNDED, "m",
                                                      F.lit(True).alias("every"))

    def bound(c: str, up: bool) -> Column:
        first, third, outer = (F.col(c)[i] for i in range(3))
        margin = FENCE * (third - first)
        loose = F.greatest(outer, third + margin) if up else F.least(outer, first - margin)
        if c == "repeats":
            loose = F.greatest(loose, F.lit(REPEATS))
        unsure = F.greatest(F.lit(0.0), 1 - F.col("m") * (1 - high if up else low))
        return outer + unsure * (loose - outer)

    return own.unionByName(every).select("lang", *[bound(c, up).alias(c) for c, up in BOUNDED.items()], "every")


def _judged(scores: DataFrame, bounds: DataFrame) -> DataFrame:
    bounds = saved(bounds, "bounds")
    rest = bounds.where("every").first()
    # one row per language: bounds of its scores, joined by the language's name
    own = bounds.where("NOT every").select(F.col("lang").alias("own"), *[F.col(c).alias(f"own_{c}") for c in BOUNDED])
    s = scores.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("own")), "left")

    def beyond(c: str, up: bool) -> Column:
        bound = F.coalesce(f"own_{c}", F.lit(rest[c]).cast("double"))
        return F.coalesce(F.col(c) > bound if up else F.col(c) < bound, F.lit(False))

    bad = reduce(Column.__or__, [beyond(c, up) for c, up in BOUNDED.items()])
    return s.select(F.col("id").alias("doc_id"), "k1", "k2", "lang", F.col("n").alias("n_chars"),
                    F.exp("cost").alias("perplexity"), bad.alias("rejected"))
