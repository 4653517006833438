"""Benchmark contamination through a positional inverted index of the test terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import arrow_rows, non_empty, row_keys, saved

ARROW_ROWS = 500
# Most test terms that tasks hold as a dictionary (about 100 bytes each); beyond it all terms are indexed and joined.
DICTIONARY_TERMS = 1_000_000
# Most documents whose keys (16 bytes) are broadcast to pick candidates; beyond it they are joined by shuffle.
BROADCAST_KEYS = 500_000
# Words are runs of 0-9, a-z and everything beyond ASCII, A-Z lower-cased; all else becomes a space.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@non_empty
def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"item": pdf["item"], "words": [[w.decode("utf-8", "surrogatepass") for w in tokens(t)]
                                                           for t in pdf["text"]]})


def _statistics(vocabulary):
    """Per document its key and number of words; per task the counts of test terms (or of all)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = vocabulary.value if vocabulary else None
        counts = np.zeros(len(index) if index else 0, np.int64)
        rest: Counter = Counter()

        def flush():
            found = {w: int(counts[i]) for w, i in index.items() if counts[i]} if index else rest
            return pd.DataFrame({"id": pd.Series([None] * len(found), dtype="Int64"), "k1": None, "k2": None, "n": None,
                                 "term": [w.decode("utf-8", "surrogatepass") for w in found],
                                 "freq": list(found.values())})

        for pdf in batches:
            n = []
            for text in pdf["text"]:
                words = tokens(text)
                n.append(len(words))
                if index:
                    at = np.fromiter(map(index.get, words, [-1] * len(words)), np.int64, len(words))
                    counts += np.bincount(at[at >= 0], minlength=len(counts))
                elif index is None:
                    rest.update(words)
            yield pd.DataFrame({"id": pdf["id"], "k1": pdf["k1"], "k2": pdf["k2"], "n": n, "term": None, "freq": None})
            if len(rest) > 500_000:
                yield flush()
                rest.clear()
        if index or rest:
            yield flush()
    return non_empty(run)


def _postings(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = vocabulary.value if vocabulary else None
        names = {i: w for w, i in index.items()} if index else None
        for pdf in batches:
            terms, k1, k2, positions = [], [], [], []
            for text, a, b in zip(pdf["text"], pdf["k1"], pdf["k2"]):
                words = tokens(text)
                own = index if index is not None else {w: i for i, w in enumerate(dict.fromkeys(words))}
                at = np.fromiter(map(own.get, words, [-1] * len(words)), np.int64, len(words))
                where = np.flatnonzero(at >= 0)
                if not len(where):
                    continue
                order = where[np.argsort(at[where], kind="stable")]
                found, first = np.unique(at[order], return_index=True)
                word = names or dict(enumerate(own))
                terms += [word[i].decode("utf-8", "surrogatepass") for i in found.tolist()]
                positions += np.split(order.astype(np.int32), first[1:])
                k1 += [a] * len(found)
                k2 += [b] * len(found)
            yield pd.DataFrame({"term": terms, "k1": k1, "k2": k2, "positions": positions})
    return non_empty(run)


def _dictionary(terms: DataFrame):
    """The distinct ``terms`` as a broadcast dictionary, or None if there are too many."""
    spark = terms.sparkSession
    rows = terms.select("term").distinct().limit(DICTIONARY_TERMS + 1).collect()
    if len(rows) > DICTIONARY_TERMS:
        return None
    return spark.sparkContext.broadcast({r["term"].encode("utf-8", "surrogatepass"): i for i, r in enumerate(rows)})


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       *row_keys(F.col(id_col), F.col(text_col)))


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (from :func:`keyed`): term, k1, k2, positions (ascending), for ``terms`` (term)."""
    known = _dictionary(terms)
    rows = docs.select("text", "k1", "k2").mapInPandas(_postings(known),
                                                       "term string, k1 long, k2 long, positions array<int>")
    return saved(rows if known else rows.join(terms.select("term").distinct(), "term", "left_semi"), "postings")


def item_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows of all items: item (key of the row), item_id, start, words (array); one window if an item is shorter."""
    items = saved(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
                  .mapInPandas(_item_words, "item string, words array<string>").where(F.size("words") > 0)
                  .withColumn("row", F.monotonically_increasing_id()), "items")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    w = items.select(F.col("row"), F.col("item").alias("item_id"), "words", F.explode(starts).alias("start"))
    return w.select("row", "item_id", "start", F.slice("words", F.col("start") + 1, F.lit(n)).alias("words"))


def _rarest(windows: DataFrame, frequency: DataFrame, k: int) -> DataFrame:
    """The ``k`` rarest places of each window that can occur at all: row, start, offset, term."""
    w = windows.select("row", "start", F.posexplode("words").alias("offset", "term"))
    w = w.join(frequency, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    by = Window.partitionBy("row", "start")
    w = w.withColumn("least", F.min("freq").over(by)).where("least > 0")
    w = w.withColumn("i", F.row_number().over(by.orderBy("freq", "term", "offset"))).where(F.col("i") <= k)
    return w.select("row", "start", "offset", "term")


@non_empty
def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare candidates with the text, word by word."""
    for pdf in batches:
        hit, items = [], []
        for text, found in zip(pdf["text"], pdf["found"]):
            words = tokens(text)
            mark, named = np.zeros(len(words) + 1, np.int32), set()
            for f in found:
                at, n = f["at"], f["n"]
                if b" ".join(words[at:at + n]) == f["words"].encode("utf-8", "surrogatepass"):
                    mark[at] += 1
                    mark[at + n] -= 1
                    if f["item_id"] is not None:
                        named.add(f["item_id"])
            hit.append(int((np.cumsum(mark) > 0).sum()))
            items.append(sorted(named))
        yield pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "n_hit": hit, "items": items})


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5, rare_terms: int = 2,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Mark documents that hold windows of ``n`` consecutive words of a benchmark item.

    One pass over the documents counts their words and the corpus frequency
    of every test term; a second stores the postings (term, document,
    positions) of the ``rare_terms`` rarest terms of each window.  The lists
    are moved by each term's offset in its item and intersected: what all
    rare terms of a window agree on is a candidate place.  These places are
    compared with the text word by word.

    Returns one row per row of ``docs``: doc_id, k1, k2 (row key), n_words,
    n_hit (words inside any occurrence), n_items, items (their ids as
    strings, sorted), contaminated (n_hit > 0 and n_hit / n_words at least
    ``percent`` / 100).  Null and blank texts have no words and no hits.  An
    item of fewer than ``n`` words is one window; one without words none; one
    without an id marks words but isn't listed.  Items of equal id count
    once.  Rows that repeat id and text come back each.  No items: no hits;
    no documents: no rows.  Other columns are not used.
    """
    spark = docs.sparkSession
    arrow_rows(spark, ARROW_ROWS)
    d = keyed(docs, id_col, text_col)
    windows = saved(item_windows(benchmark, n, item_col, item_text_col), "windows")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    stats = saved(d.mapInPandas(_statistics(_dictionary(terms)),
                                "id long, k1 long, k2 long, n long, term string, freq long"), "statistics")
    frequency = (stats.where("term IS NOT NULL").groupBy("term").agg(F.sum("freq").alias("freq"))
                 .join(terms, "term", "left_semi"))
    rare = saved(_rarest(windows, frequency, rare_terms), "rare")
    index = positional_index(d, rare)

    # lists of the rare terms, moved by the term's place in its item, meet at (document, item row, shift)
    places = rare.select("term", "row", (F.col("start") + F.col("offset")).alias("place")).distinct()
    moved = (index.join(places, "term")
             .select("k1", "k2", "row", "place", F.explode("positions").alias("p"))
             .groupBy("k1", "k2", "row", (F.col("p") - F.col("place")).alias("shift"))
             .agg(F.collect_set("place").alias("got")))
    needs = (rare.groupBy("row", "start").agg(F.collect_set(F.col("start") + F.col("offset")).alias("need"))
             .join(windows, ["row", "start"])
             .groupBy("row").agg(F.first("item_id").alias("item_id"), F.collect_list(
                 F.struct("start", "need", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))).alias("w")))
    ok = F.filter("w", lambda x: (F.size(F.array_except(x["need"], "got")) == 0) & (x["start"] + F.col("shift") >= 0))
    found = (moved.join(needs, "row").select("k1", "k2", "item_id", "shift", F.explode(ok).alias("x"))
             .groupBy("k1", "k2").agg(F.collect_list(F.struct(
                 "item_id", (F.col("x.start") + F.col("shift")).alias("at"), F.col("x.n").alias("n"),
                 F.col("x.words").alias("words"))).alias("found")))
    found = saved(found, "candidates")
    keys = found.select("k1", "k2")
    small = found.count() <= BROADCAST_KEYS
    picked = d.select("text", "k1", "k2").join(F.broadcast(keys) if small else keys, ["k1", "k2"], "left_semi")
    hits = (picked.join(found, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
            .mapInPandas(_confirm, "k1 long, k2 long, n_hit long, items array<string>"))
    out = stats.where("term IS NULL").select("id", "k1", "k2", "n").join(hits, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias("doc_id"), "k1", "k2", F.col("n").alias("n_words"), n_hit.alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"), items.alias("items"),
                      ((n_hit > 0) & (n_hit * 100 >= F.col("n") * percent)).alias("contaminated"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents in which the two rarest different terms of an item stand at most ``span`` words apart.

    Returns doc_id, item_id, distance (the least one).  Rare is judged by the
    number of documents of the index that hold a term.  Items with fewer than
    two terms that occur give nothing; null texts neither.
    """
    arrow_rows(docs.sparkSession, ARROW_ROWS)
    d = keyed(docs, id_col, text_col)
    words = saved(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
                  .mapInPandas(_item_words, "item string, words array<string>")
                  .select("item", F.explode("words").alias("term")).distinct(), "terms")
    index = positional_index(d, words)
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    w = Window.partitionBy("item").orderBy("df", "term")
    two = words.join(df, "term").withColumn("i", F.row_number().over(w)).where("i <= 2")
    pair = two.groupBy("item").agg(F.min(F.when(F.col("i") == 1, F.col("term"))).alias("t1"),
                                   F.min(F.when(F.col("i") == 2, F.col("term"))).alias("t2")).where("t2 IS NOT NULL")
    one = index.select(F.col("term").alias("t1"), "k1", "k2", F.col("positions").alias("p1"))
    other = index.select(F.col("term").alias("t2"), "k1", "k2", F.col("positions").alias("p2"))
    m = pair.join(one, "t1").join(other, ["t2", "k1", "k2"])
    m = m.select("item", "k1", "k2", F.explode("p1").alias("a"), "p2")
    m = m.select("item", "k1", "k2", F.array_min(F.transform("p2", lambda b: F.abs(F.col("a") - b))).alias("distance"))
    m = m.groupBy("item", "k1", "k2").agg(F.min("distance").alias("distance")).where(F.col("distance") <= span)
    ids = d.select("id", "k1", "k2").distinct()
    return m.join(ids, ["k1", "k2"]).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance")
