"""Exact substring de-duplication: windows of words that repeat, found by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DROP_SHUFFLES, arrow_rows, non_empty, pick_rows, row_keys, saved, scratch, settings
from .words import BASE_A, BASE_B, WordHashes, mixed, windows

ARROW_ROWS = 500


def levels(n: int) -> tuple[int, int]:
    """The two lengths before ``n``: a quarter and a half of it, rounded up."""
    return max(1, -(-n // 4)), max(1, -(-n // 2))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _seeds(n: int):
    """Of each window of ``n`` words the first least of its shortest windows, with that one's two extensions."""
    base, half = levels(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            rows = []
            for text, k1, k2 in zip(pdf["text"], pdf["k1"], pdf["k2"]):
                words = _words(text)
                if len(words) < n:
                    continue
                h = hashes.of(words)
                short = mixed(windows(h, base))
                # sliding minima over the n - base + 1 short windows of each long one
                view = np.lib.stride_tricks.sliding_window_view(short, n - base + 1)
                at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
                wide = mixed(windows(h, half))
                to_left = at - (half - base)
                right = np.where(at < len(wide), wide[np.minimum(at, len(wide) - 1)], np.uint64(0))
                left = np.where(to_left >= 0, wide[np.maximum(to_left, 0)], np.uint64(0))
                whole = xxhash.xxh3_128_digest(b" ".join(words))
                c1, c2 = np.frombuffer(whole, np.int64).tolist()
                rows.append((k1, k2, c1, c2, at.astype(np.int32), _signed(short[at]), _signed(right), _signed(left)))
            yield pd.DataFrame(rows, columns=["k1", "k2", "c1", "c2", "at", "short", "rgt", "lft"])
    return non_empty(run)


def _long_windows(n: int):
    """The windows of ``n`` words around the seeds that are left: start and two 64-bit hashes each."""
    base, half = levels(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            rows = []
            for text, k1, k2, right, left in zip(pdf["text"], pdf["k1"], pdf["k2"], pdf["rgt"], pdf["lft"]):
                h = hashes.of(_words(text))
                total = len(h) - n + 1
                mark = np.zeros(total + 1, np.int32)
                for at, shift in ((np.asarray(right, np.int64), 0), (np.asarray(left, np.int64), half - base)):
                    # the windows that hold [at - shift, at - shift + half)
                    last = at - shift
                    np.add.at(mark, np.clip(last - (n - half), 0, total), 1)
                    np.add.at(mark, np.clip(last + 1, 0, total), -1)
                start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                rows.append((k1, k2, start.astype(np.int32), _signed(windows(h, n)[start]),
                             _signed(windows(mixed(h), n, BASE_B)[start])))
            yield pd.DataFrame(rows, columns=["k1", "k2", "start", "a", "b"])
    return non_empty(run)


def repeated_windows(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Where in documents (text, k1, k2) windows stand that start anywhere else too.

    Two tables: (k1, k2) of the documents whose whole word sequence recurs,
    so that all their windows do, and (k1, k2, starts) of others.  Of
    documents with equal sequences one stands for all in what follows.

    Level one counts the windows of a quarter of the length, of which it is
    enough to take, from each long window, the one with the least hash: equal
    long windows choose alike, and about 2 in ``n`` - n/4 + 2 are chosen.
    Those that recur are extended to half the length, to either side; those
    that recur again name the long windows that can recur, and these are
    counted by 128 bits.  Each level joins counts with places on the hash; a
    hash that holds a third of all places is split by the skew join.
    """
    spark = docs.sparkSession
    # what only a later level reads goes with the last one, shuffles go at once
    with scratch(spark) as write:
        seeds = write(docs.select("text", "k1", "k2").mapInPandas(_seeds(n), (
            "k1 long, k2 long, c1 long, c2 long, at array<int>, short array<long>, rgt array<long>, lft array<long>")), "seeds")
        first = F.min(F.struct("k1", "k2")).alias("first")
        classes = seeds.groupBy("c1", "c2").agg(F.count("*").alias("m"), first).where("m > 1").drop("m")
        with settings(spark, DROP_SHUFFLES):
            copies = saved(seeds.select("c1", "c2", "k1", "k2").join(classes, ["c1", "c2"])
                           .select("k1", "k2", (F.struct("k1", "k2") == F.col("first")).alias("stands")).distinct(), "copies")
        seeds = pick_rows(seeds, copies.where("NOT stands").select("k1", "k2"), "left_anti")
        many = (seeds.select(F.explode("short").alias("short")).groupBy("short").agg(F.count("*").alias("m"))
                .where("m > 1").select("short"))
        one = (seeds.select("k1", "k2", F.explode(F.arrays_zip("at", "short", "rgt", "lft")).alias("s"))
               .select("k1", "k2", "s.*").join(many, "short", "left_semi").drop("short"))
        one = write(one, "level-1")
        # the two extensions as rows of their own: side 0 to the right, 1 to the left; 0 stands for none
        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("rgt").alias("wide")),
                        F.struct(F.lit(1).alias("side"), F.col("lft").alias("wide")))
        two = one.select("k1", "k2", "at", F.explode(sides).alias("x")).select("k1", "k2", "at", "x.*").where("wide != 0")
        many = two.groupBy("side", "wide").agg(F.count("*").alias("m")).where("m > 1").select("side", "wide")
        two = two.join(many, ["side", "wide"], "left_semi")
        of = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("at")))
        two = write(two.groupBy("k1", "k2").agg(of(0).alias("rgt"), of(1).alias("lft")), "level-2")
        picked = pick_rows(docs.select("text", "k1", "k2"), two.select("k1", "k2"), "left_semi")
        three = write(picked.join(two, ["k1", "k2"]).mapInPandas(
            _long_windows(n), "k1 long, k2 long, start array<int>, a array<long>, b array<long>"), "level-3")
        many = (three.select(F.explode(F.arrays_zip("a", "b")).alias("w")).groupBy("w.a", "w.b")
                .agg(F.count("*").alias("m")).where("m > 1").select("a", "b"))
        three = three.select("k1", "k2", F.explode(F.arrays_zip("start", "a", "b")).alias("w")).select("k1", "k2", "w.*")
        found = three.join(many, ["a", "b"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("start").alias("starts"))
        with settings(spark, DROP_SHUFFLES):
            found = saved(found, "repeated")
    copies = copies.select("k1", "k2")
    return copies, pick_rows(found, copies, "left_anti")


def _cut(n: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, whole, starts in zip(pdf["text"], pdf["whole"], pdf["starts"]):
                words = _words(text)
                gone = 0
                if whole:
                    gone, rest = len(words), b""
                elif starts is not None and len(starts):
                    mark = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, np.asarray(starts) + n, -1)
                    keep = np.cumsum(mark[:-1]) == 0
                    gone = int(len(words) - keep.sum())
                    rest = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
                else:
                    rest = b" ".join(words)
                out.append((len(words), gone, hashlib.sha256(rest).hexdigest(),
                            rest.decode("utf-8", "surrogatepass") if with_text else None))
            o = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])
            yield pd.concat([pdf[["id", "k1", "k2"]].reset_index(drop=True), o], axis=1)
    return non_empty(run)


def dedup_substrings(docs: DataFrame, n: int = 50, with_text: bool = True, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Remove every word that a repeated window of ``n`` words covers.

    Words are runs of anything but ASCII white space.  A window repeats if
    the same words start at any other place, in the same document too; all
    windows are judged on the input.

    Returns one row per row of ``docs``: doc_id, k1, k2 (row key), n_words,
    n_removed, kept_sha256 (of the words kept, joined by one space, UTF-8)
    and kept (that text; null unless ``with_text``).  Null and blank texts
    have no words.  Rows that repeat are copies of each other, so that
    ``n`` words or more of them go.  Texts shorter than ``n`` words keep all.
    Empty table: no rows.  Other columns are not used.
    """
    arrow_rows(docs.sparkSession, ARROW_ROWS)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                    *row_keys(F.col(id_col), F.col(text_col)))
    copies, found = repeated_windows(d, n)
    no_starts = F.lit(None).cast("array<int>").alias("starts")
    columns = ["id", "k1", "k2", "text"]
    # only texts that lose words meet their windows
    with settings(docs.sparkSession, DROP_SHUFFLES):
        keys = saved(copies.unionByName(found.select("k1", "k2")), "keys")
    rows = (pick_rows(d, copies, "left_semi").select(*columns, F.lit(True).alias("whole"), no_starts)
            .unionByName(pick_rows(d, found.select("k1", "k2"), "left_semi").join(found, ["k1", "k2"])
                         .select(*columns, F.lit(False).alias("whole"), "starts"))
            .unionByName(pick_rows(d, keys, "left_anti").select(*columns, F.lit(False).alias("whole"), no_starts)))
    out = rows.mapInPandas(_cut(n, with_text), (
        "id long, k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, kept string"))
    return out.withColumnRenamed("id", "doc_id")
