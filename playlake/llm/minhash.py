"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, arrow_rows, non_empty, row_keys, saved, sent_if_few
from .graph import connected_components
from .words import BASE_A, BASE_B, WordHashes, mixed, windows

# 30 bands of 6 bins: documents at a similarity of 0.85 share no band with probability (1 - 0.85^6)^30 < 1e-6.
BANDS, BAND_BINS = 30, 6
# Star rounds before what is left in buckets is compared pair by pair.
STAR_ROUNDS = 2
ARROW_ROWS = 500


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    """Row j: the order in which an empty bin j looks for a full one; its own random order, the same everywhere."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a sorted set of 64-bit hashes, empty bins densified from random full ones."""
    at = ((shingles & np.uint64(0xFFFFFFFF)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(at.astype(np.int64), return_index=True)  # ascending hashes: the first is the least
    out = np.zeros(bins, np.uint64)
    out[full] = shingles[first]
    has = np.zeros(bins, bool)
    has[full] = True
    if len(full) < bins:
        empty = np.flatnonzero(~has)
        donors = _donors(bins)[empty]
        out[empty] = out[donors[np.arange(len(empty)), has[donors].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mixed(key * BASE_A + rows[:, i])
    return key.view(np.int64)


def shingle_set(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; fewer words are one run as a whole."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(mixed(windows(hashes.of(words), min(n, len(words)))))


def _signatures(words: int, bands: int, bins: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            n, c1, c2, keys = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, words, hashes) if text else np.empty(0, np.uint64)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    # two sums of mixed values name the set in 128 bits
                    c1.append(int(mixed(s * BASE_B).sum().view(np.int64)) if len(s) else 0)
                    c2.append(int(mixed(s ^ BASE_A).sum().view(np.int64)) if len(s) else 0)
                keys.append(band_keys(signature(s, bands * bins), bands) if len(s) else np.empty(0, np.int64))
            yield pd.DataFrame({"id": pdf["id"], "k1": pdf["k1"], "k2": pdf["k2"], "n": n, "c1": c1, "c2": c2,
                                "bands": keys})
    return non_empty(run)


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"cid": pdf["cid"], "shingles": [
                shingle_set(t, words, hashes).view(np.int64) for t in pdf["text"]]})
    return non_empty(run)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """``pairs`` (a, b, ...) with i, the size of what their full sets share, and ok, whether that makes a link; written.

    ``few`` pairs go to the sets, and the two sets of each meet by the pair.
    Else a may be a hub: its join is split when skewed.
    """
    left, right = (sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b"))
    if few:
        pairs = saved(pairs, "pairs")
        p = right.join(F.broadcast(pairs), "b").join(left.join(F.broadcast(pairs.select("a", "b")), "a"), ["a", "b"])
    else:
        p = pairs.join(right, "b").join(left, "a")
    inter, total = F.size(F.array_intersect("sa", "sb")).cast("long"), (F.size("sa") + F.size("sb")).cast("long")
    p = p.select(*pairs.columns, inter.alias("i"), total.alias("total"))
    return saved(p.withColumn("ok", F.col("i") * 100 >= (F.col("total") - F.col("i")) * percent).drop("total"), "compared")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS,
                    band_bins: int = BAND_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set holds its distinct runs of ``shingle_words`` words, or the
    whole sequence if it has fewer.  Documents of equal sets form one class,
    and classes take the place of documents from then on.

    One-permutation MinHash with optimal densification makes a signature,
    bands of it name buckets.  Shingles that no other class in a bucket has
    bound what a class can share; where that rules out every link, the class
    leaves.  In each bucket the class with the most bucket neighbours is the
    centre of a star: it is compared with each other member on the full
    sets, so that a bucket of m classes gives m - 1 pairs.  The centre then
    leaves the bucket, buckets whose members are linked to one centre are
    done, and the next star follows.  After a few rounds the members left
    over under different centres are compared pair by pair: no pair that
    shares a bucket goes unexamined unless it is connected already, or its
    sizes and what both share with the centre rule out a link.

    Returns one row per row of ``docs``: doc_id, k1, k2 (row key), n_shingles,
    group_id (one number a component; null without words), component_id
    (smallest doc_id reachable, its own included; null if the component has
    null ids only), kept (doc_id = component_id).  Null or blank texts have no shingles and are
    linked with nothing.  Rows that repeat id and text come back each; rows
    of one id with different texts are judged apart.  Empty table: no rows.
    Other columns of ``docs`` are not used.
    """
    arrow_rows(docs.sparkSession, ARROW_ROWS)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                    *row_keys(F.col(id_col), F.col(text_col)))
    sig = saved(d.mapInPandas(_signatures(shingle_words, bands, band_bins),
                              "id long, k1 long, k2 long, n long, c1 long, c2 long, bands array<long>"), "signatures")
    # one class per distinct set; hot groups of copies are combined before the shuffle
    classes = saved(sig.where("n > 0").groupBy("c1", "c2", "n")
                    .agg(F.min("id").alias("low"), F.min(F.struct("k1", "k2")).alias("k"), F.first("bands").alias("bands"))
                    .withColumn("cid", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("cid", F.explode("bands").alias("bucket"))
    many = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = saved(buckets.join(many, "bucket", "left_semi"), "members")
    need = members.select("cid").distinct()
    keys = saved(classes.select("cid", "n", "k.k1", "k.k2").join(need, "cid", "left_semi"), "keys")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    texts = d.select("text", "k1", "k2").join(F.broadcast(keys) if few else keys, ["k1", "k2"])
    sets = saved(texts.select("cid", "text").dropDuplicates(["cid"])
                 .mapInPandas(_sets(shingle_words), "cid long, shingles array<long>"), "sets")

    links = _links(members, keys.select("cid", "n"), sets, percent)
    comp = saved(connected_components(links).select(F.col("node").alias("cid"), "component"), "components")
    few = sent_if_few(comp)
    # of the few classes that have links: the smallest id of each component
    low = classes.select("cid", "low").join(few(comp), "cid").groupBy("component").agg(F.min("low").alias("component_low"))
    linked = few(comp.join(few(low), "component").select("cid", "component", "component_low"))
    named = (classes.select("c1", "c2", "n", "low", "cid").join(linked, "cid", "left")
             .select("c1", "c2", "n", F.coalesce("component", "cid").alias("group_id"),
                     F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component_low"))
                     .alias("component_id")))
    out = sig.select("id", "k1", "k2", "n", "c1", "c2").join(named, ["c1", "c2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "k1", "k2", F.col("n").alias("n_shingles"),
                      "group_id", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def _links(members: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between classes that share a bucket; enough of them for the components."""
    # shingles of one class alone can't be shared: s is what is left of a set
    alone = (sets.select("cid", F.explode("shingles").alias("x")).groupBy("x")
             .agg(F.count("*").alias("m"), F.min("cid").alias("cid")).where("m = 1")
             .groupBy("cid").agg(F.count("*").alias("alone")))
    shared = (sizes.join(alone, "cid", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0)))
              .where(F.col("s") * 100 >= F.col("n") * percent).select("cid", "n", "s"))
    # tables by class, and by bucket, that are sent if they are small
    classes, few = sent_if_few(sizes), sent_if_few(members)
    left = members.join(classes(shared), "cid")
    many = left.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    left = saved(left.join(few(many), "bucket"), "bucketed")
    degree = left.groupBy("cid").agg(F.sum("size").alias("degree"))
    left = left.select("bucket", "cid", "n", "s").join(classes(degree), "cid")
    # the most that two sets can share still has to be enough
    def enough(most):
        return most * (100 + percent) >= (F.col("n") + F.col("m")) * percent

    tested = None
    for _ in range(STAR_ROUNDS):
        top = F.struct(F.col("degree"), (-F.col("cid")).alias("low"), F.col("n"), F.col("s"))
        centre = (left.groupBy("bucket").agg(F.max(top).alias("c"))
                  .select("bucket", (-F.col("c.low")).alias("a"), F.col("c.degree").alias("da"), F.col("c.n").alias("m"),
                          F.col("c.s").alias("t")))
        star = left.join(few(centre), "bucket").where(F.col("cid") != F.col("a"))
        star = saved(star.select("*", F.least("a", "cid").alias("x"), F.greatest("a", "cid").alias("y")), "star")
        pairs = (star.where(enough(F.least("s", "t"))).select("a", F.col("cid").alias("b"), "da", "x", "y")
                 .dropDuplicates(["x", "y"]))
        if tested is not None:
            pairs = pairs.join(few(tested), ["x", "y"], "left_anti")
        new = _compared(pairs, sets, percent, few is F.broadcast)
        tested = new if tested is None else tested.unionByName(new)
        # members linked to one centre, or to centres linked to one, are connected
        own = tested.where("ok").groupBy("b").agg(F.max(F.struct("da", "a")).alias("c")).select("b", F.col("c.a").alias("a"))
        next_ = own.select(F.col("b").alias("a"), F.col("a").alias("up"))
        own = own.join(classes(next_), "a", "left").select(F.col("b").alias("cid"), F.coalesce("up", "a").alias("group"))
        rest = (star.select("bucket", "cid", "n", "s", "degree", "x", "y").join(classes(own), "cid", "left")
                .withColumn("group", F.coalesce("group", "cid")))
        apart = (rest.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi"),
                                            F.count("*").alias("size")).where("lo < hi").select("bucket", "size"))
        rest = saved(rest.join(few(apart), "bucket").join(few(tested.select("x", "y", "i")), ["x", "y"], "left").drop("x", "y"), "left")
        # each member counts its bucket's members, itself among them
        work = rest.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("pairs"), F.count("*").alias("members")).first()
        links = tested.where("ok").select("a", "b")
        if work["members"] == 0:
            return links
        left = rest.select("bucket", "cid", "n", "s", "degree")
        if work["pairs"] <= 8 * work["members"]:
            break
    # what two sets share lies in the centre or outside: i and s - i bound the two parts
    known = F.col("i").isNotNull() & F.col("j").isNotNull()
    most = F.when(known, F.least("i", "j") + F.least(F.col("s") - F.col("i"), F.col("t") - F.col("j"))).otherwise(F.least("s", "t"))
    # a pair is made in one of its buckets
    places = rest.groupBy("cid").agg(F.collect_set("bucket").alias("places"))
    rest = rest.join(classes(places), "cid")
    x = rest.select("bucket", F.col("cid").alias("a"), "n", "s", "i", F.col("group").alias("ga"), F.col("places").alias("pa"))
    y = rest.select("bucket", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("i").alias("j"),
                    F.col("group").alias("gb"), F.col("places").alias("pb"))
    pairs = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb"))
                   & enough(F.least("s", "t")) & enough(most)
                   & (F.array_min(F.array_intersect("pa", "pb")) == x["bucket"]))
    last = _compared(pairs.select("a", "b"), sets, percent)
    return links.unionByName(last.where("ok").select("a", "b"))
