"""Audit of how the sources of a language differ in their words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, saved

# A-Z to a-z, every other ASCII character but letters to a space; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Counts a task holds before it hands them on, and bytes of a text that are split at once.
MAX_COUNTS, SLICE = 400_000, 1 << 22
# Rows (term, source) of one block, and cells (term, source) of a matrix in it.
BLOCK_ROWS, CELLS = 200_000, 2_000_000
FAN_IN = 16
ARROW_ROWS = 500
SCALE, SMOOTH = 1_000_000_000, 5
# Above it a count times SCALE does not fit 64 bits, and Python's integers are used.
SAFE_COUNT = 9_000_000_000
FOUND = "part string, lang string, source string, salt long, item string, here long, whole long, value long"


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    t = text.translate(LETTERS)
    at = 0
    while at < len(t):
        end = at + SLICE
        if end < len(t):
            end = t.find(b" ", end)
            end = len(t) if end < 0 else end
        yield t[at:end].split()
        at = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of the texts of a task, in parts."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flush():
        for (lang, source), (times, docs) in groups.items():
            terms = pa.array(list(times), pa.binary()).cast(pa.string())
            same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), "int32")))
            yield pa.RecordBatch.from_arrays(
                [same(lang), same(source), terms, pa.array(list(times.values()), pa.int64()),
                 pa.array([docs[t] for t in times], pa.int64())], ["lang", "source", "term", "times", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            times, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(times), set()
            for words in _slices(text):
                times.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(times) - before
            if held > MAX_COUNTS:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, here, whole, one) of the terms of at least ``min_docs`` documents of a language.

    ``here`` counts in the source, ``whole`` in the language; ``one`` is 1 in
    one row of each term of a language.  Counts are added up in the tasks,
    then moved once, by language and term.
    """
    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    parts = texts.mapInArrow(_counts, "lang string, source string, term string, times long, docs long")
    by_term = Window.partitionBy("lang", "term")
    c = (parts.repartition("lang", "term").groupBy("lang", "term", "source")
         .agg(F.sum("times").alias("here"), F.sum("docs").alias("docs")))
    c = c.select("lang", "source", "term", "here", F.sum("here").over(by_term).alias("whole"),
                 F.sum("docs").over(by_term).alias("docs"),
                 F.row_number().over(by_term.orderBy("source")).alias("number"))
    return saved(c.where(F.col("docs") >= min_docs)
                 .select("lang", "source", "term", "here", "whole", F.when(F.col("number") == 1, 1).otherwise(0).alias("one")), "terms")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly."""
    c = counts.astype("int64")
    if len(c) and int(c.max()) > SAFE_COUNT:
        return np.array([1 + SCALE * (int(x) + SMOOTH) // (total + SMOOTH * terms) for x in c.ravel()], "int64").reshape(c.shape)
    return 1 + SCALE * (c + SMOOTH) // (total + SMOOTH * terms)


def skyband(here: np.ndarray, whole: np.ndarray, place: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """Which points fewer than ``k`` others dominate: ``here`` not lower, ``whole`` and ``place`` not higher.

    ``place`` differs for all points.  In the order taken here who dominates
    comes earlier, and what k points dominate is dominated by k points of the
    skyband, so that each point is held against those kept and its own step.
    """
    order = np.lexsort((place, whole, -here))
    w, p = whole[order], place[order]
    kept = np.zeros(0, "int64")
    for a in range(0, len(order), step):
        i = np.arange(a, min(a + step, len(order)))
        inside = (w[i][None, :] <= w[i][:, None]) & (p[i][None, :] <= p[i][:, None]) & (i[None, :] < i[:, None])
        by = inside.sum(1)
        if len(kept):
            by = by + ((w[kept][None, :] <= w[i][:, None]) & (p[kept][None, :] <= p[i][:, None])).sum(1)
        kept = np.concatenate([kept, i[by < k]])
    out = np.zeros(len(order), bool)
    out[order[kept]] = True
    return out


def _block(k: int):
    """What a block of a language's terms adds: parts of the sums of all pairs of sources, and a skyband for each source."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, salt = key
        groups = groups.sort_values("source")
        sources = groups["source"].tolist()
        totals = groups["total"].tolist()
        size, whole_total = (int(groups[c].iloc[0]) for c in ("size", "whole_total"))
        sums = np.zeros((len(sources), len(sources)), "int64")
        out = []
        if len(terms):
            code, words = pd.factorize(terms["term"], sort=True)  # by code point, which is the order of UTF-8
            source = pd.Categorical(terms["source"], categories=sources).codes
            here, whole = terms["here"].to_numpy(), terms["whole"].to_numpy()
            order = np.argsort(code, kind="stable")
            step = max(1, CELLS // len(sources))
            for a in range(0, len(words), step):
                at = order[np.searchsorted(code[order], a):np.searchsorted(code[order], a + step)]
                count = np.zeros((len(sources), min(step, len(words) - a)), "int64")
                count[source[at], code[at] - a] = here[at]
                p = np.stack([shares(c, n, size) for c, n in zip(count, totals)])
                for i in range(len(sources)):
                    sums[i] += np.abs(p - p[i]).sum(1)
            for i, name in enumerate(sources):
                at = np.flatnonzero(source == i)
                more = shares(here[at], totals[i], size) - shares(whole[at], whole_total, size)
                at, more = at[more > 0], more[more > 0]
                best = skyband(here[at], whole[at], code[at], k)
                at = at[best]
                out.append(pd.DataFrame({"part": "term", "lang": lang, "source": name, "salt": salt, "item": words[code[at]],
                                         "here": here[at], "whole": whole[at], "value": more[best]})[names])
        i, j = np.nonzero(~np.eye(len(sources), dtype=bool))
        named = np.array(sources, object)
        out.append(pd.DataFrame({"part": "pair", "lang": lang, "source": named[i], "salt": salt, "item": named[j], "here": 0,
                                 "whole": 0, "value": sums[i, j]})[names])
        return pd.concat(out)
    return run


def _merged(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pd.factorize(pdf["item"], sort=True)[0]
        keep = skyband(pdf["here"].to_numpy(), pdf["whole"].to_numpy(), place, k)
        return pdf[keep].assign(salt=pdf["salt"] // FAN_IN)
    return run


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source",
               text_col: str = "text") -> DataFrame:
    """How far the sources of each language lie from each other, and the words each source uses more than its language.

    Terms are runs of ASCII letters (A-Z lower-cased) and of characters
    beyond ASCII.  A language keeps the terms that at least ``min_docs`` of
    its documents have.  The share of a term in a source or language is
    1 + floor(10^9 (count + 5) / (N + 5 V)), with V kept terms and N
    occurrences of them.  Part ``pair``: for each other source of the
    language the sum of the differences of all shares.  Part ``term``: the
    ``top`` terms by the difference of the source's share and the
    language's, if it is above 0 and the source has the term.  Ranks run by
    value, ties by item in UTF-8.

    Returns (lang, source, part, item, value, rank).  Null language, source
    and text are ''.  Sources without terms have pairs; a language without
    kept terms has the value 0 for them.  Rows that repeat count each.
    Empty table: no rows.  Other columns are not used.

    A term's rank depends on its counts: another that is more frequent in
    the source, rarer in the language and earlier in UTF-8 ranks no lower.
    So each block of a language's terms hands on, for each source, only
    terms that fewer than ``top`` others dominate in this way; blocks are
    merged sixteen at a time, and what is left is ranked exactly.
    """
    arrow_rows(docs.sparkSession, ARROW_ROWS)
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                      for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = term_counts(d, min_docs)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    langs = kept.groupBy("lang").agg(F.sum("here").alias("whole_total"), F.sum("one").alias("size"), F.count("*").alias("m"))
    groups = (d.select("lang", "source").distinct()
              .join(kept.groupBy("lang", "source").agg(F.sum("here").alias("total")), ["lang", "source"], "left")
              .join(langs, "lang", "left")
              .select("lang", "source", zero("total"), zero("whole_total"), zero("size"),
                      F.ceil(F.greatest(F.coalesce("m", F.lit(1)), F.lit(1)) / BLOCK_ROWS).cast("long").alias("salts")))
    groups = saved(groups, "groups")
    parts = groups.groupBy(F.col("lang").alias("of")).agg(F.max("salts").alias("parts"))
    terms = (kept.join(parts, kept["lang"] == F.col("of"))
             .select("lang", "source", "term", "here", "whole", F.pmod(F.xxhash64("term"), F.col("parts")).alias("salt")))
    every = groups.select("lang", "source", "total", "whole_total", "size",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    found = saved(terms.groupBy("lang", "salt").cogroup(every.groupBy("lang", "salt")).applyInPandas(_block(top), FOUND), "found")
    best = found.where("part = 'term'")
    while not best.where("salt > 0").isEmpty():
        best = best.groupBy("lang", "source", F.floor(F.col("salt") / FAN_IN)).applyInPandas(_merged(top), FOUND)
        best = saved(best, "merged")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    return (best.select(*columns, rank).where(F.col("rank") <= top)
            .unionByName(pairs.select(*columns, rank)))
