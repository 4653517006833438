"""Line de-duplication by content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import evaluated, free_name, row_keys

# A line's hash is the first 32 bits of its md5; two of them make a rolling value.
LINE_DIGITS = 8
ROLL_BASE, ROLL_MOD = 31, 2 ** 31


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_rows(docs: DataFrame, text_col: str, keep: list[Column], divisor: int) -> DataFrame:
    """One row per chunk of two lines or more: ``keep``, start (line, from 0), n (lines), chunk (their text).

    The rolling value at line i is made of the hashes of the lines i-1 and
    i; a cut follows line i where it is divisible by ``divisor`` and that of
    line i-1 isn't.  A cut so depends on three lines only and moves with
    them, and no two cuts are adjacent: only the first and the last chunk of
    a text may be single lines.
    """
    d = docs.where(F.instr(text_col, "\n") > 0).select(*keep, F.col(text_col).alias("text"))
    names = [c for c in d.columns if c != "text"]
    d = evaluated(d.select(*names, text_lines(F.col("text")).alias("x")), "x", "lines")
    h = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, LINE_DIGITS), 16, 10).cast("long"))
    d = evaluated(d.select(*names, "lines", h.alias("x")), "x", "h")
    m = F.size("h") - 1
    divides = F.zip_with(F.slice("h", F.lit(1), m), F.slice("h", F.lit(2), m),
                         lambda a, b: (a * ROLL_BASE + b) % ROLL_MOD % divisor == 0)
    d = evaluated(d.select(*names, "lines", divides.alias("x")), "x", "f")  # of the lines 1, 2, ...
    before = F.concat(F.array(F.lit(False)), F.slice("f", F.lit(1), F.size("f") - 1))
    cut = F.zip_with("f", before, lambda a, b: a & ~b)
    stops = F.array_compact(F.transform(cut, lambda c, i: F.when(c, i + 1)))
    stops = F.array_distinct(F.concat(stops, F.array(F.size("lines") - 1)))
    d = evaluated(d.select(*names, "lines", stops.alias("x")), "x", "stops")
    starts = F.concat(F.array(F.lit(0)), F.transform("stops", lambda e: e + 1))
    spans = F.filter(F.zip_with(F.slice(starts, F.lit(1), F.size("stops")), "stops",
                                lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("n"))), lambda s: s["n"] > 1)
    d = d.select(*names, "lines", F.explode(spans).alias("s"))
    return d.select(*names, "s.start", "s.n",
                    F.array_join(F.slice("lines", F.col("s.start") + 1, F.col("s.n")), "\n").alias("chunk"))


def repeated_chunks(docs: DataFrame, divisor: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with something to remove: k1, k2 (its row key) and spans, sorted array<struct<start, n>>.

    A chunk is removed if the same bytes form a chunk elsewhere that comes
    first: by smaller id (null last), then row key, then line.
    """
    keep = [F.col(id_col).alias("id"), *row_keys(F.col(id_col), F.col(text_col))]
    c = chunk_rows(docs, text_col, keep, divisor).select(
        "*", F.xxhash64("chunk").alias("h1"), F.xxhash64(F.lit("chunk"), "chunk").alias("h2"))
    # hashes alone are counted first: tasks combine them, and no text moves
    many = c.groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1").select("h1", "h2")
    some = c.join(many, ["h1", "h2"], "left_semi")
    # chunks of one hash are removed only if their bytes agree, that is if the least and the greatest are the same
    place = F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("k1"), F.col("k2"), F.col("start"))
    same = (some.groupBy("h1", "h2")
            .agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"), F.min(place).alias("first"))
            .where("a = b").select("h1", "h2", "first"))
    later = (some.select("k1", "k2", "start", "n", "h1", "h2").join(same, ["h1", "h2"])
             .where((F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2"))
                    | (F.col("start") != F.col("first.start"))))
    return later.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))


def dedup_lines(docs: DataFrame, divisor: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove chunks of lines that came earlier in the corpus; the first occurrence stays.

    Lines end at ``\\n``; chunks end where the content says so (see
    :func:`chunk_rows`), so an inserted line shifts no boundary further on.
    Chunks of two lines or more whose 128-bit hash recurs anywhere are
    compared byte by byte.

    Returns every column of ``docs`` with the text replaced, plus n_lines and
    n_removed.  All rows come back: a text may become empty.  Null text stays
    null with 0 lines, an empty text is one line.  Rows that repeat id and
    text are treated alike.  Null ids come after all others.  If ``docs`` has
    columns of the new names, these get an underscore in front.
    """
    n_lines, n_removed, spans, lines = (free_name(docs, c) for c in ("n_lines", "n_removed", "line_spans", "lines"))
    k1, k2 = free_name(docs, "line_k1"), free_name(docs, "line_k2")
    gone = (repeated_chunks(docs, divisor, id_col, text_col)
            .select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans)))
    a, b = row_keys(docs[id_col], docs[text_col])
    d = docs.select("*", a.alias(k1), b.alias(k2)).join(gone, [k1, k2], "left")
    d = evaluated(d.withColumn(free_name(docs, "x"), text_lines(F.col(text_col))), free_name(docs, "x"), lines)
    starts, stops = F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["start"] + s["n"])
    kept = F.zip_with(F.concat(F.array(F.lit(0)), stops), F.concat(starts, F.array(F.size(lines))),
                      lambda i, j: F.slice(F.col(lines), i + 1, j - i))
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(kept), "\n"))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    return d.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
                    F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias(n_lines),
                    F.coalesce(removed, F.lit(0).cast("long")).alias(n_removed))
