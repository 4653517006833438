"""A corpus pipeline of five stages: quality, line chunks, near-duplicates, contamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns documents; :func:`run` writes each result as Parquet to
the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.llm.common import filter_rows, read_table, saved
from playlake.llm.contamination import contamination
from playlake.llm.lines import dedup_lines
from playlake.llm.minhash import near_duplicates
from playlake.llm.mixing import mix_documents
from playlake.llm.quality import score_quality

# No SQL: the model's floating-point sums and its n-gram tables are beyond it (see tests/llm/test_pipeline.py).
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not out of line with trusted text of their language."""
    scores = score_quality(docs, read_table(spark, sf_dir, "labels"))
    rejected = saved(scores.where("rejected").select("k1", "k2").distinct(), "rejected")
    return filter_rows(docs, rejected, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that an earlier document has; texts of which nothing is left go."""
    out = dedup_lines(docs)
    lines, removed = out.columns[-2:]
    out = out.where((F.col(removed) == 0) | (F.trim(F.col("text")) != "") | F.col("text").isNull())
    return out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
                          .cast("long")).drop(lines, removed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that with the smallest id.

    Of a group without ids, and of rows that repeat, one stays too; texts
    without words have no group and stay.
    """
    found = saved(near_duplicates(docs, shingle_words=5, percent=80)
                  .select("doc_id", "k1", "k2", "n_shingles", "group_id"), "near-duplicates")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2")
    best = found.where("n_shingles > 0").groupBy("group_id").agg(F.min(place).alias("x"), F.count("*").alias("m"))
    best = saved(best.select("x.k1", "x.k2", "m"), "kept")
    stay = best.select("k1", "k2").unionByName(found.where("n_shingles = 0").select("k1", "k2").distinct())
    kept = filter_rows(docs, stay, "left_semi")
    twice = found.where("n_shingles > 0").groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1")
    if twice.isEmpty():
        return kept
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(blank).unionByName(kept.where(~blank).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are windows of 13 words of benchmark items."""
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    bad = saved(found.where("contaminated").select("k1", "k2").distinct(), "contaminated")
    return filter_rows(docs, bad, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources: a row for each copy taken, with its number as ``copy``."""
    return mix_documents(docs, weights=(3, 1, 2), share=1.5, max_rate=2.0)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
