"""URL rules: hashed host-suffix and path-prefix expressions, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# Most rules that are broadcast (about 100 bytes each); longer lists are joined by shuffle, salted.
BROADCAST_RULES = 200_000
SALTS = 32
# A rule's rank in one long: total length, then host length, then block over allow.
HOST_BITS = 24


def url_host(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # the length of the host keeps the two parts apart
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url of ``pages`` by ``rules`` (host, path, verdict ``allow`` or ``block``).

    A rule fits a url whose host is the rule's or a subdomain of it and whose
    path starts with the rule's.  The longest rule (host and path together)
    wins; of equally long ones that with the longer host; of two verdicts for
    one rule, block.  A url without a rule gets ``default``.

    Each url is expanded into its host suffixes times its path prefixes, both
    only at lengths that some rule has, so the expansion is bounded by the
    rules and not by the url.  Expressions meet rules on 32 bits of their
    SHA-256; a meeting counts only if the whole digests agree.

    Returns page_id, host, path, rule (host and path joined, null without one),
    verdict; one row per input row.  Null url or one without ``://``: host and
    path are empty and only ``default`` is left.  Null ids are kept.  Rows
    that repeat id and url all come back.  Rules with a null part are ignored;
    no rules or no pages: defaults only, no rows.  Other columns are not used.
    """
    spark = pages.sparkSession
    r = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
         .groupBy(ascii_lower(F.col("host")).alias("rh"), F.col("path").alias("rp"))
         .agg(F.max(F.col("verdict") == "block").alias("block")))
    r = r.select("*", _digest(F.col("rh"), F.col("rp")).alias("digest"))
    stats = r.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("rh", r"\."))).alias("labels"),
                  F.collect_set(F.length("rp")).alias("lengths")).first()
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    p = p.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))

    def known(values: list[int]) -> Column:
        return F.array(*[F.lit(int(v)) for v in sorted(values)]).cast("array<int>")

    # host suffixes by number of labels, path prefixes by length
    labels = F.filter(known(stats["labels"]), lambda n: n <= F.size(F.split("host", r"\.")))
    hosts = F.transform(labels, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    lengths = F.filter(known(stats["lengths"]), lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(
        lengths, lambda n: F.struct(h.alias("h"), F.col("path").substr(F.lit(1), n).alias("q")))))
    e = p.select("page_id", "url", F.posexplode_outer(pairs).alias("pos", "x"))
    e = e.select("page_id", "url", "pos", F.length("x.h").alias("hl"),
                 (F.length("x.h") + F.length("x.q")).alias("el"), _digest(F.col("x.h"), F.col("x.q")).alias("ed"))
    e = e.withColumn("ep", _prefix(F.col("ed")))
    r = r.select(_prefix(F.col("digest")).alias("prefix"), "digest", "block")
    meet = (F.col("ep") == F.col("prefix")) & (F.col("ed") == F.col("digest"))
    if stats["n"] <= BROADCAST_RULES:
        m = e.join(F.broadcast(r), meet, "left")
    else:  # expressions such as a top-level domain are hot: salt them, and repeat the rules
        e = e.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        r = r.withColumn("rs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        m = e.join(r, meet & (F.col("salt") == F.col("rs")), "left")
    rank = F.when(F.col("digest").isNotNull(),
                  ((F.shiftleft(F.col("el").cast("long"), HOST_BITS) + F.col("hl")) * 2 + F.col("block").cast("long")))
    # equal rows are counted and dealt out again; the rank is one long, so tasks combine before the shuffle
    best = m.groupBy("page_id", "url").agg(
        F.max(rank).alias("rank"), F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("n"))
    half = F.shiftright("rank", 1)
    b = best.select("page_id", "rank", "n", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                    half.bitwiseAND(F.lit((1 << HOST_BITS) - 1)).cast("int").alias("hl"),
                    F.shiftright(half, HOST_BITS).cast("int").alias("el"))
    rule = F.when(F.col("rank").isNotNull(), F.expr("concat(right(host, hl), left(path, el - hl))"))
    verdict = (F.when(F.col("rank").isNull(), F.lit(default))
               .when(F.col("rank") % 2 == 1, F.lit("block")).otherwise(F.lit("allow")))
    return b.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
                    F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).drop("i")
