"""Aggregates kept up to date: partial results per part of a versioned table, merged for any range of parts.

A refresh compares the loads that make up each part of the source with those
that its partial results were made from, reads the parts that differ, and
replaces their partial results in one commit.  So an appended or replaced
month costs that month, not the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions as V

PART = "part"
# Size of the sketches: about 1 % of the rank for quantiles, 1.6 % for distinct counts (standard errors).
KLL_K, HLL_BITS = 200, 12


def refresh(spark: SparkSession, source: str, rollup: str, partial: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Bring the partial results at ``rollup`` up to date with the table at ``source``; the parts made anew.

    ``partial`` gets rows with their part in the column ``part`` and returns
    aggregates by ``part`` and whatever else.  Parts that the source has no
    more lose their results.
    """
    parts = V.manifest(spark, source)["parts"]
    now = V.manifest(spark, rollup)
    current = {p: [load for load, _ in entries] for p, entries in parts.items()}
    seen = {} if now is None else now["tags"]["made from"]["mark"]
    changed = sorted(p for p in {*current, *seen} if current.get(p) != seen.get(p))
    if changed or now is None:
        rows = V.read(spark, source, parts=changed, part_column=PART)
        V.commit(spark, rollup, partial(rows), F.col(PART), actions={p: "replace" for p in changed}, tag=("made from", current))
    return changed


def partials(spark: SparkSession, rollup: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The partial results of the parts from ``first`` to ``last``, both included; all without them."""
    names = [p for p in V.manifest(spark, rollup)["parts"] if (first is None or p >= first) and (last is None or p <= last)]
    return V.read(spark, rollup, parts=names)


# ------------------------------------------------------------------ profiles
def sketches(rows: DataFrame, quantiles_of=(), distinct_of=(), by=()) -> DataFrame:
    """Per part and group: rows, least and greatest value and a KLL sketch of each column of ``quantiles_of``, an HLL sketch of ``distinct_of``.

    A sketch has some kilobytes, however many rows it stands for, and
    sketches of parts merge to the sketch of all their rows.
    """
    aggs = [F.count("*").alias("rows")]
    for c in quantiles_of:
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias(f"{c}_kll")]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), HLL_BITS).alias(f"{c}_hll") for c in distinct_of]
    return rows.groupBy(PART, *by).agg(*aggs)


def profile(partial: DataFrame, quantiles_of=(), distinct_of=(), by=(), probabilities=(0.25, 0.5, 0.75)) -> DataFrame:
    """The profile of all rows behind ``partial`` (of :func:`sketches`): rows, <c>_min, <c>_max, <c>_q (array), <c>_distinct.

    Quantiles are null for a group without values.
    """
    aggs = [F.sum("rows").alias("rows")]
    out = ["rows"]
    for c in quantiles_of:
        aggs += [F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"),
                 F.kll_merge_agg_double(f"{c}_kll").alias(f"{c}_kll")]
        q = F.array(*[F.kll_sketch_get_quantile_double(f"{c}_kll", F.lit(float(p))) for p in probabilities])
        out += [f"{c}_min", f"{c}_max", F.when(F.col(f"{c}_min").isNotNull(), q).alias(f"{c}_q")]
    for c in distinct_of:
        aggs.append(F.hll_sketch_estimate(F.hll_union_agg(f"{c}_hll")).alias(f"{c}_distinct"))
        out.append(f"{c}_distinct")
    d = partial.groupBy(*by).agg(*aggs) if by else partial.agg(*aggs)
    return d.select(*by, *out)
