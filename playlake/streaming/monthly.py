"""Incremental load of a raw-CSV landing folder with Structured Streaming.

``trigger(availableNow=True)`` processes every file not yet seen (the
checkpoint remembers which), in micro-batches, then stops.  Each batch's
clean rows are one load of a versioned staging table, tagged by the batch, so
that a replayed batch is not staged twice.  Then the days that the batch
touches are nested again from all staged rows of these days and replace these
days of the versioned facts table in one commit: which files share a batch
does not show in the result, a reader never sees half a batch, and a batch
without valid rows changes nothing.  Sequences lie within a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ingest as IG
from ..schemas import raw_string_schema
from ..sources import versions as V


def _day(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def load_landing(spark: SparkSession, landing: str, columns, table_path: str, checkpoint: str,
                 spec: IG.IngestSpec = IG.PITCH_SPEC, max_files_per_trigger: int = 16, multi_line: bool = False):
    """Run the stream to completion; returns the finished StreamingQuery.

    The table is read by ``sources.versions.read``; staged rows are kept in
    ``<table_path>_staged``.  ``multi_line`` allows
    quoted newlines, at the price of one task per file.
    """
    stream = (spark.readStream.schema(raw_string_schema(columns))
              .option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
              .option("maxFilesPerTrigger", max_files_per_trigger).csv(landing))
    staged = f"{table_path}_staged"

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        clean, _ = IG.clean(batch, spec)
        writer = f"stream {checkpoint}"
        now = V.commit(spark, staged, clean, _day(spec.date_col), tag=(writer, epoch_id))
        load = now["tags"][writer]["load"]
        days = sorted(p for p, entries in now["parts"].items() if any(x == load for x, _ in entries))
        facts = IG.nest(V.read(spark, staged, parts=days), spec)
        if spec.partition_col not in facts.columns:
            facts = facts.withColumn(spec.partition_col, facts[spec.date_col])
        V.commit(spark, table_path, facts.hint("rebalance", spec.partition_col), _day(spec.partition_col),
                 actions={d: "replace" for d in days}, default="replace")

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
