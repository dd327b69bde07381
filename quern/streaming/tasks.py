"""Task counters, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def count_tasks(events: DataFrame, key: Sequence[str], time: str, payload: str) -> DataFrame:
    """One row per key: occurrences, first and last time, and the latest payload."""
    return events.groupBy(*key).agg(F.count("*").alias("occurrences"), F.min(time).alias("created_at"), F.max(time).alias("last_seen_at"), F.max_by(payload, F.struct(time, payload)).alias("payload"))


def stream_tasks(events: DataFrame, key: Sequence[str], time: str, payload: str, sink, checkpoint: str) -> StreamingQuery:
    """Keep count_tasks up to date; sink gets each micro-batch of changed keys and its number."""
    counted = count_tasks(events, key, time, payload)
    return counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def merge_tasks(tasks: DataFrame, counted: DataFrame, key: Sequence[str]) -> DataFrame:
    """The task table (key, occurrences, created_at, last_seen_at, payload, status) after a batch of count_tasks.

    A key seen again adds up and takes the later payload; its status stays, so a closed task isn't opened again. New keys
    are open. What a micro-batch's sink writes as the next version of the table.
    """
    fields = ["occurrences", "created_at", "last_seen_at", "payload"]
    new = counted.select(*key, F.struct(*fields).alias("_new"))
    old = tasks.select(*key, F.struct(*fields).alias("_old"), "status")
    j = old.join(new, list(key), "full_outer")
    n = lambda side: F.coalesce(F.col(f"{side}.occurrences"), F.lit(0))
    later = F.when(F.coalesce(F.col("_new.last_seen_at") >= F.col("_old.last_seen_at"), F.col("_new").isNotNull()), F.col("_new.payload")).otherwise(F.col("_old.payload"))
    return j.select(*key, (n("_old") + n("_new")).alias("occurrences"), F.least("_old.created_at", "_new.created_at").alias("created_at"), F.greatest("_old.last_seen_at", "_new.last_seen_at").alias("last_seen_at"), later.alias("payload"), F.coalesce("status", F.lit("open")).alias("status"))


def within_retention(rows: DataFrame, time: str, now, days: int) -> DataFrame:
    return rows.where(F.col(time) > F.lit(now) - F.expr(f"interval {days} days"))
