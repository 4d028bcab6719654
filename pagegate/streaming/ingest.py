"""Scan append and progress counts on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagegate.sources.stores import append_new
from pagegate.sources.versioned import upsert

# Kinds of progress event.
EVENT_KINDS = (
    "scan.started", "page.started", "rule.started", "rule.completed", "finding.created", "page.completed", "scan.completed",
)


def append_scans(scans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends scan records as they arrive. A record already stored is skipped, so a batch that is
    replayed after a failure adds nothing twice."""
    return (
        scans.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, "scan_id"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distinct_scans(scans: DataFrame, late: str = "1 day") -> DataFrame:
    """Scan records once each, remembering ids for as long as a repeat may come late."""
    return scans.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["scan_id"])


def progress(events: DataFrame) -> DataFrame:
    """Events per scan and kind, updated as they come. `events(scan_id, kind)`, kind from EVENT_KINDS."""
    return events.groupBy("scan_id", "kind").agg(F.count("*").alias("n"))


def keep_progress(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Progress counts in a versioned table: each micro-batch writes the counts that it changed and no others."""
    return (
        progress(events).writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: upsert(batch, store, ["scan_id", "kind"], n))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
