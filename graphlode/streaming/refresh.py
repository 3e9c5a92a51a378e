"""Incremental refresh: file events as a stream, debounced into micro-batches; the difference of hashes decides what to parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlode.operators.content import hash_diff
from graphlode.sources.files import scannable

EVENTS = "file_path string, event string"
DEBOUNCE = 2.0


def relevant(events: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Events (file_path, ...) of files that a scan takes."""
    return events.where(scannable(F.col("file_path"), list(ignore)))


def changed_paths(batch: DataFrame) -> DataFrame:
    """(file_path) of a batch, each once."""
    return batch.select("file_path").distinct()


def watch(events: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, debounce: float = DEBOUNCE, ignore: list[str] = (), once: bool = False) -> StreamingQuery:
    """Runs refresh(paths, batch id) on each interval's distinct paths. Batches are one after the other, so a refresh never
    overlaps the next; what comes meanwhile is in the next. once: takes what there is and ends."""

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = changed_paths(batch)
        if not paths.isEmpty():
            refresh(paths, batch_id)

    writer = relevant(events, ignore).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce} seconds")).start()


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of events that a watcher writes as JSON lines into a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def plan_update(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(file_path, status) by the hashes stored and those of now. A file stream tells neither deletes nor edits of a path
    it has seen, so this difference is what counts."""
    return hash_diff(stored, now)


def running_counts(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, kind, n, total): events (ts, kind, value) by tumbling window; rows later than delay are dropped."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "kind")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")
