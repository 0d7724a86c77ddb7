"""Structured Streaming: memories kept up to date as chunks arrive, and windowed counts of events.

An extension: the record model has no streams of its own, only append-only memories and resumable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.memory import new_corrections


def event_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) by tumbling window; on a stream, rows later than the watermark are dropped."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark(time, late)
    g = e.groupBy(F.window(time, window).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), kind, "n", "total")


def keep_corrections(chunks: DataFrame, memory_path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the memory what each batch of chunks adds; a repeated batch adds nothing, as its keys are there."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        schema = "chunk_id bigint, source string, draft string, final string"
        memory = spark.read.schema(schema).option("ignoreMissingFiles", "true").json(memory_path)
        added = new_corrections(batch.select("chunk_id", "source", "draft", "final", "flags"), memory, "chunk_id")
        added.select("chunk_id", "source", "draft", "final").write.mode("append").json(memory_path)

    return chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
