"""Structured Streaming over the same transformations: documents as they arrive, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_by_rules


def stream_documents(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet documents of a folder, as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def citations_of_stream(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rule extractor's spans: stateless, so a stream needs no watermark for it."""
    return extract_by_rules(documents, doc, text)


def windowed_counts(events: DataFrame, kind: str, by: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Counts per window: tumbling or sliding windows, or sessions of a user. Rows later than `late` are left out by
    the watermark, which also bounds the state."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    at = {"tumbling": F.window("ts", "1 day"), "sliding": F.window("ts", "1 day", "12 hours"), "session": F.session_window("ts", "30 minutes")}[kind]
    keys = [by, "user_id"] if kind == "session" else [by]
    out = rows.groupBy(at.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n", "total")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there, then ends. The sink gets each batch and its number; one that overwrites by number
    makes replays after a failure harmless."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
