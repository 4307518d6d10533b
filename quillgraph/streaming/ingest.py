"""Structured Streaming counterparts of ingestion: files land in a folder, micro-batches are merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import aggregates, ingest


def landing(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, at most `files` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (source, source_id) once within the watermark."""
    return stream.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["source", "source_id"])


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Episodes by source and day; late ones count up to the watermark."""
    by = stream.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", "1 day"), "source")
    return by.agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "source", "n")


def sliding_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    by = stream.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", "7 days", "1 day"), "source")
    return by.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "source", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Runs of a node's episodes with less than `gap` between them."""
    by = stream.withWatermark("occurred_at", delay).groupBy(F.session_window("occurred_at", gap), "node_id")
    return by.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "node_id", "n")


def upserting(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], tombstone: DataFrame, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into a table; a repeated batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        old = read()
        write(ingest.apply_upsert(old, ingest.upsert_outcomes(old, batch, tombstone)))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_interactions(stream: DataFrame) -> DataFrame:
    """Running totals of each (node, channel), for update mode."""
    seen = stream.select("node_id", aggregates.channel(F.col("source")).alias("channel"), "occurred_at")
    return seen.groupBy("node_id", "channel").agg(F.count("*").alias("interactions"), F.max("occurred_at").alias("last_at"))
