"""Structured Streaming ingest: links queued once, notes turned into chunks batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.chunking import all_chunks
from ..sources.vault import note_segments, parse_notes


def queued_links(links: DataFrame, *, time: str = "at", delay: str = "1 hour") -> DataFrame:
    """Links of a stream (url, source, at) of a known platform, each once within the delay."""
    known = links.withColumn("platform", T.platform_of(F.col("url"))).where(F.col("platform").isNotNull())
    return known.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def arrivals(links: DataFrame, *, time: str = "at", delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Links a platform and window."""
    return links.withWatermark(time, delay).groupBy(F.window(time, width), T.platform_of(F.col("url")).alias("platform")).agg(F.count("*").alias("n"))


def note_stream(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, mtime_ms, raw) of notes as they appear below the platforms' folders."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "video.md").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.unix_millis("modificationTime").alias("mtime_ms"), F.decode("content", "UTF-8").alias("raw"))


def ingest(notes: DataFrame, chunks_path: str, checkpoint: str, *, buckets: int = 64, compat: bool = False) -> StreamingQuery:
    """Writes each batch's chunks, all of a video's at once; the latest batch of a video counts when reading.

    A batch that runs again overwrites what it wrote before, so results are exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        videos = parse_notes(batch)
        rows = all_chunks(videos, note_segments(videos), compat=compat)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets))).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(chunks_path)

    return notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, chunks_path: str) -> DataFrame:
    """Each video's chunks of the last batch that had it."""
    rows = spark.read.parquet(chunks_path)
    last = rows.groupBy("video_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["video_id", "batch"])
