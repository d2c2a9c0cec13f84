"""Incremental ingest of documents: an extension, as the batch engine's reference has no streams.

New files of a folder become sentences' chunks, appended once: a chunk seen before within the
watermark is dropped by its hash, and each micro-batch is one append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text


def document_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def chunk_stream(docs: DataFrame, key: str, most: int, overlap: int, ends: str, watermark: str = "1 hour") -> DataFrame:
    """Chunks with arrival time and hash, each hash once within the watermark."""
    arrived = docs.withColumn("text", F.coalesce("text", F.lit("")))
    chunks = text.chunks_by_size(arrived, key, most, overlap, ends)
    named = chunks.withColumn("hash", F.sha2("text", 256)).withColumn("arrived", F.current_timestamp())
    return named.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["hash"])


def append_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take all files that are there, then stop."""
    return chunks.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
