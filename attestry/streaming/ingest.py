"""Exports that arrive in a folder, segmented into the blob store as a stream.

An addition of this engine: imports are batches otherwise. A micro-batch adds only blobs and recipes that aren't there,
so a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from attestry.sources import raw_store, sinks

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes all files that are there now and ends; called again, it takes the new ones."""

    def batch(rows: DataFrame, _: int) -> None:
        payloads = rows.select(F.sha2("content", 256).alias("payload_sha256"), "content").dropDuplicates(["payload_sha256"])
        parts = raw_store.segment(payloads).persist()
        try:
            sinks.append_blobs(parts.select("sha256", "bytes", "content"), f"{store}/blobs")
            recipe = raw_store.recipe(parts)
            fs, place = sinks._fs(spark, f"{store}/recipes")
            if fs.exists(place):
                known = spark.read.parquet(f"{store}/recipes").select("payload_sha256").distinct()
                recipe = recipe.join(known, "payload_sha256", "left_anti")
            recipe.write.mode("append").parquet(f"{store}/recipes")
        finally:
            parts.unpersist()

    source = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.json").load(folder)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
