"""Streams of raw pages and events.

The batch operators apply to streams as they are; here are the sources, the
exactly-once de-duplication by digest and the windowed counts with late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T

PAGE = "source_id string, source_url string, trust_level string, topic_tags array<string>, document_key string, html string, fetched_at timestamp"


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages from JSON files as they arrive."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def new_pages(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Each page's content once within the time that late copies may take."""
    keyed = pages.withColumn("sha256", T.sha256_hex(F.col("html").cast("binary")))
    return keyed.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["source_url", "sha256"])


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by window and keys; in a stream, windows close when the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "rows")


def write_documents(documents: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append documents by source until what is there has been read."""
    return documents.writeStream.format("parquet").partitionBy("source_id").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
