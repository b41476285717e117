"""The manifest of snapshots and the pointer to the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = (
    "snapshot_id string, selected_source_ids array<string>, num_sources long, num_items long, num_documents long, num_chunks long, num_embedding_records long, "
    "chunks_path string, chunk_method string, chunk_config struct<max_words:int,overlap_words:int,min_words:int>, embedding_model string, embedding_dimension int"
)


def append_snapshot(spark: SparkSession, root: str, row: dict) -> None:
    """Add a snapshot to the manifest; paths in it are relative to the root."""
    if any(isinstance(v, str) and k.endswith("_path") and v.startswith("/") for k, v in row.items()):
        raise ValueError("paths in the manifest are relative to its folder")
    spark.createDataFrame([row], SNAPSHOT).coalesce(1).write.mode("append").json(f"{root}/snapshots")


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(f"{root}/snapshots")


def latest(manifest: DataFrame) -> DataFrame:
    """The row of the latest snapshot."""
    row = F.max_by(F.struct(*manifest.columns), "snapshot_id")
    return manifest.agg(row.alias("_r")).filter("_r is not null").select("_r.*")


def freeze_summary(manifest: DataFrame) -> DataFrame:
    """One row that says what the latest snapshot holds."""
    return latest(manifest).select("snapshot_id", F.size("selected_source_ids").alias("num_selected_sources"), "num_documents", "num_chunks", "num_embedding_records", "chunk_method", "embedding_model", "embedding_dimension")
