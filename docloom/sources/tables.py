"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A row for each line of JSON; blank lines are passed over."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", "true").json(path)


#: White space belongs to the values, and quotation marks in them are doubled.
_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with a header whose values may span lines."""
    reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", "true")
    return reader.options(**_CSV, multiLine="true").csv(path)


def read_chunks(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_jsonl(spark, path, schema).withColumn("section_path_text", T.join_path(F.col("section_path")))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents as Parquet by snapshot and source; only the snapshots that are written are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id", "source_id").parquet(path)


def write_snapshot(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks or vectors as Parquet by snapshot."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table with a header; lists become JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode(mode).options(**_CSV).csv(path)


def vector_table(records: DataFrame) -> DataFrame:
    """What a vector store keeps of each record: flat fields, nulls made empty, the page number as it is."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "source_id", "page_key", "title", "section_path_text", "source_url", "trust_level", "topic_tags_text")]
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_index", "word_count", "char_count")]
    return records.select("chunk_id", *text, *numbers, "page_number", F.col("text").alias("document"), "embedding")


def text_dump(chunks: DataFrame, path: str) -> None:
    """All chunk texts, a blank line after each, one file a partition; within a file by id.

    The rows stay where they are: a dump is read as a whole, its files in any order.
    """
    chunks.sortWithinPartitions("chunk_id").select(F.concat("text", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def chunk_lookup(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors' records with their chunk's text and place, by chunk_id; null where there is no such chunk.

    What the records have themselves wins; a chunk_id that occurs again among the
    chunks counts once.
    """
    extra = [c for c in chunks.columns if c not in records.columns]
    return records.join(chunks.select("chunk_id", *extra).dropDuplicates(["chunk_id"]), "chunk_id", "left")
