"""Grouped summaries of sources, documents, chunks and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_summary(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source_id", "source_type", "trust_level").agg(F.count("item_id").alias("num_items"), F.sum("byte_size").alias("total_bytes"))


def documents_by_source(docs: DataFrame) -> DataFrame:
    """Documents and their median length by source, kind and trust."""
    return docs.filter(F.col("source_id").isNotNull()).groupBy("source_id", "doc_kind", "trust_level").agg(F.count(F.lit(1)).alias("num_docs"), F.median(F.length("text")).alias("median_chars"))


def chunks_by_source(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("source_id").isNotNull()).groupBy("source_id", "trust_level").agg(F.count(F.lit(1)).alias("num_chunks"), F.median("word_count").alias("median_words"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("num_rows"))


def topic_difficulty(queries: DataFrame, levels: tuple[str, ...] = ("basic", "intermediate", "advanced")) -> DataFrame:
    """Questions by topic, a column for each difficulty."""
    counts = [F.count_if(F.col("difficulty") == level).alias(level) for level in levels]
    return queries.groupBy("topic").agg(*counts)


def registry_overview(registry: DataFrame) -> DataFrame:
    """The sources with their lists counted or joined."""
    return registry.select("source_id", "type", "trust_level", F.size("seed_urls").alias("num_seed_urls"), F.array_join("allowed_domains", ", ").alias("allowed_domains"), F.array_join("topic_tags", ", ").alias("topic_tags"))
