"""Parsing of fetched items by the type of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import feed, html, pages

TYPES = ("html", "pdf", "json_feed")


def parse_items(items: DataFrame) -> DataFrame:
    """The documents of all items, each parsed as its source_type says.

    items: source_id, source_type, source_url, trust_level, topic_tags,
    document_key, title (of a printed file's metadata), body (text of html and
    json_feed), page_texts (array of a printed file's pages). An unknown type is an
    error; a null body or no pages give no documents.
    """
    known = F.coalesce(F.col("source_type").isin(*TYPES), F.lit(False))
    checked = items.withColumn("source_type", F.when(known, F.col("source_type")).otherwise(F.raise_error(F.concat(F.lit("unknown source type: "), F.coalesce("source_type", F.lit("null"))))))
    about = ("source_id", "source_url", "trust_level", "topic_tags", "document_key")
    of = lambda kind: checked.filter(F.col("source_type") == kind)
    printed = of("pdf").select(
        F.concat_ws("|", "source_id", F.coalesce("document_key", "source_url")).alias("document"), pages.page_title(F.col("title"), F.col("source_url")).alias("title"), *about, F.posexplode("page_texts").alias("_at", "raw_text")
    ).withColumn("page_number", F.col("_at") + 1).drop("_at")
    parsed = [html.sections(of("html").select(*about, F.col("body").alias("html"))), pages.page_documents(printed), feed.feed_items(of("json_feed").select(*about, F.col("body").alias("payload")))]
    out = parsed[0]
    for part in parsed[1:]:
        out = out.unionByName(part)
    return out
