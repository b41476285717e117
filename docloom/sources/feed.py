"""Documents from JSON feeds of advisories, all in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

_ITEM = "struct<id:string,summary:string,content_text:string,status:string,date_published:string,url:string,external_url:string>"
FEED = f"struct<title:string,description:string,_kubernetes_io:struct<updated_at:string>,items:array<{_ITEM}>>"
# Fixed value: the title of a feed that names none
DEFAULT_TITLE = "Kubernetes Official CVE Feed"


def _given(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def feed_items(feeds: DataFrame) -> DataFrame:
    """A document for each item of each feed.

    feeds: source_id, source_url, trust_level, topic_tags, document_key, payload
    (JSON text). Items of fewer than 40 characters and payloads that are no JSON
    give none.
    """
    rows = feeds.withColumn("_f", F.from_json("payload", FEED)).select("*", F.explode("_f.items").alias("_i"))
    flat = lambda c: T.collapse_whitespace(F.coalesce(c, F.lit("")))
    rows = rows.withColumn("_id", T.collapse_whitespace(_given(F.col("_i.id"), F.lit("unknown_cve")))).withColumn("_summary", flat(F.col("_i.summary")))
    status, content = flat(F.col("_i.status")), flat(F.col("_i.content_text"))
    text = F.concat_ws(" ", F.concat(F.lit("CVE ID: "), "_id"), F.when(F.col("_summary") != "", F.concat(F.lit("Summary: "), "_summary")), F.when(status != "", F.concat(F.lit("Status: "), status)), F.nullif(content, F.lit("")))
    key = F.when(F.col("document_key").isNotNull(), T.slugify(F.col("document_key"))).otherwise(T.url_slug(F.col("source_url")))
    path = F.array_compact(F.array("_id", F.nullif("_summary", F.lit(""))))
    title = T.collapse_whitespace(_given(F.col("_f.title"), F.col("_f.description"), F.lit(DEFAULT_TITLE)))
    rows = rows.withColumn("text", T.collapse_whitespace(text)).withColumn("page_key", key).filter(F.length("text") >= C.MIN_FEED_CHARS)
    return rows.select(
        F.concat_ws("__", T.slugify(F.col("source_id")), "page_key", T.slugify(F.col("_id"))).alias("doc_id"), F.lit(None).cast("string").alias("snapshot_id"), "source_id", "page_key", F.lit("cve_feed_item").alias("doc_kind"), F.col("_id").alias("external_id"),
        title.alias("title"), path.alias("section_path"), _given(F.col("_i.external_url"), F.col("_i.url"), F.col("source_url")).alias("source_url"), F.col("_i.date_published").alias("published_at"), F.col("_f._kubernetes_io.updated_at").alias("updated_at"),
        F.lit(None).cast("long").alias("page_number"), "trust_level", "topic_tags", "text",
    )
