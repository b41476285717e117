"""Queries that write tables through the sinks and read them back through the sources.

They write below the folder that the executors share; what they wrote is deleted when
the session ends.
"""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling
from ..sources import catalog, files, raw, tables
from .queries import _SAID, query, table


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, deleted with the session; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "docloom-shared")
    folder = f"{named}/{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


_KEPT = "doc_id long, text string, section_path array<string>, source_id string, page_number long"


@query(f"select doc_id, text, section_path, source_id, page_number, array_to_string({_SAID}, ' > ') as section_path_text from documents")
def jsonl_round_trip(spark, folder):
    """All documents as lines of JSON and back, with their joined path."""
    path = f"{shared_folder(spark)}/documents"
    tables.write_jsonl(table(spark, folder, "documents").select("doc_id", "text", "section_path", "source_id", "page_number"), path)
    return tables.read_chunks(spark, path, _KEPT).select("doc_id", "text", "section_path", "source_id", "page_number", "section_path_text")


@query("select result_id, regexp_replace(answer_text, '\\r\\n?', chr(10), 'g') as answer_text, citations from generation_results_smoke_v1 where citations is not null and answer_text <> ''")
def csv_round_trip(spark, folder):
    """All answers, many of them of several lines, as a table of text and back."""
    path = f"{shared_folder(spark)}/answers"
    answers = table(spark, folder, "generation_results_smoke_v1").filter("citations is not null and answer_text <> ''").select("result_id", F.regexp_replace("answer_text", r"\r\n?", "\n").alias("answer_text"), "citations")
    tables.write_csv(answers, path)
    read = tables.read_csv(spark, path, "result_id long, answer_text string, citations string")
    return read.select("result_id", "answer_text", T.parse_list(F.col("citations")).alias("citations"))


@query("select snapshot_id, source_id, count(*) as num_docs, sum(length(text))::BIGINT as chars from documents group by all")
def documents_by_partition(spark, folder):
    """All documents written by snapshot and source, one snapshot written again, and counted from there."""
    path = f"{shared_folder(spark)}/documents"
    docs = table(spark, folder, "documents").select("doc_id", "text", "snapshot_id", "source_id")
    tables.write_documents(docs, path)
    last = docs.agg(F.max("snapshot_id").alias("snapshot_id"))
    tables.write_documents(docs.join(F.broadcast(last), "snapshot_id", "left_semi"), path)
    stored = spark.read.schema("doc_id long, text string, snapshot_id string, source_id string").parquet(path)
    return stored.groupBy("snapshot_id", "source_id").agg(F.count(F.lit(1)).alias("num_docs"), F.sum(F.length("text")).alias("chars"))


@query("select vec_id, snapshot_id, embedding from embedding_records where snapshot_id is not null and embedding is not null and len(list_filter(embedding, lambda x: not isfinite(x))) = 0")
def vectors_by_snapshot(spark, folder):
    """All finite vectors written by snapshot and read back."""
    path = f"{shared_folder(spark)}/vectors"
    rows = table(spark, folder, "embedding_records").filter("snapshot_id is not null and embedding is not null").filter(F.forall("embedding", lambda x: F.abs(x) < float("inf")))
    tables.write_snapshot(rows.select("vec_id", "snapshot_id", "embedding"), path)
    return spark.read.schema("vec_id long, snapshot_id string, embedding array<float>").parquet(path).select("vec_id", "snapshot_id", "embedding")


@query("select max(snapshot_id) as snapshot_id, 2::INT as num_selected_sources, (select count(*) from documents) as num_documents, 7::BIGINT as num_chunks from summary")
def manifest_of_snapshots(spark, folder):
    """A manifest with a row for each snapshot, and what the latest holds."""
    root = shared_folder(spark)
    count = table(spark, folder, "documents").count()
    for r in table(spark, folder, "summary").select("snapshot_id").collect():  # a row a snapshot
        catalog.append_snapshot(spark, root, {"snapshot_id": r[0], "selected_source_ids": ["a", "b"], "num_documents": count, "num_chunks": 7, "chunks_path": "chunks"})
    return catalog.freeze_summary(catalog.snapshots(spark, root)).select("snapshot_id", "num_selected_sources", "num_documents", "num_chunks")


@query("select query_id, sha256(query_text) as sha256, strlen(query_text)::BIGINT as byte_size, query_text as body from evaluation_queries_blueprint where query_text is not null and query_text <> ''")
def raw_bodies_round_trip(spark, folder):
    """All questions kept as raw pages, a file each with its metadata, and read back."""
    root = f"{shared_folder(spark)}/raw"
    asked = table(spark, folder, "evaluation_queries_blueprint").filter("query_text <> ''")
    fetched = asked.select(F.lit("web").alias("source_id"), F.concat(F.lit("https://site.example/"), "query_id").alias("url"), F.lit(True).alias("ok"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit("utf-8").alias("encoding"), F.encode("query_text", "UTF-8").alias("content"), F.lit("2030-01-01T00:00:00Z").alias("fetched_at"))
    files.write_bodies(raw.raw_items(fetched, "s1"), root).write.format("noop").mode("overwrite").save()
    about = raw.metadata(spark, root).select("item_id", "sha256", "byte_size", "encoding")
    bodies = raw.bodies(spark, root).select(F.element_at(F.split("path", "/"), -2).alias("item_id"), "content")
    return about.join(bodies, "item_id").select(F.upper("item_id").alias("query_id"), "sha256", "byte_size", raw.decoded(F.col("content"), F.col("encoding")).alias("body"))


@query("select doc_id from documents d where not exists (select 1 from doc_labels l where l.doc_id = d.doc_id and l.form is not null)")
def resumed_labels(spark, folder):
    """What is left to label: documents without a complete label."""
    done = table(spark, folder, "doc_labels").withColumn("ordinal", F.lit(1))
    return sampling.pending(table(spark, folder, "documents").select("doc_id"), sampling.complete_rows(done, ["doc_id"], ["form"]), ["doc_id"])
