"""Fetching pages and keeping them as immutable snapshots."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

FETCHED = "source_id string, url string, ok boolean, status_code int, content_type string, encoding string, content binary, fetched_at string, error_type string, error_message string"

#: Header sets that are tried in turn; only a refusal (403) leads to the next.
HEADERS = ({"User-Agent": "Mozilla/5.0 (compatible; docloom)", "Accept": "text/html,application/json,application/pdf;q=0.9,*/*;q=0.8"}, {"User-Agent": "docloom"})


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def snapshot_id(moment: datetime | None = None) -> str:
    return (moment or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H%M%SZ")


def open_url(url: str, timeout: float = 30) -> tuple[int, str | None, str | None, bytes]:
    """Status, content type, encoding and body of a URL."""
    for i, headers in enumerate(HEADERS):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                return r.status, r.headers.get_content_type(), r.headers.get_content_charset(), r.read()
        except urllib.error.HTTPError as e:
            if e.code != 403 or i + 1 == len(HEADERS):
                raise
    raise AssertionError


def fetch(urls: DataFrame, opener: Callable[[str], tuple[int, str | None, str | None, bytes]] = open_url) -> DataFrame:
    """A row for each URL (source_id, url, allowed_domains): its body, or the error.

    URLs outside the allowed domains are errors and are not opened.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, url, allowed in zip(batch["source_id"], batch["url"], batch["_allowed"]):
                row = {"source_id": source, "url": url, "ok": False, "status_code": None, "content_type": None, "encoding": None, "content": None, "fetched_at": now(), "error_type": None, "error_message": None}
                try:
                    if not allowed:
                        raise ValueError(f"domain not allowed: {url}")
                    row["status_code"], row["content_type"], row["encoding"], row["content"] = opener(url)
                    row["ok"] = True
                except Exception as e:  # noqa: BLE001 - whatever a URL does becomes its row
                    row["error_type"], row["error_message"] = type(e).__name__, str(e)
                rows.append(row)
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")])
            yield frame.astype({"status_code": "Int32"})

    checked = urls.select("source_id", "url", F.coalesce(T.domain_allowed(F.col("url"), F.col("allowed_domains")), F.lit(False)).alias("_allowed"))
    return checked.mapInPandas(read, FETCHED)


def failures(fetched: DataFrame, snapshot: str) -> DataFrame:
    return fetched.filter(~F.col("ok")).select(F.lit(snapshot).alias("snapshot_id"), "source_id", F.col("url").alias("requested_url"), "error_type", "error_message")


def raw_items(fetched: DataFrame, snapshot: str) -> DataFrame:
    """What a snapshot keeps of each fetched page: the body with its size, digest and extension."""
    good = fetched.filter("ok")
    return good.select(F.lit(snapshot).alias("snapshot_id"), "source_id", T.url_slug(F.col("url")).alias("item_id"), "url", "fetched_at", "status_code", "content_type", "encoding", T.sha256_hex(F.col("content")).alias("sha256"), F.octet_length("content").cast("long").alias("byte_size"), T.infer_extension(F.col("content_type"), F.col("url")).alias("extension"), "content")


def decoded(content: Column, encoding: Column) -> Column:
    """The body as text by its recorded encoding, UTF-8 without one."""
    name = F.upper(F.coalesce(encoding, F.lit("UTF-8")))
    return F.when(name.isin("ISO-8859-1", "LATIN-1", "LATIN1", "WINDOWS-1252"), F.decode(content, "ISO-8859-1")).when(name.isin("UTF-16"), F.decode(content, "UTF-16")).otherwise(F.try_validate_utf8(content.cast("string")))


def bodies(spark: SparkSession, path: str, glob: str = "body.*") -> DataFrame:
    """path, content of the kept bodies, below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of kept pages, a JSON file each."""
    schema = "snapshot_id string, source_id string, item_id string, url string, requested_url string, fetched_at string, status_code int, content_type string, encoding string, sha256 string, byte_size long, local_body_path string, headers map<string,string>"
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").json(path)
