"""Documents from the text of printed pages.

Page text comes in as rows (the extraction of text from a file plugs in before);
running heads are found by how many pages of a document repeat a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import quality
from ..functions import text as T
from ..planning import lookup, once, small_enough

# Fixed value: the title of a file that has neither metadata nor a name
UNTITLED = "Untitled PDF"


def page_title(title: Column, url: Column) -> Column:
    """The title in a file's metadata, else the file's name in its URL, else Untitled PDF; cleaned."""
    path = F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    name = F.regexp_extract(F.rtrim(path, F.lit("/")), r"([^/]*)$", 1)
    return T.clean_page_text(F.coalesce(F.nullif(title, F.lit("")), F.nullif(name, F.lit("")), F.lit(UNTITLED)))


def page_lines(pages: DataFrame) -> DataFrame:
    """document, page_number, line_no, line: the cleaned lines that are not empty."""
    lines = pages.select("document", "page_number", F.posexplode(F.split("raw_text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1)).alias("line_no", "_line"))
    return once(lines, line=T.clean_page_line(F.col("_line"))).select("document", "page_number", "line_no", "line").filter("line <> ''")


def repeated_line_counts(lines: DataFrame) -> DataFrame:
    """document, line, repeats: on how many pages of a document a line is."""
    return lines.groupBy("document", "line").agg(F.count_distinct("page_number").alias("repeats"))


def page_documents(pages: DataFrame, min_chars: int = C.MIN_PAGE_CHARS) -> DataFrame:
    """A document for each page that has text of its own.

    pages: document, title, source_id, source_url, trust_level, topic_tags,
    document_key, page_number, raw_text. Boilerplate lines are dropped, then short
    pages and front and back matter.
    """
    lines = page_lines(pages)
    totals = pages.groupBy("document").agg(F.count_distinct("page_number").alias("_pages"))
    # a line is judged once a document, and only the lines that go are joined back
    counted = lookup(repeated_line_counts(lines), totals, ["document"], "line")
    gone = counted.filter(quality.boilerplate_line(F.col("line"), F.col("repeats"), F.col("_pages"))).select("document", "line")
    kept = lines.join(F.broadcast(gone) if small_enough(gone) else gone, ["document", "line"], "left_anti")
    whole = kept.groupBy("document", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("_lines"))
    texts = once(whole, text=T.clean_page_text(F.array_join("_lines", " "))).filter(F.length("text") >= min_chars)
    judged = once(texts, _matter=F.coalesce(quality.front_or_back_matter(F.col("page_number"), F.col("_lines"), F.col("text")), F.lit(False)))
    texts = judged.filter(~F.col("_matter")).drop("_matter")
    # a document has one set of fields; if its pages say different things, the smallest
    about = pages.groupBy("document").agg(F.min(F.struct("title", "source_id", "source_url", "trust_level", "topic_tags", "document_key")).alias("_a")).select("document", "_a.*")
    rows = lookup(texts, about, ["document"], "page_number")
    key = F.when(F.col("document_key").isNotNull(), T.slugify(F.col("document_key"))).otherwise(T.url_slug(F.col("source_url")))
    nothing = F.lit(None).cast("string")
    page = F.col("page_number").cast("string")
    return rows.withColumn("page_key", key).select(
        F.concat(T.slugify(F.col("source_id")), F.lit("__"), "page_key", F.lit("__page_"), F.format_string("%04d", F.col("page_number").cast("long"))).alias("doc_id"), nothing.alias("snapshot_id"), "source_id", "page_key", F.lit("pdf_page").alias("doc_kind"), nothing.alias("external_id"),
        "title", F.array(F.col("title"), F.concat(F.lit("Page "), page)).alias("section_path"), "source_url", nothing.alias("published_at"), nothing.alias("updated_at"), F.col("page_number").cast("long").alias("page_number"), "trust_level", "topic_tags", "text",
    )
