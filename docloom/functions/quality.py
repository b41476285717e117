"""Heuristics that tell low-signal sections, pages, documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..planning import once
from . import constants as C
from .text import collapse_whitespace, flat_word_count, word_count


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def low_signal_section(path: Column, text: Column) -> Column:
    return F.coalesce(F.array_join(path, " > "), F.lit("")).rlike(C.LOW_SIGNAL_HEADING) | text.rlike(C.LOW_SIGNAL_TEXT)


def url_heavy(text: Column) -> Column:
    """Two URLs in a short text or five in any."""
    urls = _count(text, C.URL)
    return (urls >= 2) & ((urls >= 5) | (flat_word_count(collapse_whitespace(text)) <= 80))


def index_like(text: Column) -> Column:
    """Eight page references and the word index or see also."""
    lowered = F.lower(text)
    return (_count(text, C.PAGE_REFERENCE) >= 8) & (lowered.contains("index") | lowered.contains("see also"))


def back_matter(lowered: Column) -> Column:
    """Back matter by its phrases; plain searches first, the pattern only where one of them hits."""
    some = lowered.contains(C.BACK_MATTER_PARTS[0])
    for part in C.BACK_MATTER_PARTS[1:]:
        some = some | lowered.contains(part)
    return some & lowered.rlike(C.BACK_MATTER)


def low_signal_chunk(text: Column) -> Column:
    flat = collapse_whitespace(text)
    return ((flat_word_count(flat) <= 15) & flat.rlike(C.REPORT_HEADER)) | url_heavy(flat) | index_like(flat) | back_matter(F.lower(flat))


def with_signals(df: DataFrame, text: str, flat: bool = False) -> DataFrame:
    """df with _flat, _url_heavy, _index_like and _low_signal of a text column, each rule worked out once a row.

    flat: the text's white space is collapsed already. The rules of a null text are null.
    """
    base = once(df, _flat=F.col(text) if flat else collapse_whitespace(F.col(text)))
    lowered = F.lower("_flat")
    urls = F.when(lowered.contains("http") | lowered.contains("www."), _count(F.col("_flat"), C.URL)).otherwise(0)
    counted = once(base, _lower=lowered, _urls=urls, _words=flat_word_count(F.col("_flat")), _refs=_count(F.col("_flat"), C.PAGE_REFERENCE))
    heavy = (F.col("_urls") >= 2) & ((F.col("_urls") >= 5) | (F.col("_words") <= 80))
    indexed = (F.col("_refs") >= 8) & (F.col("_lower").contains("index") | F.col("_lower").contains("see also"))
    header = (F.col("_words") <= 15) & F.col("_flat").rlike(C.REPORT_HEADER)
    ruled = once(counted, _url_heavy=heavy, _index_like=indexed, _other=header | back_matter(F.col("_lower")))
    return ruled.withColumn("_low_signal", F.col("_other") | F.col("_url_heavy") | F.col("_index_like")).drop("_lower", "_urls", "_refs", "_words", "_other")


def low_signal_path(path: Column) -> Column:
    return F.coalesce(F.array_join(path, " > "), F.lit("")).rlike(C.LOW_SIGNAL_SECTION)


def low_signal_document(path: Column, text: Column) -> Column:
    return low_signal_path(path) | low_signal_chunk(F.coalesce(text, F.lit("")))


def boilerplate_line(line: Column, repeats: Column, pages: Column) -> Column:
    """Page numbers, rules, leaders, running heads: by their form or by how many pages repeat them."""
    lowered = F.lower(line)
    share = lambda least, part: F.greatest(F.lit(least), F.floor(pages / part))
    # counts and lengths first, patterns only for the lines that are left
    return (
        ((F.length(line) <= 120) & (repeats >= share(5, 8))) | (F.length(line).between(1, 14) & (repeats >= share(3, 10)))
        | line.contains("...") | line.rlike(C.PAGE_ONLY) | line.rlike(C.PUNCT_ONLY)
        | ((lowered.contains("u/oo/") | lowered.contains("pp-22") | lowered.contains("august 2022")) & lowered.rlike(C.REPORT_HEADER))
        | ((repeats >= share(3, 12)) & lowered.rlike(C.AGENCY))
    )


def _head(lines: Column, n: int) -> Column:
    return F.array_join(F.slice(lines, 1, n), " ")


def contents_page(lines: Column) -> Column:
    leaders = F.size(F.filter(lines, lambda x: x.rlike(C.DOT_LEADER)))
    short = F.size(F.filter(lines, lambda x: word_count(x) <= 10))
    return F.lower(_head(lines, 6)).contains("contents") & ((leaders >= 2) | (short >= 8))


def index_page(text: Column) -> Column:
    lowered = F.lower(text)
    return (lowered.contains("index |") | lowered.startswith("index ")) & ((_count(text, C.PAGE_REFERENCE) >= 8) | lowered.contains("see also"))


def references_page(lines: Column, text: Column) -> Column:
    lowered = F.lower(text)
    return _head(lines, 4).rlike(C.REFERENCES) & ((_count(lowered, "https?://") >= 2) | (_count(lowered, "doi") >= 2) | (_count(text, r"[\[\]]") >= 6))


def abbreviations_page(lines: Column, text: Column) -> Column:
    shouted = F.filter(F.split(collapse_whitespace(text), " ", -1), lambda t: (t == F.upper(t)) & (t != F.lower(t)) & F.length(t).between(2, 8))
    headed = _head(lines, 4).rlike(C.ABBREVIATIONS)
    return F.when(headed, F.size(shouted) >= 12).otherwise(False)  # the heading first, it is rare


def publisher_matter(page: Column, text: Column) -> Column:
    lowered = F.lower(text)
    early = (page <= 10) & ((lowered.contains("copyright ©") & lowered.contains("packt publishing")) | lowered.contains("for my lovely wife"))
    return lowered.rlike(C.BOOK_BACK_MATTER) | ((page <= 12) & lowered.rlike(C.PUBLISHER_FRONT_MATTER)) | early


def vendor_back_matter(page: Column, text: Column) -> Column:
    lowered = F.lower(text)
    return ((page >= 16) & lowered.contains("copyright ©")) | ((page >= 15) & lowered.rlike(C.VENDOR_MARKETING))


def front_or_back_matter(page: Column, lines: Column, text: Column) -> Column:
    """Covers, contents, indexes, references and the like, by page number and text."""
    lowered = F.lower(text)
    cover = (page == 1) & lowered.contains("cybersecurity technical report") & lowered.contains("kubernetes hardening guid")
    opening = (page <= 8) & (
        lowered.startswith("notices and history") | lowered.contains("document change history") | lowered.startswith("publication information")
        | lowered.startswith("figures ") | lowered.rlike(C.THESIS_FRONT_MATTER)
    )
    preface = lowered.startswith("preface ") | (lowered == "preface")
    return cover | contents_page(lines) | index_page(text) | references_page(lines, text) | lowered.rlike(C.COLOPHON) | abbreviations_page(lines, text) | publisher_matter(page, text) | vendor_back_matter(page, text) | opening | preface
