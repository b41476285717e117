"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ENRICH_BELOW_WORDS, MIN_PROXY_SENTENCE, OUTPUT_REQUIREMENTS, QUERY_PREFIX, SENTENCE_START, SPACE, SPACE_BUT_BLANK, TOPIC_KEYWORDS

_SEPARATOR = "\x01"


def _empty() -> Column:
    return F.array().cast("array<string>")


def collapse_whitespace(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    # single blanks, which are most of it, are passed over
    return F.btrim(F.regexp_replace(text, f"{SPACE}{{2,}}|{SPACE_BUT_BLANK}", " "))


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single underscores, or untitled."""
    slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled"))


def url_slug(url: Column) -> Column:
    """The slug of a URL's path and query; root without a path."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.btrim(F.regexp_extract(rest, r"^([^?#]*)", 1), F.lit("/"))
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    return slugify(F.concat(F.coalesce(F.nullif(path, F.lit("")), F.lit("root")), F.when(query != "", F.concat(F.lit("_"), query)).otherwise("")))


def url_host(url: Column) -> Column:
    """The lower-case host of a URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain_allowed(url: Column, domains: Column) -> Column:
    """Whether the host is one of the domains or below one."""
    host = url_host(url)
    return F.exists(domains, lambda d: (host == F.lower(d)) | host.endswith(F.concat(F.lit("."), F.lower(d))))


def infer_extension(content_type: Column, url: Column) -> Column:
    """.html, .json or .pdf by content type, else the URL's suffix, else .bin."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    path = F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.when(kind.contains("html"), ".html").when(kind.contains("json"), ".json").when(kind.contains("pdf"), ".pdf").otherwise(F.coalesce(F.nullif(suffix, F.lit("")), F.lit(".bin")))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def _tight_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+([.,;:!?])", "$1")


def clean_html_text(text: Column) -> Column:
    """Text of markup without anchor signs, trailing dashes and loose white space."""
    opened = F.regexp_replace(text, f"{SPACE}*¶{SPACE}*", " ")
    return _tight_punctuation(collapse_whitespace(F.regexp_replace(opened, f"{SPACE}*--+{SPACE}*$", "")))


def clean_page_text(text: Column) -> Column:
    """Text of a printed page: ligatures spelt out, hyphenation joined, white space single."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\x17"), F.lit(" ")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    joined = F.regexp_replace(plain, f"(?<=[A-Za-z])-{SPACE}+(?=[A-Za-z])", "")
    return _tight_punctuation(F.btrim(F.regexp_replace(collapse_whitespace(joined), f"{SPACE}*--+{SPACE}*$", "")))


def clean_page_line(line: Column) -> Column:
    return clean_page_text(F.replace(line, F.lit("\x00"), F.lit(" ")))


def dedupe_consecutive(items: Column) -> Column:
    """Cleaned, non-empty items without those equal to the one before."""
    said = F.filter(F.transform(items, clean_html_text), lambda x: x != "")
    # said is bound as an entry of a list: written out within the filter, all items would be cleaned again for each
    kept = F.transform(F.array(said), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))
    return F.get(kept, F.lit(0))


def _split_before_start(flat: Column, ends: str) -> Column:
    # white space is single, so the parts need no trimming but at the text's ends
    return F.filter(F.split(flat, f"(?<={ends}) (?={SENTENCE_START})", -1), lambda x: x != "")


def split_sentences(text: Column) -> Column:
    """Sentences: split after . ! ? where a capital, digit, bracket or quote follows."""
    return flat_sentences(collapse_whitespace(text))


def flat_sentences(flat: Column) -> Column:
    """The same of a text whose white space is collapsed already."""
    return F.coalesce(_split_before_start(flat, "[.!?]"), _empty())


def split_clauses(text: Column) -> Column:
    """Clauses: the same after ; and :"""
    return flat_clauses(collapse_whitespace(text))


def flat_clauses(flat: Column) -> Column:
    return F.coalesce(_split_before_start(flat, "[;:]"), _empty())


def proxy_sentences(text: Column) -> Column:
    """Sentences of some length: split after . ! ? before any white space; a null text has none."""
    parts = F.split(text, f"(?<=[.!?]){SPACE}+", -1)
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""))
    return F.coalesce(F.filter(trimmed, lambda x: F.length(x) >= MIN_PROXY_SENTENCE), _empty())


def words(text: Column) -> Column:
    """The words between white space."""
    flat = collapse_whitespace(text)
    return F.when(flat.isNull() | (flat == ""), _empty()).otherwise(F.split(flat, " ", -1))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def flat_word_count(flat: Column) -> Column:
    """Words of a text whose white space is collapsed already."""
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1)


def join_path(path: Column) -> Column:
    """The cleaned, non-empty entries of a path joined by ' > '; empty for a null path."""
    return F.coalesce(F.array_join(F.filter(F.transform(path, collapse_whitespace), lambda x: x != ""), " > "), F.lit(""))


def context_prefix(path: Column) -> Column:
    """'Section: a > b. ' from the last two distinct entries of a path, or nothing."""
    said = F.filter(F.transform(path, collapse_whitespace), lambda x: x != "")
    lowered = F.transform(said, F.lower)
    first = F.filter(said, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    tail = F.slice(first, F.greatest(F.size(first) - 1, F.lit(1)), 2)
    return F.when(F.size(first) > 0, F.concat(F.lit("Section: "), F.array_join(tail, " > "), F.lit(". "))).otherwise("")


def enrich_short_text(path: Column, text: Column, below: int = ENRICH_BELOW_WORDS) -> Column:
    """The text, with its context in front if it is short and does not begin with it."""
    return enrich_flat_text(path, collapse_whitespace(text), below)


def enrich_flat_text(path: Column, flat: Column, below: int = ENRICH_BELOW_WORDS) -> Column:
    """The same of a text whose white space is collapsed already."""
    prefix = F.coalesce(context_prefix(path), F.lit(""))
    told = F.btrim(F.replace(F.lower(prefix), F.lit("section: "), F.lit("")))
    keep = (flat_word_count(flat) >= below) | (prefix == "") | F.startswith(F.lower(flat), told)
    return F.when(keep, flat).otherwise(F.concat(prefix, flat))


def retrieval_text(title: Column, path: Column, text: Column) -> Column:
    """Title, section and content on lines of their own, as far as there are any."""
    parts = [(label, collapse_whitespace(value)) for label, value in (("Title", title), ("Section", join_path(path)), ("Content", text))]
    return F.concat_ws("\n", *(F.when(value != "", F.concat(F.lit(f"{label}: "), value)) for label, value in parts))


def topic_words(topic: Column) -> Column:
    return F.replace(topic, F.lit("_"), F.lit(" "))


def topic_keywords(topic: Column) -> Column:
    """The keywords of a topic; of an unknown one, its words."""
    known = F.create_map(*(x for t, k in TOPIC_KEYWORDS.items() for x in (F.lit(t), F.array(*map(F.lit, k)))))
    return F.coalesce(F.try_element_at(known, topic), F.split(topic_words(topic), " ", -1))


def enriched_query(topic: Column, difficulty: Column, query: Column, prefix: str = QUERY_PREFIX) -> Column:
    """The question with its topic, difficulty and keywords spelt out."""
    return F.concat(F.lit(f"{prefix} Topic: "), topic_words(topic), F.lit(". Difficulty: "), difficulty, F.lit(". Relevant concepts: "), F.array_join(topic_keywords(topic), ", "), F.lit(". Question: "), query)


def context_block(chunks: Column) -> Column:
    """A block of lines per chunk (struct of chunk_id, source_id, section_path_text, chunk_text), apart by blank lines."""
    block = F.transform(chunks, lambda c: F.concat(F.lit("Chunk ID: "), c["chunk_id"], F.lit("\nSource ID: "), c["source_id"], F.lit("\nSection: "), F.coalesce(c["section_path_text"], F.lit("")), F.lit("\nText: "), c["chunk_text"]))
    return F.array_join(block, "\n\n")


def prompt(query: Column, chunks: Column) -> Column:
    """The question, the citable ids, the requirements and the context."""
    ids = F.array_join(F.transform(chunks, lambda c: c["chunk_id"]), ", ")
    return F.concat(F.lit("User question:\n"), query, F.lit("\n\nAllowed citation chunk IDs:\n"), ids, F.lit(f"\n\nOutput requirements:\n{OUTPUT_REQUIREMENTS}\n\nRetrieved context:\n"), context_block(chunks), F.lit("\n"))


def evaluation_context(chunks: Column) -> Column:
    """What an answer is judged against: source, section and content of each chunk."""
    block = F.transform(chunks, lambda c: F.concat(F.lit("Source: "), c["source_id"], F.lit("\nSection: "), F.coalesce(c["section_path_text"], F.lit("")), F.lit("\nContent: "), c["chunk_text"]))
    return F.array_join(block, "\n\n")


def extract_citations(answer: Column) -> Column:
    """The entries of the last bracketed list, none without one."""
    last = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"\[([^\]]+)\]"), F.lit(1)), F.lit(-1))
    entries = F.transform(F.split(last, ",", -1), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""))
    return F.coalesce(F.filter(entries, lambda x: x != ""), _empty())


def strip_citations(answer: Column) -> Column:
    """The answer without bracketed lists, white space collapsed."""
    return collapse_whitespace(F.regexp_replace(answer, r"\[[^\]]+\]", ""))


def enforced_citations(answer: Column, allowed: Column) -> Column:
    """The cited ids that are allowed, all allowed ones if there are none."""
    kept = F.filter(extract_citations(answer), lambda c: F.array_contains(allowed, c))
    return F.when(F.size(kept) > 0, kept).otherwise(allowed)


def enforced_answer(answer: Column, allowed: Column) -> Column:
    """The plain answer with its enforced citations on the last line."""
    return F.concat(strip_citations(answer), F.lit("\n\n["), F.array_join(enforced_citations(answer, allowed), ", "), F.lit("]"))


_QUOTED = r"'(?:[^'\\]|\\.)*'|" + r'"(?:[^"\\]|\\.)*"'
_ITEM = rf"(?:{_QUOTED}|[+-]?\d+(?:\.\d+)?|True|False|None)"
_LITERAL = rf"(?s)^\[\s*(?:{_ITEM}(?:\s*,\s*{_ITEM})*\s*,?\s*)?\]$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _json_list(flat: Column) -> Column:
    """The entries of a JSON list as text, a null one as None; null for other text."""
    items = F.when(flat.startswith("["), F.from_json(flat, "array<string>", {"allowSingleQuotes": "false"}))
    return F.transform(items, lambda x: F.coalesce(x, F.lit("None")))


def _literal_list(flat: Column) -> Column:
    """The entries of a list of plain literals in Python's notation; null for other text."""

    def said(item: Column) -> Column:
        inner = F.regexp_replace(F.substring(item, F.lit(2), F.length(item) - 2), r"\\(.)", "$1")
        return F.when(F.left(item, F.lit(1)).isin("'", '"'), inner).otherwise(item)

    return F.when(flat.rlike(_LITERAL), F.transform(F.regexp_extract_all(flat, F.lit(_ITEM), F.lit(0)), said))


def _bare_list(flat: Column) -> Column:
    """The entries between brackets and commas, without quotation marks at their ends; null for other text."""
    inner = F.regexp_extract(flat, r"(?s)^\[(.*)\]$", 1)
    entries = F.filter(F.transform(F.split(inner, ",", -1), _stripped), lambda x: x != "")
    return F.when(flat.rlike(r"(?s)^\[.*\]$"), F.transform(entries, lambda x: F.regexp_replace(x, "^['\"]+|['\"]+$", "")))


def parse_list(text: Column) -> Column:
    """The entries of a list written as JSON, as a Python literal or bare in brackets; other text is one entry; null, blank and nan are none."""
    flat = _stripped(text)
    nothing = flat.isNull() | F.lower(flat).isin("", "nan")
    return F.when(nothing, _empty()).otherwise(F.coalesce(_json_list(flat), _literal_list(flat), _bare_list(flat), F.array(flat)))


def parse_json_list(text: Column) -> Column:
    """The entries of a list written as JSON; other text is one entry; null, blank and nan are none."""
    flat = _stripped(text)
    return F.when(flat.isNull() | F.lower(flat).isin("", "nan"), _empty()).otherwise(F.coalesce(_json_list(flat), F.array(flat)))


def parse_literal_list(text: Column) -> Column:
    """The entries of a list written as JSON or as a Python literal; other text, nan too, is one entry; null and blank are none."""
    flat = _stripped(text)
    return F.when(flat.isNull() | (flat == ""), _empty()).otherwise(F.coalesce(_json_list(flat), _literal_list(flat), F.array(flat)))


def answer_key(answer: Column) -> Column:
    """The form in which answers are compared: lower case, white space collapsed, null as empty."""
    return collapse_whitespace(F.lower(F.coalesce(answer, F.lit(""))))


def shorten(text: Column, limit: int) -> Column:
    """At most limit characters, cut at a space and marked."""
    flat = collapse_whitespace(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(limit)), " [^ ]*$", ""), F.lit(" ...")))


def title_of(topic: Column) -> Column:
    return F.initcap(topic_words(topic))


def joined_distinct(*columns: Column) -> Column:
    """The distinct non-empty values in order, joined by commas."""
    said = F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan"))
    return F.array_join(F.array_distinct(said), ", ")


def collection_name(topic: Column, snapshot: Column) -> Column:
    return F.concat(slugify(topic), F.lit("__"), slugify(snapshot))


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit("__chunk_"), F.format_string("%04d", index.cast("long")))


def percent(share: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", share * 100), F.lit("%"))


def fixed(number: Column, digits: int = 4) -> Column:
    """A number with so many digits after the point, a null as nothing."""
    return F.when(number.isNull(), F.lit("")).otherwise(F.format_string(f"%.{digits}f", number.cast("double")))


def page_label(page: Column) -> Column:
    """A page number as text, nothing for none."""
    return F.coalesce(page.cast("long").cast("string"), F.lit(""))
