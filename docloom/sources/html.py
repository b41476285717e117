"""Sections of HTML pages.

Python runs here only: markup is parsed with the standard library, batch by batch,
into headings and text blocks in document order, cleaned and gathered into sections
in the same pass; low-signal rules and ids are native expressions.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import quality
from ..functions import text as T
from ..planning import in_place

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag, self.attributes = tag, attributes
        self.children: list[_Node | str] = []

    def walk(self):
        """The nodes below, in document order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, _Node):
                yield child
                stack.append(iter(child.children))

    def text(self) -> str:
        """The strings below, stripped and joined by spaces."""
        out, stack = [], [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                if s := child.strip():
                    out.append(s)
            else:
                stack.append(iter(child.children))
        return " ".join(out)

    def first(self, tag: str) -> _Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)


class _Tree(HTMLParser):
    """A tree of the page without the dropped elements; a new block closes an open paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]
        self.dropped: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            if tag not in _VOID:
                self.dropped.append(tag)
            return
        if tag in C.DROP_TAGS:
            self.dropped.append(tag)
            return
        if tag in _BLOCKS:
            self._close({"p"}, until={"li", "td", "th", "div", "section", "article", "main", "body"})
        if tag in _CLOSES:
            self._close(_CLOSES[tag], until={"ul", "ol", "dl", "table", "select"})
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        if not self.dropped and tag not in C.DROP_TAGS:
            self.open[-1].children.append(_Node(tag, dict(attrs)))

    def _close(self, tags: set[str], until: set[str]):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def handle_endtag(self, tag):
        if self.dropped:
            if tag in self.dropped:
                del self.dropped[len(self.dropped) - 1 - self.dropped[::-1].index(tag) :]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not self.dropped:
            self.open[-1].children.append(data)


def page_blocks(html: str) -> tuple[str, str | None, list[tuple[int, str]]]:
    """Title, date of the last update and the blocks of a page: (heading level, text), level 0 for text."""
    parser = _Tree()
    parser.feed(html)
    parser.close()
    page = parser.root
    place = page.first("main") or page.first("article") or page.first("body") or page
    named, top = page.first("title"), place.first("h1")
    title = top.text() if top else (named.text() if named and named.text() else "Untitled Page")
    updated = None
    metas = [n.attributes for n in page.walk() if n.tag == "meta"]
    for key in C.META_UPDATED_KEYS:
        found = [a for kind in ("property", "name") for a in metas if a.get(kind) == key]
        if found and found[0].get("content"):
            updated = " ".join(found[0]["content"].split())
            break
    if updated is None and (stamp := page.first("time")) and stamp.attributes.get("datetime"):
        updated = " ".join(stamp.attributes["datetime"].split())
    blocks = []
    for node in place.walk():
        if node.tag in C.HEADING_TAGS:
            blocks.append((int(node.tag[1]), node.text()))
        elif node.tag in C.TEXT_TAGS:
            blocks.append((0, node.text()))
    return title, updated, blocks


def _space_class() -> str:
    """The class of white space in this language's spelling."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", C.SPACE)


_SPACE = _space_class()
_ANCHOR, _DASHES, _RUN = re.compile(f"{_SPACE}*¶{_SPACE}*"), re.compile(f"{_SPACE}*--+{_SPACE}*\\Z"), re.compile(f"{_SPACE}+")
_LOOSE = re.compile(r"[ \t\n\x0b\f\r]+([.,;:!?])")


def clean_text(text: str) -> str:
    """What functions.text.clean_html_text makes of a text."""
    opened = _ANCHOR.sub(" ", text) if "¶" in text else text
    cut = _DASHES.sub("", opened) if "--" in opened else opened
    return _LOOSE.sub(r"\1", _RUN.sub(" ", cut).strip(" "))


def page_sections(html: str) -> tuple[str, str | None, list[tuple[list[str], str]]]:
    """Title, date of the last update and the sections of a page: (path of headings, text), one for each stretch between headings."""
    title, updated, blocks = page_blocks(html)
    path: list[tuple[int, str]] = []
    texts: list[str] = []
    out: list[tuple[list[str], str]] = []
    for level, raw in blocks:
        said = clean_text(raw)
        if not said:
            continue
        if level:
            out.append(([h for _, h in path], clean_text(" ".join(texts))))
            path = [*((k, h) for k, h in path if k < level), (level, said)]
            texts = []
        elif not texts or texts[-1] != said:
            texts.append(said)
    out.append(([h for _, h in path], clean_text(" ".join(texts))))
    return clean_text(title), updated, out


_PAGE = "struct<title:string,updated_at:string,sections:array<struct<path:array<string>,text:string>>>"
_SECTION = pa.struct([("path", pa.list_(pa.string())), ("text", pa.string())])


def _parsed(pages: pa.Array) -> pa.Array:
    titles, dates, found = [], [], []
    for html in pages.to_pylist():
        title, updated, sections_ = page_sections(html or "")
        titles.append(title)
        dates.append(updated)
        found.append([{"path": p, "text": t} for p, t in sections_ if len(t) >= C.MIN_SECTION_CHARS])
    return pa.StructArray.from_arrays([pa.array(titles, pa.string()), pa.array(dates, pa.string()), pa.array(found, pa.list_(_SECTION))], ["title", "updated_at", "sections"])


def sections(pages: DataFrame) -> DataFrame:
    """One row for each section of each page.

    pages: source_id, source_url, trust_level, topic_tags, document_key (may be
    null), html. Text between two headings is a section; its path is the headings
    above. Sections of fewer than 40 characters are dropped and do not count; low
    signal ones are dropped but count. A null page has no sections.
    """
    parsed_page = in_place(_parsed, _PAGE)
    parsed = pages.filter(F.col("html").isNotNull()).select("source_id", "source_url", "trust_level", "topic_tags", "document_key", parsed_page("html").alias("_p"))
    rows = parsed.withColumn("_title", F.col("_p.title")).select("*", F.posexplode("_p.sections").alias("_at", "_row"))
    path = F.when(F.size("_row.path") > 0, F.col("_row.path")).otherwise(F.array("_title"))
    rows = rows.withColumn("section_path", path).withColumn("text", F.col("_row.text")).filter(~quality.low_signal_section(F.col("section_path"), F.col("text")))
    key = F.when(F.col("document_key").isNotNull(), T.slugify(F.col("document_key"))).otherwise(T.url_slug(F.col("source_url")))
    number = F.format_string("%04d", F.col("_at") + 1)
    name = F.concat_ws("__", T.slugify(F.col("source_id")), "page_key", F.array_join(F.transform("section_path", T.slugify), "__"), number)
    nothing = F.lit(None).cast("string")
    return rows.withColumn("page_key", key).select(
        name.alias("doc_id"), nothing.alias("snapshot_id"), "source_id", "page_key", F.lit("guide_section").alias("doc_kind"), nothing.alias("external_id"), F.col("_title").alias("title"),
        "section_path", "source_url", nothing.alias("published_at"), F.col("_p.updated_at").alias("updated_at"), F.lit(None).cast("long").alias("page_number"), "trust_level", "topic_tags", "text",
    )
