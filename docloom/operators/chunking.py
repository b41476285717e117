"""Sentence-aware chunking as native array folds.

A text becomes units (sentences, else clauses, else word windows) and units are
packed greedily into chunks: one fold over an array of structs per document, no
Python and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import text as T
from ..planning import once

UNIT = "struct<text:string,words:int,strategy:string>"
_GROUP = "struct<first:int,end:int,words:int>"
_STATE = f"struct<blocks:array<array<{_GROUP}>>,tail:array<{_GROUP}>,open:{_GROUP}>"
_BLOCK = 128  # closed chunks that are copied at most when one more is closed, however long the text


@dataclass(frozen=True)
class ChunkConfig:
    """Words of a chunk: max_words at most where units allow, min_words at least; overlap_words of word windows."""

    max_words: int = 160
    overlap_words: int = 40
    min_words: int = 40

    def __post_init__(self):
        if self.max_words <= 0:
            raise ValueError("max_words must be positive")
        if not 0 <= self.overlap_words < self.max_words:
            raise ValueError("overlap_words must be at least 0 and less than max_words")
        if self.min_words < 1:
            raise ValueError("min_words must be at least 1")

    # The shares of the limit that steer the packing

    @property
    def target(self) -> int:
        return max(self.min_words, int(self.max_words * 0.78))

    @property
    def soft_max(self) -> int:
        return self.max_words + max(12, int(self.max_words * 0.12))

    @property
    def small(self) -> int:
        return max(18, int(self.max_words * 0.15))


def word_windows(total: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Windows (first, end) over so many words: max_words long, overlapping; a short last one joins the one before."""
    step = config.max_words - config.overlap_words
    # windows start until one reaches the end
    count = F.when(total <= config.max_words, F.lit(1)).otherwise(F.ceil((total - config.max_words) / step).cast("int") + 1)
    last = (count - 1) * step
    short = (count > 1) & (total - last < config.min_words)
    kept = F.when(short, count - 1).otherwise(count)
    windows = F.transform(F.sequence(F.lit(0), kept - 1), lambda i: F.struct((i * step).cast("int").alias("first"), F.when(i == kept - 1, total).otherwise(F.least(i * step + config.max_words, total)).cast("int").alias("end")))
    return F.when(total > 0, windows).otherwise(F.array().cast("array<struct<first:int,end:int>>"))


def _unit(text: Column, words: Column, strategy: str) -> Column:
    return F.struct(text.alias("text"), words.cast("int").alias("words"), F.lit(strategy).alias("strategy")).cast(UNIT)


def _windowed(fragment: Column, config: ChunkConfig) -> Column:
    said = F.split(fragment, " ", -1)
    return F.transform(word_windows(F.size(said), config), lambda w: _unit(F.array_join(F.slice(said, w["first"] + 1, w["end"] - w["first"]), " "), w["end"] - w["first"], "word_fallback"))


def semantic_units(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """The units of a text: sentences of at most max_words, else their clauses, else word windows."""
    return flat_units(T.collapse_whitespace(text), config)


def flat_units(flat: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """The same of a text whose white space is collapsed already."""

    def of_clauses(clauses: Column) -> Column:
        return F.flatten(F.transform(clauses, lambda c: F.when(T.flat_word_count(c) <= config.max_words, F.array(_unit(c, T.flat_word_count(c), "clause"))).otherwise(_windowed(c, config))))

    def of_sentence(s: Column) -> Column:
        clauses = T.flat_clauses(s)
        return F.when(T.flat_word_count(s) <= config.max_words, F.array(_unit(s, T.flat_word_count(s), "sentence"))).when(F.size(clauses) > 1, of_clauses(clauses)).otherwise(_windowed(s, config))

    return F.flatten(F.transform(T.flat_sentences(flat), of_sentence))


def chunk_groups(units: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Consecutive units packed into chunks: (first, end, words) of each.

    A unit joins the open chunk if that is below the minimum, below the target and
    within the soft limit with it, or within the limit with a small unit. A last
    chunk below the minimum joins the one before.
    """

    def group(first: Column, end: Column, words: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), end.cast("int").alias("end"), words.cast("int").alias("words"))

    def add(state: Column, unit: Column) -> Column:
        open_, n = state["open"], unit["words"]
        total = open_["words"] + n
        joins = (open_["words"] < config.min_words) | ((open_["words"] < config.target) & (total <= config.soft_max)) | ((total <= config.max_words) & (n <= config.small))
        grown = group(open_["first"], open_["end"] + 1, total)
        fresh = group(open_["end"], open_["end"] + 1, n)
        full = F.size(state["tail"]) >= _BLOCK
        blocks = F.when(~joins & full, F.concat(state["blocks"], F.array(state["tail"]))).otherwise(state["blocks"])
        tail = F.when(joins, state["tail"]).when(full, F.array(open_)).otherwise(F.concat(state["tail"], F.array(open_)))
        return F.struct(blocks.alias("blocks"), tail.alias("tail"), F.when(joins, grown).otherwise(fresh).alias("open")).cast(_STATE)

    def finish(state: Column) -> Column:
        closed, open_ = F.flatten(F.concat(state["blocks"], F.array(state["tail"]))), state["open"]
        before = F.try_element_at(closed, F.lit(-1))
        merged = F.concat(F.slice(closed, 1, F.greatest(F.size(closed) - 1, F.lit(0))), F.array(group(before["first"], open_["end"], before["words"] + open_["words"])))
        every = F.when((F.size(closed) > 0) & (open_["words"] < config.min_words), merged).otherwise(F.concat(closed, F.array(open_)))
        return F.when(open_["end"] > 0, every).otherwise(F.array().cast(f"array<{_GROUP}>"))

    start = F.struct(F.array().cast(f"array<array<{_GROUP}>>").alias("blocks"), F.array().cast(f"array<{_GROUP}>").alias("tail"), group(F.lit(0), F.lit(0), F.lit(0)).alias("open")).cast(_STATE)
    return F.aggregate(units, start, add, finish)


def chunk_documents(df: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The chunks of documents, as rows.

    df has doc_id, text, section_path; other columns are carried along. Low-signal
    documents and chunks are left out; chunks are numbered before that, so numbers
    have gaps. A null or blank text has no chunks; a null path no context.
    """
    carried = [c for c in df.columns if c not in ("text", "n_chars")]
    said = quality.with_signals(df.filter(F.col("text").isNotNull() & ~quality.low_signal_path(F.col("section_path"))), "text")
    kept = said.filter((F.col("_flat") != "") & ~F.col("_low_signal")).select(*carried, F.col("_flat").alias("_text"))
    units = once(once(kept, _units=flat_units(F.col("_text"), config)), _groups=chunk_groups(F.col("_units"), config))
    rows = units.select(*carried, T.flat_word_count(F.col("_text")).alias("source_doc_word_count"), "_units", F.posexplode("_groups").alias("_at", "_group"))
    own = F.slice("_units", F.col("_group.first") + 1, F.col("_group.end") - F.col("_group.first"))
    rows = once(rows.withColumn("chunk_index", (F.col("_at") + 1).cast("long")).drop("_at"), _own=own).drop("_units")
    rows = once(rows, text=T.enrich_flat_text(F.col("section_path"), F.array_join(F.transform("_own", lambda u: u["text"]), " ")))
    rows = quality.with_signals(rows, "text", flat=True).filter(~F.col("_low_signal"))
    return rows.select(
        T.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), *carried, "chunk_index",
        F.col("_group.first").cast("long").alias("chunk_unit_start"), F.col("_group.end").cast("long").alias("chunk_unit_end"),
        F.size("_own").cast("long").alias("sentence_count"), F.array_sort(F.array_distinct(F.transform("_own", lambda u: u["strategy"]))).alias("chunk_strategies"),
        F.col("source_doc_word_count").cast("long").alias("source_doc_word_count"), T.flat_word_count(F.col("text")).cast("long").alias("word_count"), F.length("text").cast("long").alias("char_count"), "text",
    )
