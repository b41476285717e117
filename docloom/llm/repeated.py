"""Lines that recur across the pages of one source, and texts without them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._plan import arrow_once, cut, join_small, small_enough


@dataclass(frozen=True)
class RepeatConfig:
    """A line counts from min_chars on; it is repeated from min_pages and min_share of the source's pages on."""

    min_chars: int = 25
    min_pages: int = 5
    pages_per_hit: int = 20


BROADCAST_ROWS = 200_000
LOOKUP_ROWS = 2_000_000  # repeated lines that every worker can look up: 24 MB


def normalized_line(line: Column) -> Column:
    """Lower case, one space for white space, no outer spaces, one 0 for each number."""
    return F.regexp_replace(F.btrim(F.regexp_replace(F.lower(line), "[ \t\r]+", " "), F.lit(" ")), "[0-9]+", "0")


def _long_enough(line: Column, config: RepeatConfig) -> Column:
    """Whether a line can have min_chars in its normal form; lower case is at most twice as long."""
    return F.length(line) * 2 >= config.min_chars


def _keys(source: Column, norm: Column) -> tuple[Column, Column]:
    """96 bits of hash of a source's line."""
    return F.xxhash64(source, norm), F.hash(norm, source)


def _lines(df: DataFrame, id_col: str, text_col: str, source_col: str, page_col: str, config: RepeatConfig) -> DataFrame:
    base = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.xxhash64(F.col(page_col)).alias("_page"), F.col(page_col).isNotNull().alias("_paged"), F.col(text_col).alias("_text"))
    base = base.filter(F.col("_source").isNotNull() & F.col("_text").isNotNull())
    lines = base.select("_id", "_source", F.when(F.col("_paged"), F.col("_page")).alias("_page"), F.posexplode(F.split("_text", "\n", -1)).alias("_line_no", "_line"))
    lines = lines.filter(_long_enough(F.col("_line"), config)).withColumn("_norm", normalized_line(F.col("_line")))
    h, g = _keys(F.col("_source"), F.col("_norm"))
    return lines.filter(F.length("_norm") >= config.min_chars).select("_id", "_source", "_page", "_line_no", h.alias("_h"), g.alias("_g"))


def frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source_id", page_col: str = "page_key", config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """_h, _g (96 bits of hash of the source and line) of each repeated line.

    A source has at most pages_per_hit times as many of them as its pages have
    lines on average, so the result is small next to the documents.
    """
    present = df.filter(F.col(source_col).isNotNull() & F.col(text_col).isNotNull())
    totals = present.groupBy(F.col(source_col).alias("_source")).agg(F.count_distinct(F.col(page_col)).alias("_pages"))
    seen = _lines(df, id_col, text_col, source_col, page_col, config).groupBy("_source", "_h", "_g").agg(F.count_distinct("_page").alias("_n"))
    seen = seen.filter(F.col("_n") >= config.min_pages)
    return join_small(seen, cut(totals), ["_source"], BROADCAST_ROWS, F.col("_h")).filter(F.col("_n") * config.pages_per_hit >= F.col("_pages")).select("_h", "_g")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source_id", page_col: str = "page_key", config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """id_col and line_no of every occurrence of a repeated line.

    Documents without source or text are left out, also from the counts; a null
    page counts for no page; empty texts count as pages without lines. Pages are
    told apart by a 64-bit hash. Rows that occur twice come out twice.
    """
    frequent = cut(frequent_lines(df, id_col, text_col, source_col, page_col, config))
    lines = _lines(df, id_col, text_col, source_col, page_col, config)
    return join_small(lines, frequent, ["_h", "_g"], BROADCAST_ROWS, F.xxhash64("_id", "_line_no")).select(F.col("_id").alias(id_col), F.col("_line_no").alias("line_no"))


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source_id", page_col: str = "page_key", config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """id_col, text, removed_lines of every row: the text less its repeated lines.

    A document without source keeps its text; a null text stays null. The other
    lines stay as they are and in order. Rows that occur twice come out twice.
    Where the repeated lines are few enough for every worker to look them up, the
    texts are not moved; else each text meets the numbers of its repeated lines.
    """
    frequent = cut(frequent_lines(df, id_col, text_col, source_col, page_col, config))
    base = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    if small_enough(frequent, LOOKUP_ROWS):
        out = _looked_up(base, frequent, config)
    else:
        # a row is known by its id and what it says; equal rows have equal lines
        row = F.xxhash64("_id", "_source", "_text")
        keyed = df.withColumn(id_col, F.struct(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("_row")))
        hits = join_small(_lines(keyed, id_col, text_col, source_col, page_col, config), frequent, ["_h", "_g"], BROADCAST_ROWS, F.xxhash64("_id._row", "_line_no"))
        drop = hits.groupBy(F.col("_id._row").alias("_row")).agg(F.collect_set("_line_no").alias("_drop"))
        joined = base.withColumn("_row", row).join(drop, "_row", "left")
        gone = F.coalesce("_drop", F.array().cast("array<int>"))
        out = joined.withColumn("_kept", F.when(F.size(gone) == 0, F.split("_text", "\n", -1)).otherwise(F.filter(F.split("_text", "\n", -1), lambda _, i: ~F.array_contains(gone, i))))
    return out.select(F.col("_id").alias(id_col), F.array_join("_kept", "\n").alias("text"), (F.size(F.split("_text", "\n", -1)) - F.size("_kept")).alias("removed_lines"))


def _looked_up(base: DataFrame, frequent: DataFrame, config: RepeatConfig) -> DataFrame:
    """base with _kept, the lines that are not repeated, by looking the hashes of all lines up."""
    rows = frequent.distinct().toArrow()  # LOOKUP_ROWS at most
    h, g = (rows.column(c).to_numpy() for c in ("_h", "_g"))
    order = np.lexsort((g, h))
    held = base.sparkSession.sparkContext.broadcast((h[order], g[order]))

    @arrow_once("array<boolean>")
    def kept(hashes: pa.Array, others: pa.Array) -> pa.Array:
        known_h, known_g = held.value
        asked_h, asked_g = (x.flatten().to_numpy(zero_copy_only=False) for x in (hashes, others))
        keep = np.ones(len(asked_h), dtype=bool)
        if len(known_h):
            at = np.searchsorted(known_h, asked_h)
            for step in range(2):  # two lines that share 64 bits of hash are next to each other
                there = np.minimum(at + step, len(known_h) - 1)
                keep &= (known_h[there] != asked_h) | (known_g[there] != asked_g)
        sizes = [0, *np.cumsum(np.diff(np.array(hashes.offsets)))]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(keep))

    lines = F.split("_text", "\n", -1)

    def key(which: int):
        # short lines have no normal form, and no hash that any repeated line has
        return F.transform(lines, lambda x: F.when(_long_enough(x, config), _keys(F.col("_source"), normalized_line(x))[which]).otherwise(F.lit(0)))

    sided = base.filter(F.col("_source").isNotNull() & F.col("_text").isNotNull())
    masked = sided.withColumn("_mask", kept(key(0), key(1))).withColumn("_kept", F.filter(lines, lambda _, i: F.get("_mask", i))).drop("_mask")
    return masked.unionByName(base.filter(F.col("_source").isNull() | F.col("_text").isNull()).withColumn("_kept", lines))
