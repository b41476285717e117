"""Cutting oversized documents into overlapping pieces at natural boundaries.

A dynamic program over boundary positions minimises the penalties of the cuts
and the imbalance of the piece sizes; no piece exceeds the limit and each one
repeats the last words of the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import arrow_once
from ._texts import chunks

#: What a cut costs: at a line end, a sentence end, a clause end, between any two words.
PENALTY = (0.0, 0.15, 2.0, 6.0)
KINDS = ("line", "sentence", "clause", "hard")
PER_PIECE, IMBALANCE = 0.05, 1.0
_SPACES = (9, 10, 13, 32)


@dataclass(frozen=True)
class SplitConfig:
    """max_words: of a piece with its path; overlap: words repeated from the piece before."""

    max_words: int = 160
    overlap: int = 40

    def __post_init__(self):
        if self.max_words < 1 or not 0 <= self.overlap < self.max_words:
            raise ValueError("max_words must be positive and overlap less than max_words")


class _Layout:
    """Where the words of a text lie and what kind of gap follows each."""

    __slots__ = ("begin", "end", "kind")

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        space = np.isin(code, _SPACES) if len(code) > 4096 else (code == 32) | (code == 10) | (code == 9) | (code == 13)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        self.begin, self.end = edge[::2], edge[1::2]
        n = len(self.begin)
        self.kind = np.full(max(n - 1, 0), 3, dtype=np.int8)
        if n > 1:
            last = code[self.end[:-1] - 1]
            self.kind[(last == 44) | (last == 59) | (last == 58)] = 2
            self.kind[(last == 46) | (last == 33) | (last == 63)] = 1
            feeds = np.concatenate([[0], np.cumsum(code == 10)])
            self.kind[feeds[self.begin[1:]] > feeds[self.end[:-1]]] = 0

    def stretches(self) -> np.ndarray:
        """Ends of the stretches between natural boundaries, counted in words."""
        return np.concatenate([np.flatnonzero(self.kind <= 1) + 1, [len(self.begin)]])


def _candidates(layout: _Layout, ends: np.ndarray, first: int, step: int) -> tuple[list[int], list[int]]:
    """Positions where a cut may fall and their kinds: all natural boundaries, and within longer stretches also clause ends and every few words."""
    if (np.diff(ends, prepend=0) <= step).all():
        return ends.tolist(), layout.kind[ends[:-1] - 1].tolist()
    marks = [ends]
    stride = max(1, step // 12)
    at = 0
    for e in ends.tolist():
        if e - at > step:
            marks.append(np.arange(at + stride, e, stride))
            marks.append(at + 1 + np.flatnonzero(layout.kind[at : e - 1] == 2))
        at = e
    where = np.unique(np.concatenate(marks))
    return where.tolist(), layout.kind[where[:-1] - 1].tolist()


def cut_points(layout: _Layout, ends: np.ndarray, budget: int, overlap: int) -> tuple[list[int], list[int]]:
    """Ends of the pieces in words, and the kind of each cut but the last."""
    n, step = len(layout.begin), budget - overlap
    where, kinds = _candidates(layout, ends, budget, step)
    pieces = 1 + -(-(n - budget) // step)
    target = max(1.0, (n + (pieces - 1) * overlap) / pieces)
    where = [0, *where]
    cost, back = [0.0] * len(where), [0] * len(where)
    low, last = 0, len(where) - 1
    for j in range(1, len(where)):
        at = where[j]
        while at - where[low] > (step if low else budget):
            low += 1
        best, via = float("inf"), low
        for i in range(low, j):
            new = at - where[i]
            off = ((new + overlap if i else new) - target) / target
            c = cost[i] + IMBALANCE * off * off
            if c < best:
                best, via = c, i
        if low and at <= budget and (c := IMBALANCE * ((at - target) / target) ** 2) < best:
            best, via = c, 0
        cost[j] = best + PER_PIECE + (PENALTY[kinds[j - 1]] if j < last else 0.0)
        back[j] = via
    at, path = last, []
    while at:
        path.append(at)
        at = back[at]
    path.reverse()
    return [where[j] for j in path], [kinds[j - 1] for j in path[:-1]]


def _path_words(path: list[str | None] | None) -> int:
    return sum(len(x.translate(_BLANK).split()) for x in path if x) if path else 0


_BLANK = {i: " " for i in (9, 10, 13)}  # other white space is part of a word, so it is shielded
_BLANK |= {i: "x" for i in (11, 12, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


def pieces_of(text: str, path_words: int, config: SplitConfig) -> dict | None:
    """The pieces of an oversized text; None if it needs no splitting."""
    room = config.max_words - path_words
    if not text or len(text) <= room:  # not even one word for every other character
        return None
    layout = _Layout(text)
    n = len(layout.begin)
    if n <= room:
        return None
    ends = layout.stretches()
    longest = int(np.diff(ends, prepend=0).max()) if n else 0
    budget = max(1, room)
    overlap = min(config.overlap, budget - 1)
    cuts, kinds = cut_points(layout, ends, budget, overlap) if n > budget else ([n], [])
    first = [0, *(c - overlap for c in cuts[:-1])]
    return {
        "hard_cut": int(longest > room), "words": n, "first": first, "end": cuts, "kinds": [*(KINDS[k] for k in kinds), "end"],
        "char_begin": layout.begin[first].tolist() if n else [0], "char_end": layout.end[np.array(cuts) - 1].tolist() if n else [len(text)],
    }


_PIECE = "piece_no int, text string, first_word int, words int, cut string"


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "section_path", config: SplitConfig = SplitConfig(), with_text: bool = True) -> DataFrame:
    """One row per document: id, oversized, hard_cut, path_words, pieces.

    Words are runs of characters other than space, tab, CR and LF; the words of
    all entries of the path count against every piece (a null path or entry has
    none). A text within the limit is one piece, as it stands; a null or empty
    text has no pieces and is not oversized. If the path alone reaches the limit,
    pieces have one word and no overlap; if it leaves 40 words or fewer, the
    overlap shrinks so that each piece brings a new word. hard_cut is 1 where a
    stretch between natural boundaries is itself over the limit, null where the
    text is not oversized. Rows that occur twice come out twice.
    """
    kind = f"struct<oversized boolean, hard_cut int, path_words int, pieces array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>>"

    @arrow_once(kind)
    def plan(texts: pa.Array, paths: pa.Array) -> pa.Array:
        over, hard, in_path, ends = [], [], [], [0]
        no, body, first, size, cut = [], [], [], [], []
        for begin in range(0, len(texts), 1024):
            for text, path in zip(texts.slice(begin, 1024).to_pylist(), paths.slice(begin, 1024).to_pylist()):
                p = _path_words(path)
                found = pieces_of(text, p, config) if text else None
                over.append(found is not None)
                hard.append(found["hard_cut"] if found else None)
                in_path.append(p)
                if found:
                    no.extend(range(len(found["end"])))
                    first.extend(found["first"])
                    size.extend(e - f for f, e in zip(found["first"], found["end"]))
                    cut.extend(found["kinds"])
                    if with_text:
                        body.extend(text[b:e] for b, e in zip(found["char_begin"], found["char_end"]))
                elif text:
                    no.append(0)
                    first.append(0)
                    size.append(len(text.translate(_BLANK).split()))
                    cut.append("end")
                    if with_text:
                        body.append(text)
                ends.append(len(no))
        fields = [pa.array(no, pa.int32()), pa.array(body if with_text else [None] * len(no), pa.string()), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(cut, pa.string())]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["piece_no", "text", "first_word", "words", "cut"]))
        return pa.StructArray.from_arrays([pa.array(over, pa.bool_()), pa.array(hard, pa.int32()), pa.array(in_path, pa.int32()), lists], ["oversized", "hard_cut", "path_words", "pieces"])

    return df.select(F.col(id_col).alias("_id"), plan(F.col(text_col), F.col(path_col)).alias("_plan")).select(F.col("_id").alias(id_col), "_plan.*")


def piece_rows(df: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """split_documents with one row per piece; see there."""
    return split_documents(df, id_col, **kwargs).select(id_col, "oversized", "path_words", F.explode("pieces").alias("_p")).select(id_col, "oversized", "path_words", "_p.*")
