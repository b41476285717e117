"""Encoding a corpus with a public byte-level BPE vocabulary.

Each pre-token is a doubly linked list of symbols; a heap holds the possible
merges by rank and entries whose symbols have since been merged are skipped when
they surface. Pre-tokens repeat, so a worker remembers those it has encoded.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import arrow_once

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
REMEMBERED = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class BytePairEncoder:
    """The vocabulary, its merge ranks and what has been encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols = byte_symbols()
        vocabulary: dict[str, int] = model["vocab"]
        self.byte_ids = [vocabulary[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a], vocabulary[b]] = rank, vocabulary[a + b]
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocabulary.items() if all(c in back for c in s)}
        self._split_any = regex.compile(PATTERN).findall
        self._split_ascii = re.compile(_ASCII, re.ASCII).findall
        self._seen = _Remembered(self.encode_piece)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ids = [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, i + 1, found[1], ids[i], ids[i + 1]))
        if not heap:
            return tuple(ids)
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, i, j, merged, left, right = heapq.heappop(heap)
            if ids[i] != left or ids[j] != right or after[i] != j:
                continue  # one of its symbols has been merged since
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, ids[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, k, found[1], merged, ids[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], merged))
                if found:
                    heapq.heappush(heap, (found[0], h, i, found[1], ids[h], merged))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        if not text:
            return []
        pieces = (self._split_ascii if text.isascii() else self._split_any)(text)
        return list(chain.from_iterable(map(self._seen.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their byte strings, joined."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


class _Remembered(dict):
    """Ids by pre-token; starts anew when full, which costs time only."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._encode(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, read once per process."""
    return BytePairEncoder(path)


def _ship(df: DataFrame, vocabulary: str) -> str:
    """Sends the vocabulary's file to the executors, which need not have it; its name there."""
    context = df.sparkSession.sparkContext
    if os.path.exists(vocabulary):
        context.addFile(vocabulary)
    return os.path.basename(vocabulary)


def _held(name: str, vocabulary: str) -> BytePairEncoder:
    """The encoder of a shipped file, or of the path itself where that is on every machine."""
    shipped = SparkFiles.get(name)
    return encoder(shipped if os.path.exists(shipped) else vocabulary)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col and ``ids`` (array of int) of every row.

    Null and empty texts have an empty list; blank texts are encoded as they
    stand. Strings that look like special tokens are ordinary text. A row that
    occurs twice comes out twice. Texts of any length are encoded whole.
    """
    name = _ship(df, vocabulary)

    @arrow_once("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        e = _held(name, vocabulary)
        values: list[int] = []
        ends = [0]
        for t in texts.to_pylist():
            values.extend(e.encode(t))
            ends.append(len(values))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).select(F.col(id_col), ids("_text").alias("ids"))


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col and ``text`` of every row of ids; null and empty lists give an empty text."""
    name = _ship(df, vocabulary)

    @arrow_once("string")
    def text(ids: pa.Array) -> pa.Array:
        e = _held(name, vocabulary)
        return pa.array([e.decode(x or []) for x in ids.to_pylist()], pa.string())

    return df.select(F.col(id_col), F.col(ids_col).alias("_ids")).select(F.col(id_col), text("_ids").alias("text"))
