"""Word hashing over whole batches of texts, shared by the text operators.

A *word* is a run of ASCII letters and digits after lower-casing. All words of
a batch are hashed with a few numpy passes over the encoded bytes, so no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_IS_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _IS_WORD[_c] = True
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64; kept and doubled on demand."""
    global _powers
    while len(_powers) < n:
        step = U64(pow(_BASE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


class Words:
    """Hashes of the words of several texts, in order.

    hashes: uint64 per word; lengths: characters of each; offsets: the words of
    text i are ``hashes[offsets[i]:offsets[i + 1]]``.
    """

    __slots__ = ("hashes", "lengths", "offsets")

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, offsets: np.ndarray):
        self.hashes, self.lengths, self.offsets = hashes, lengths, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def hash_words(texts: list[str | None]) -> Words:
    """Hashes of all words of the texts; null and empty texts have none."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    starts_of = np.zeros(len(encoded) + 1, dtype=np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=starts_of[1:])
    buf = np.frombuffer(b"\n".join(encoded) + b"\n\n", dtype=np.uint8)
    word = _IS_WORD[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    offsets = np.searchsorted(begin, starts_of)
    if not len(begin):
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), offsets)
    length = end - begin
    seg = np.zeros(len(length), dtype=np.int64)
    np.cumsum(length[:-1], out=seg[1:])
    chars = buf[word]
    local = np.arange(len(chars)) - np.repeat(seg, length)
    h = np.add.reduceat(_VALUE[chars] * powers(int(length.max()))[local], seg)
    return Words(mix(h + length.astype(np.uint64)), length, offsets)


def hash_windows(words: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words and the text each belongs to."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = words.hashes
    acc = np.full(n - k + 1, U64(seed * 2 + 1), dtype=np.uint64)
    for i in range(k):
        acc = acc * U64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    doc = words.document_of()
    inside = doc[: n - k + 1] == doc[k - 1 :]
    return mix(acc[inside]), doc[: n - k + 1][inside]


def sequence_hashes(words: Words, seed: int) -> np.ndarray:
    """One hash per text of its whole word sequence; equal texts hash equal."""
    n = len(words.offsets) - 1
    out = np.zeros(n, dtype=np.uint64)
    counts = words.counts
    some = np.flatnonzero(counts)
    if len(some):
        local = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], counts)
        keyed = mix(words.hashes ^ U64(seed)) * powers(int(counts.max()))[local]
        out[some] = np.add.reduceat(keyed, words.offsets[:-1][some])
    return mix(out + counts.astype(np.uint64))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)
