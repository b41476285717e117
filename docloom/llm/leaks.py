"""Corpus documents that contain passages of evaluation items.

Passages are cut into windows of so many words, and documents into windows longer by
the edits allowed, which also stand for their beginnings. A random walk (CGK) embeds
each window so that a small edit distance becomes a small Hamming distance; keys of
sampled positions of the embedding, drawn again and again, bring together windows
that agree on a sample. Every pair of windows that shares a key is then verified by
its exact edit distance.

Windows at edit distance 0 have equal embeddings and so share every key: their
recall is 1. For e edits the number of repetitions is set from the target recall.

Items up to a size go to the executors as one index; more of them meet the documents'
windows in one join on the keys. Either way the corpus is read once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import arrow_once, cut
from ._texts import U64, Words, chunks, hash_windows, hash_words, mix

WALK = 2  # steps of the walk per word
SEED = 77
MOST_DRAWS = 64
BITS = 27  # of the map that tells which runs of words the items have: 16 MB, whatever the items


@dataclass(frozen=True)
class LeakConfig:
    """window: words of a passage; edits: word edits allowed in it; recall: wished for passages with that many edits.

    sample: positions of the walk in a key, at most; least_draws: samples drawn, at
    least. index_chars: characters of items up to which their index goes to the
    executors (about 150 bytes a character); beyond, a join on the keys.
    """

    window: int = 12
    edits: int = 0
    sample: int = 8
    recall: float = 0.95
    least_draws: int = 3
    index_chars: int = 500_000

    @property
    def draws(self) -> tuple[int, int]:
        """Positions of a sample, sample at most, and samples drawn: so many that the wished recall is reached."""
        size, count = needed_draws(self.window, self.edits, self.sample, self.recall)
        return size, max(count, self.least_draws)

    @property
    def run(self) -> int:
        """Words in a row that windows must share to be compared: what the edits leave of a passage lies in edits + 1 runs."""
        return min(-(-(self.window - self.edits) // (self.edits + 1)), -(-self.window // 2))


@lru_cache(maxsize=16)
def needed_draws(window: int, edits: int, sample: int, recall: float) -> tuple[int, int]:
    """The largest samples, and how many of them, that bring together the wished share of random windows and copies with so many words replaced, dropped or inserted: of each kind and of all in turn."""
    draw = np.random.default_rng(SEED + 1)
    x = draw.integers(1, 1 << 62, (2000, window), dtype=np.uint64)
    steps = WALK * window
    item, copies = embed(x), [embed(edited(x, kinds, edits, draw), steps) for kinds in ((0,), (1,), (2,), (0, 1, 2))]
    for size in range(min(sample, steps), 0, -1):
        keys, good = sample_keys(item, size, MOST_DRAWS, edits)
        met = []
        for y in copies:
            other, fit = sample_keys(y, size, MOST_DRAWS, edits)
            met.append(np.logical_or.accumulate((keys == other) & good & fit, axis=1).mean(axis=0))
        least = np.min(met, axis=0)
        if least[-1] >= recall:
            return size, int(np.argmax(least >= recall)) + 1
    raise ValueError(f"a recall of {recall} is out of reach for {edits} edits in {window} words")


def edited(windows: np.ndarray, kinds: tuple[int, ...], edits: int, draw: np.random.Generator) -> np.ndarray:
    """The rows with so many words replaced (0), dropped (1) or inserted (2), the kinds in turn, and foreign words after them: edits more words than before."""
    n, k = windows.shape
    out = []
    for i, row in enumerate(windows):
        words = list(row)
        for e in range(edits):
            kind, at = kinds[(i + e) % len(kinds)], int(draw.integers(len(words)))
            words[at : at + (kind < 2)] = [] if kind == 1 else draw.integers(1, 1 << 62, 1, dtype=np.uint64)
        out.append(np.concatenate([np.array(words, dtype=np.uint64), draw.integers(1, 1 << 62, k + edits - len(words), dtype=np.uint64)]))
    return np.array(out)


def embed(windows: np.ndarray, steps: int | None = None) -> np.ndarray:
    """CGK embedding of each row of word hashes: so many symbols, WALK * k unless said.

    At step t the walk writes the word it stands on and moves to the next one if
    a random bit of (t, word) says so; after the last word it writes 0.
    """
    n, k = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), dtype=np.uint64)], axis=1)
    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    steps = WALK * k if steps is None else steps
    out = np.empty((n, steps), dtype=np.uint64)
    for t in range(steps):
        here = padded[rows, at]
        out[:, t] = here
        moves = (mix(here + U64(SEED + 7919 * t)) >> U64(63)).astype(np.int64)
        at = np.minimum(at + moves, k)
    return out


def sample_keys(embedded: np.ndarray, sample: int, draws: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """A key per row and draw, the hash of the sampled positions, and whether it says anything.

    With edits a sample that reaches past the end of the walk says little: one side
    may have foreign words there.
    """
    draw = np.random.default_rng(SEED)
    keys = np.empty((len(embedded), draws), dtype=np.uint64)
    good = np.ones((len(embedded), draws), dtype=bool)
    for r in range(draws):
        acc = np.full(len(embedded), U64(r + 1))
        for p in np.sort(draw.choice(embedded.shape[1], sample, replace=False)):
            acc = mix(acc * U64(31) + embedded[:, p])
            if edits:
                good[:, r] &= embedded[:, p] != 0
        keys[:, r] = acc
    return keys, good


def sharing_piece(a: np.ndarray, mine: np.ndarray, b: np.ndarray, theirs: np.ndarray, edits: int) -> np.ndarray:
    """Which of the pairs of rows (a[mine], b[theirs]) share a piece that so many edits must leave.

    Of edits + 1 pieces of a row of b one is whole in a row of a within so many
    edits, shifted by them at most. The others need no comparison.
    """
    k, found = b.shape[1], np.zeros(len(mine), dtype=bool)
    bounds = [k * i // (edits + 1) for i in range(edits + 2)]
    for begin, end in zip(bounds, bounds[1:]):
        for o in range(-edits, edits + 1):
            if begin + o < 0 or end + o > a.shape[1]:
                continue
            rows = np.flatnonzero(~found)
            for c in range(begin, end):
                rows = rows[a[mine[rows], c + o] == b[theirs[rows], c]]
            found[rows] = True
    return np.flatnonzero(found)


def within_edits(a: np.ndarray, b: np.ndarray, edits: int, shorter: int = 0) -> np.ndarray:
    """Whether row i of a, or it without its last words, ``shorter`` at most, is within so many insertions, deletions and replacements of words of row i of b."""
    if not edits and not shorter:
        return (a == b).all(axis=1)
    (n, m), k = a.shape, b.shape[1]
    far = edits + 1  # as good as any larger distance
    # cost[edits + o]: of turning the first j words of b into the first j + o of a
    cost = [np.full(n, min(max(o, 0), far) if o >= 0 else far, dtype=np.int16) for o in range(-edits, edits + 1)]
    for j in range(1, k + 1):
        new: list[np.ndarray] = []
        for o in range(-edits, edits + 1):
            i, best = j + o, np.full(n, far, dtype=np.int16)
            if 0 < i <= m:
                best = np.minimum(best, cost[edits + o] + (a[:, i - 1] != b[:, j - 1]))
                if new:
                    best = np.minimum(best, new[-1] + 1)
            if 0 <= i <= m and o < edits:
                best = np.minimum(best, cost[edits + o + 1] + 1)
            new.append(best)
        cost = new
    ends = [cost[edits + i - k] for i in range(m - shorter, m + 1) if abs(i - k) <= edits]
    return np.minimum.reduce(ends) <= edits if ends else np.zeros(n, dtype=bool)


def _starts(words: Words, k: int) -> np.ndarray:
    """Where windows of k words lie within one text."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, dtype=np.int64)
    doc = words.document_of()
    return np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])


def item_windows(texts: list[str], config: LeakConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the passages, the passage of each, and the hashes of the runs that leaked windows keep."""
    words = hash_words(texts)
    starts = _starts(words, config.window)
    windows = words.hashes[starts[:, None] + np.arange(config.window)] if len(starts) else np.zeros((0, config.window), dtype=np.uint64)
    owner = words.document_of()[starts]
    if len(windows):
        _, first = np.unique(np.column_stack([owner.astype(np.uint64), windows]), axis=0, return_index=True)
        windows, owner = windows[first], owner[first]
    return windows, owner, np.unique(hash_windows(words, config.run)[0])


def document_windows(texts: list[str | None], known_run, config: LeakConfig) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the texts, each once a text, that hold a run of words that an item has too, and the text of each.

    A window that can match has such a run. It is longer than an item's by the
    edits; past the text's end are zeros. known_run tells whether hashes are known.
    """
    words = hash_words(texts)
    k, e, n, run = config.window, config.edits, len(words.hashes), config.run
    starts = _starts(words, k - e)
    none = np.zeros((0, k + e), dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if not len(starts):
        return none
    doc = words.document_of()
    at = np.zeros(n, dtype=np.int64)
    hashes, _ = hash_windows(words, run)
    at[_starts(words, run)] = known_run(hashes)
    before = np.concatenate([[0], np.cumsum(at)])
    starts = starts[before[np.minimum(starts + k + e - run + 1, n)] > before[starts]]
    if not len(starts):
        return none
    span = starts[:, None] + np.arange(k + e)
    same = np.concatenate([doc, np.full(2 * e, -1)])[span] == doc[starts][:, None]
    windows, owner = np.where(same, np.concatenate([words.hashes, np.zeros(2 * e, dtype=np.uint64)])[span], U64(0)), doc[starts]
    _, first = np.unique(np.column_stack([owner.astype(np.uint64), windows]), axis=0, return_index=True)
    first.sort()
    return windows[first], owner[first]


class _Items:
    """The windows of all items by their keys."""

    def __init__(self, ids: np.ndarray, texts: list[str], config: LeakConfig):
        self.config = config
        self.windows, passage, self.runs = item_windows(texts, config)
        self.owner = ids[passage] if len(passage) else np.zeros(0, dtype=np.int64)
        size, draws = config.draws
        keys, good = sample_keys(embed(self.windows), size, draws, config.edits)
        # of each draw: the distinct keys in order, where the rows of each begin, the rows
        self.draws = []
        for r in range(draws):
            rows = np.flatnonzero(good[:, r])
            rows = rows[np.argsort(keys[rows, r], kind="stable")]
            mine = keys[rows, r]
            begin = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, dtype=np.int64)
            self.draws.append((mine[begin], np.append(begin, len(mine)), rows))

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.runs):
            return np.zeros(len(hashes), dtype=bool)
        return self.runs[np.minimum(np.searchsorted(self.runs, hashes), len(self.runs) - 1)] == hashes

    def found_in(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of a text and id of an item that leaked into it, each pair once."""
        config, none = self.config, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        if not len(self.windows):
            return none
        windows, doc = document_windows(texts, self.knows, config)
        if not len(windows):
            return none
        # windows that several texts share are compared once
        distinct, of = np.unique(windows, axis=0, return_inverse=True)
        size, draws = config.draws
        # the walk over a window begins with the walks over its beginnings
        keys, good = sample_keys(embed(distinct, WALK * config.window), size, draws, config.edits)
        met = [np.zeros(0, dtype=np.int64)]
        for r, (known, begin, rows) in enumerate(self.draws):
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[:, r]), len(known) - 1)
            mine = np.flatnonzero((known[at] == keys[:, r]) & good[:, r])
            low, count = begin[at[mine]], begin[at[mine] + 1] - begin[at[mine]]
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            met.append(np.repeat(mine, count) * len(self.windows) + rows[np.repeat(low, count) + offset])
        pair = np.sort(np.concatenate(met))
        pair = pair[np.diff(pair, prepend=-1) > 0]
        mine, theirs = pair // len(self.windows), pair % len(self.windows)
        near = sharing_piece(distinct, mine, self.windows, theirs, config.edits)
        mine, theirs = mine[near], theirs[near]
        ok = within_edits(distinct[mine], self.windows[theirs], config.edits, 2 * config.edits)
        hit = np.unique(np.column_stack([mine[ok], self.owner[theirs[ok]]]), axis=0)
        low, high = np.searchsorted(hit[:, 0], of.ravel(), "left"), np.searchsorted(hit[:, 0], of.ravel(), "right")
        count = high - low
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found = np.unique(np.column_stack([np.repeat(doc, count), hit[np.repeat(low, count) + offset, 1]]), axis=0)
        return found[:, 0], found[:, 1]


def leaked_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_cols: tuple[str, ...] = ("query_text", "reference_answer"), config: LeakConfig = LeakConfig()) -> DataFrame:
    """id_col, item_id_col of each document and item that leaked into it.

    Words are runs of ASCII letters and digits after lower-casing. An item leaked
    if ``window`` consecutive words of one of its texts are, but for ``edits`` words
    inserted, dropped or replaced, consecutive in the document. Null and short texts and items
    give no rows; item ids are integers. Each pair comes out once, also if rows or
    items occur again.
    """
    fields = items.select(F.col(item_id_col).cast("long").alias("_item"), F.explode(F.array(*(F.col(c) for c in item_cols))).alias("_passage"))
    fields = fields.filter(F.col("_passage").isNotNull() & F.col("_item").isNotNull()).distinct()
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    size = fields.agg(F.sum(F.length("_passage") + 20)).first()[0] or 0
    if size > config.index_chars:
        found = _joined(base, fields, config)
    else:
        rows = sorted((r[0], r[1]) for r in fields.collect())  # at most index_chars of text
        held = df.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), [r[1] for r in rows]))
        found = _search(base, held, config).select("_id", F.explode("_items").alias("_item"))
    return found.distinct().select(F.col("_id").alias(id_col), F.col("_item").alias(item_id_col))


_built: dict[str, _Items] = {}


def _search(base: DataFrame, held, config: LeakConfig) -> DataFrame:
    key = uuid4().hex  # workers outlive a query

    @arrow_once("array<bigint>")
    def search(texts: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = _Items(*held.value, config)
        items = _built[key]
        docs, owners = [], []
        for begin in range(0, len(texts), 1024):
            values = texts.slice(begin, 1024).to_pylist()
            for a, b in chunks(values):
                doc, item = items.found_in(values[a:b])
                docs.append(doc + begin + a)
                owners.append(item)
        doc = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(owners) if owners else [], pa.int64()))

    return base.select("_id", search("_text").alias("_items")).filter(F.size("_items") > 0)


_KEYED = "array<struct<window:array<bigint>,keys:array<bigint>>>"


def _keyed(windows: np.ndarray, owner: np.ndarray, n: int, config: LeakConfig) -> pa.Array:
    """For each of n texts its windows with their keys."""
    size, draws = config.draws
    keys, good = sample_keys(embed(windows, WALK * config.window), size, draws, config.edits)
    lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))
    m, width = windows.shape
    each = pa.StructArray.from_arrays([lists(windows.ravel(), np.arange(m + 1) * width), lists(keys[good], np.concatenate([[0], np.cumsum(good.sum(axis=1))]))], ["window", "keys"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), each)


def _joined(base: DataFrame, fields: DataFrame, config: LeakConfig) -> DataFrame:
    """_id, _item of each leak, for any number of items: windows meet in a shuffle on their keys.

    A map of bits, of a fixed size, tells the documents which runs of words the
    items have, so only windows that share one are keyed and shuffled.
    """

    @arrow_once("array<bigint>")
    def runs(texts: pa.Array) -> pa.Array:
        words = hash_words(texts.to_pylist())
        found, of = hash_windows(words, config.run)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), pa.array((found >> U64(64 - BITS)).view(np.int64)))

    @arrow_once(_KEYED)
    def item_keys(texts: pa.Array) -> pa.Array:
        windows, owner, _ = item_windows(texts.to_pylist(), config)
        return _keyed(windows, owner, len(texts), config)

    bit = fields.select(F.explode(runs("_passage")).alias("_bit")).select((F.col("_bit") + 1).alias("_bit")).distinct()  # buckets count bits from 1
    maps = bit.groupBy(F.bitmap_bucket_number("_bit").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map")).collect()  # 2**BITS bits in all
    held, name = base.sparkSession.sparkContext.broadcast({r["_b"]: bytes(r["_map"]) for r in maps}), uuid4().hex

    @arrow_once(_KEYED)
    def document_keys(texts: pa.Array) -> pa.Array:
        known = _bitmap(name, held)
        out = []
        for begin in range(0, len(texts), 1024):
            values = texts.slice(begin, 1024).to_pylist()
            for a, b in chunks(values):
                out.append(_keyed(*document_windows(values[a:b], known, config), b - a, config))
        return pa.concat_arrays(out) if out else _keyed(np.zeros((0, config.window + config.edits), dtype=np.uint64), np.zeros(0, dtype=np.int64), 0, config)

    @arrow_once("boolean")
    def close(mine: pa.Array, theirs: pa.Array) -> pa.Array:
        a, b = (x.flatten().to_numpy().view(np.uint64).reshape(len(x), -1) for x in (mine, theirs))
        return pa.array(within_edits(a, b, config.edits, 2 * config.edits)) if len(a) else pa.array([], pa.bool_())

    def exploded(rows: DataFrame, key: str, keyed, text: str, window: str) -> DataFrame:
        return rows.select(key, F.explode(keyed(text)).alias("_w")).select(key, F.col("_w.window").alias(window), F.explode("_w.keys").alias("_key"))

    theirs = cut(exploded(fields, "_item", item_keys, "_passage", "_theirs"))
    # a passage that a third of the documents have: each window of it meets the items once, whoever has it
    mine = cut(base.select("_id", F.explode(document_keys("_text")).alias("_w")).select("_id", "_w.*"))
    distinct = mine.groupBy("window").agg(F.first("keys").alias("keys"))
    met = distinct.select(F.col("window").alias("_mine"), F.explode("keys").alias("_key")).join(theirs, "_key").select("_mine", "_theirs", "_item").distinct()
    near = met.filter(close("_mine", "_theirs")).select(F.col("_mine").alias("window"), "_item").distinct()
    return mine.select("_id", "window").join(near, "window").select("_id", "_item")


def _bitmap(name: str, held):
    """Whether hashes are in the map of bits that was sent."""
    if name not in _maps:
        _maps.clear()
        whole = np.zeros(1 << (BITS - 3), dtype=np.uint8)
        for bucket, part in held.value.items():
            whole[(bucket - 1) * len(part) : bucket * len(part)] = np.frombuffer(part, dtype=np.uint8)
        _maps[name] = whole
    whole = _maps[name]

    def known(hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> U64(64 - BITS)).astype(np.int64)
        return (whole[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    return known


_maps: dict[str, np.ndarray] = {}
