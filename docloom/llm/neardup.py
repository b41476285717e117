"""Near-duplicate documents by fast similarity sketching.

Each document's word shingles are thrown into bins in rounds: in the first
rounds every shingle chooses its bin freely, in the last ones each round fills one
bin, so every coordinate of the sketch fills; an earlier round always beats a
later one. Bands of coordinates bring similar documents together, agreement over
the whole sketch discards chance meetings, and the rest are verified exactly on
their shingle sets. A band's key that very many documents share is worked through
in blocks, whose tasks compare sketches and give only pairs that agree.

Documents with the same sequence of words form a class that is represented by
its smallest id, so groups of copies cost one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import arrow_once, broadcast_if_small, cut
from ._texts import U64, chunks, hash_windows, hash_words, mix, sequence_hashes

BROADCAST_ROWS = 1_000_000
SKETCH_CHUNK = 1 << 19
SAMPLED = 32


@dataclass(frozen=True)
class DuplicateConfig:
    """shingle: words of a shingle; threshold: least Jaccard similarity; min_words: shorter documents have no duplicates.

    rows and bands: coordinates of a band and number of bands. A pair of
    similarity s meets with probability 1 - (1 - s**rows)**bands; the defaults
    give 0.9999 at 0.8. spread: standard deviations below the threshold at which
    the sketch still lets a pair through to verification.

    hot: documents that share a band's key from which it is compared in blocks of
    ``block`` documents; which keys are hot is told from one document in SAMPLED,
    and a key that is missed is only slower.
    """

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 5
    rows: int = 5
    bands: int = 24
    spread: float = 4.5
    hot: int = 2000
    block: int = 4096

    @property
    def least(self) -> int:
        """Bins in which the sketches of a pair must agree, of which half a byte is kept."""
        agree = self.threshold + (1 - self.threshold) / 16
        return math.floor((agree - self.spread * math.sqrt(agree * (1 - agree) / self.bins)) * self.bins)

    @property
    def bins(self) -> int:
        return self.rows * self.bands


def sketches(element: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Sketch of each of n sets: an n x bins array of hashes; sets without elements keep zeros.

    element: hashes of the sets' members, in order of their owner.
    """
    empty = np.iinfo(np.uint64).max
    filled = np.full((n, bins), empty, dtype=np.uint64)
    flat = filled.ravel()
    missing = np.bincount(owner, minlength=n) > 0
    for r in range(2 * bins):
        h = mix(element ^ U64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if r < bins:
            to = ((h >> U64(32)) * U64(bins)) >> U64(32)
            cell = owner * bins + to.astype(np.int64)
        else:
            cell = owner * bins + (r - bins)
        # the round is the upper part of the value, so an earlier round wins and a filled bin stays
        value = (U64(r) << U64(48)) | (h & U64(0xFFFFFFFFFFFF))
        open_ = flat[cell] > (U64(r) << U64(48))
        np.minimum.at(flat, cell[open_], value[open_])
        left = (filled == empty).any(axis=1) & missing
        if not left.any():
            break
        if r % 2 or r < 4:
            stay = left[owner]
            element, owner = element[stay], owner[stay]
    filled[~missing] = 0
    return filled


def _signature_type() -> str:
    return "struct<words int, fp1 bigint, fp2 bigint, bands array<bigint>, sketch binary>"


def sketch_documents(df: DataFrame, id_col: str, text_col: str, config: DuplicateConfig) -> DataFrame:
    """_id, words, fp1, fp2 (128 bits of hash of the word sequence), bands (a key each), sketch (half a byte a bin)."""

    @arrow_once(_signature_type())
    def sketch(texts: pa.Array) -> pa.Array:
        parts = []
        for begin in range(0, len(texts), 512):
            values = texts.slice(begin, 512).to_pylist()
            for a, b in chunks(values, SKETCH_CHUNK):
                words = hash_words(values[a:b])
                element, owner = hash_windows(words, config.shingle)
                s = sketches(element, owner, b - a, config.bins)
                acc = np.zeros((b - a, config.bands), dtype=np.uint64)
                for i in range(config.rows):
                    acc = mix(acc * U64(31) + s[:, i :: config.rows])
                bands = mix(acc + np.arange(1, config.bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
                parts.append((words.counts.astype(np.int32), sequence_hashes(words, 1), sequence_hashes(words, 2), bands, _packed((mix(s) >> U64(60)).astype(np.uint8))))
        if not parts:
            return pa.array([], pa.struct([("words", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]))
        words, fp1, fp2, bands, byte = (np.concatenate(x) for x in zip(*parts))
        n = len(words)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * config.bands, pa.int32()), pa.array(bands.ravel().view(np.int64)))
        raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * byte.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(byte.tobytes())])
        return pa.StructArray.from_arrays([pa.array(words), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), lists, raw], ["words", "fp1", "fp2", "bands", "sketch"])

    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_id").isNotNull() & (F.length("_text") > 0))
    made = base.select("_id", sketch("_text").alias("_s")).select("_id", "_s.*")
    return made.filter(F.col("words") >= max(config.min_words, config.shingle))


def _packed(halves: np.ndarray) -> np.ndarray:
    """Two columns of half bytes in each byte; an odd last one is by itself, the other half 0."""
    if halves.shape[1] % 2:
        halves = np.concatenate([halves, np.zeros((len(halves), 1), dtype=np.uint8)], axis=1)
    return (halves[:, ::2] << 4) | halves[:, 1::2]


def _agreeing(a: np.ndarray, b: np.ndarray, bins: int) -> np.ndarray:
    """In how many bins packed sketches agree, along the last axis."""
    differ = a ^ b
    return ((differ & 0xF0) == 0).sum(axis=-1, dtype=np.int32) + ((differ & 0x0F) == 0).sum(axis=-1, dtype=np.int32) - bins % 2


def _sketches_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _likely(pairs: DataFrame, config: DuplicateConfig) -> DataFrame:
    """Pairs whose sketches agree about as much as the threshold asks."""
    least, bins = config.least, config.bins

    @arrow_once("boolean")
    def agree(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(_agreeing(_sketches_of(x), _sketches_of(y), bins) >= least) if len(x) else pa.array([], pa.bool_())

    return pairs.filter(agree("_sa", "_sb"))


def _likely_pairs(single: DataFrame, config: DuplicateConfig) -> DataFrame:
    """_a < _b of the documents that share a band's key and whose sketches agree; single: _id, bands, sketch."""
    keyed = single.select("_id", F.explode("bands").alias("_key"))
    sample = keyed.filter(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(SAMPLED)) == 0).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    hot = cut(sample.filter(F.col("_n") * SAMPLED >= config.hot).select("_key"))
    crowded = not hot.isEmpty()
    if crowded:
        hot = broadcast_if_small(hot, BROADCAST_ROWS)
        keyed = keyed.join(hot, "_key", "left_anti")
    left, right = keyed.select("_key", F.col("_id").alias("_a")), keyed.select("_key", F.col("_id").alias("_b"))
    met = left.join(right, "_key").filter("_a < _b").select("_a", "_b").distinct()
    sketch = single.select("_id", "sketch")
    both = met.join(sketch.select(F.col("_id").alias("_a"), F.col("sketch").alias("_sa")), "_a").join(sketch.select(F.col("_id").alias("_b"), F.col("sketch").alias("_sb")), "_b")
    likely = _likely(both, config).select("_a", "_b")
    return likely.unionByName(_likely_in_blocks(single, hot, config)).distinct() if crowded else likely


def _likely_in_blocks(single: DataFrame, hot: DataFrame, config: DuplicateConfig) -> DataFrame:
    """The same of the keys in hot: their documents in blocks, every two of which are a task that gives only pairs that agree."""
    members = single.select("_id", "sketch", F.explode("bands").alias("_key")).join(hot, "_key")
    blocks = members.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / config.block).cast("int").alias("_blocks"))
    placed = members.join(broadcast_if_small(cut(blocks), BROADCAST_ROWS), "_key").withColumn("_own", F.pmod(F.xxhash64("_id", F.lit(5)), F.col("_blocks")).cast("int"))
    cells = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = cells.select("_key", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "_own", "_id", "sketch")
    least, bins = config.least, config.bins

    def compare(cell: pa.Table) -> pa.Table:
        ids, own = cell.column("_id").combine_chunks(), cell.column("_own").to_numpy()
        sketch = _sketches_of(cell.column("sketch"))
        low, high = cell.column("_low")[0].as_py(), cell.column("_high")[0].as_py()
        x, y = np.flatnonzero(own == low), np.flatnonzero(own == high)
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for begin in range(0, len(x), 64):
            rows = x[begin : begin + 64]
            i, j = np.nonzero(_agreeing(sketch[rows][:, None], sketch[y][None], bins) >= least)
            a.append(rows[i])
            b.append(y[j])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.Table.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["_a", "_b"])

    kind = dict(single.dtypes)["_id"]
    found = cells.groupBy("_key", "_low", "_high").applyInArrow(compare, f"_a {kind}, _b {kind}")
    return found.filter("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))


def _shingle_sets(df: DataFrame, config: DuplicateConfig) -> DataFrame:
    """_id, _set (distinct shingle hashes) of each row of _id, _text."""

    @arrow_once("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        values, sizes = [], [np.zeros(1, dtype=np.int64)]
        for begin in range(0, len(texts), 512):
            part = texts.slice(begin, 512).to_pylist()
            for a, b in chunks(part):
                element, owner = hash_windows(hash_words(part[a:b]), config.shingle)
                order = np.lexsort((element, owner))
                element, owner = element[order], owner[order]
                new = np.ones(len(element), dtype=bool)
                new[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
                values.append(element[new])
                sizes.append(np.bincount(owner[new], minlength=b - a))
        flat = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(flat.view(np.int64)))

    return df.select("_id", sets("_text").alias("_set"))


def _classes(df: DataFrame, id_col: str, text_col: str, config: DuplicateConfig) -> tuple[DataFrame, DataFrame]:
    """The members of classes of copies (_id, _rep) and the links (_a, _b, similarity) between representatives.

    Only classes with more than one member are in the first.
    """
    made = sketch_documents(df, id_col, text_col, config).persist(StorageLevel.MEMORY_AND_DISK)
    repeated = made.groupBy("fp1", "fp2").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    repeated = broadcast_if_small(cut(repeated), BROADCAST_ROWS)
    members = cut(made.select("_id", "fp1", "fp2").join(repeated, ["fp1", "fp2"]).select("_id", "_rep"))
    copies = broadcast_if_small(members.filter("_id <> _rep").select("_id"), BROADCAST_ROWS)
    single = made.join(copies, "_id", "left_anti")

    likely = cut(_likely_pairs(single, config))
    made.unpersist()

    involved = broadcast_if_small(cut(likely.select(F.col("_a").alias("_id")).unionByName(likely.select(F.col("_b").alias("_id"))).distinct()), BROADCAST_ROWS)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null").join(involved, "_id", "left_semi")
    sets = _shingle_sets(texts, config)
    a, b = sets.select(F.col("_id").alias("_a"), F.col("_set").alias("_x")), sets.select(F.col("_id").alias("_b"), F.col("_set").alias("_y"))
    shared = likely.join(a, "_a").join(b, "_b").select("_a", "_b", F.size("_x").alias("_p"), F.size("_y").alias("_q"), F.size(F.array_intersect("_x", "_y")).alias("_n"))
    links = shared.filter("_p > 0 and _q > 0").withColumn("similarity", F.col("_n") / (F.col("_p") + F.col("_q") - F.col("_n"))).filter(F.col("similarity") >= config.threshold)
    return members, links.select("_a", "_b", "similarity")


def near_duplicate_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: DuplicateConfig = DuplicateConfig()) -> DataFrame:
    """doc_a < doc_b, similarity of all documents that are near-duplicates.

    Similarity is that of the sets of shingles of consecutive words (runs of
    ASCII letters and digits after lower-casing). Null, empty and short texts and
    null ids have no partners. Copies are expanded into pairs of similarity 1. An
    id that occurs twice stands for all its texts.
    """
    members, links = _classes(df, id_col, text_col, config)
    members, links = cut(members), cut(links)
    left = members.select(F.col("_rep").alias("_a"), F.col("_id").alias("_ma"))
    right = members.select(F.col("_rep").alias("_b"), F.col("_id").alias("_mb"))
    wide = links.join(left, "_a", "left").join(right, "_b", "left")
    x, y = F.coalesce("_ma", "_a"), F.coalesce("_mb", "_b")
    across = wide.select(F.least(x, y).alias("doc_a"), F.greatest(x, y).alias("doc_b"), "similarity")
    within = members.select("_rep", F.col("_id").alias("doc_a")).join(members.select("_rep", F.col("_id").alias("doc_b")), "_rep").filter("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).filter("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.max("similarity").alias("similarity"))


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """_id, _root (the smallest id of its component) of all ends of links (_a, _b).

    Alternates two steps on the edges: every neighbour larger than a node is tied
    to the smallest one of the node, then every smaller one; the edges become
    stars around the smallest ids in a number of rounds logarithmic in the size.
    """
    edges = cut(links.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).filter("_u <> _v").distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        large = both.join(least, "_u").filter("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).filter("_u <> _v").distinct()
        down = large.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v"))
        least = down.groupBy("_u").agg(F.min("_v").alias("_m"))
        tied = down.join(least, "_u").filter("_v <> _m").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        edges = cut(tied.unionByName(least.select("_u", F.col("_m").alias("_v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("_u").alias("_id"), F.col("_v").alias("_root"))
    return roots.unionByName(edges.select(F.col("_v").alias("_id"), F.col("_v").alias("_root")).distinct())


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: DuplicateConfig = DuplicateConfig()) -> DataFrame:
    """id_col, class_id, links of every document.

    class_id is the smallest id of its group (itself without near-duplicates);
    links is the number of other documents that are near-duplicates of it, copies
    included. Rows with a null id are left out. Copies are not expanded into pairs.
    """
    members, links = _classes(df, id_col, text_col, config)
    members, links = cut(members), cut(links)
    roots = components(links)
    sizes = members.groupBy("_rep").agg(F.count(F.lit(1)).alias("_n"))
    ends = links.select("_a", "_b").unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    degree = ends.join(sizes, F.col("_b") == F.col("_rep"), "left").groupBy("_a").agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_to"))
    known = degree.join(roots, degree["_a"] == roots["_id"]).select(F.col("_a").alias("_rep"), "_root", "_to")
    base = df.select(F.col(id_col).alias("_id")).filter("_id is not null")
    out = base.join(members, "_id", "left").withColumn("_rep", F.coalesce("_rep", "_id")).join(sizes, "_rep", "left").join(known, "_rep", "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_root", "_rep").alias("class_id"), (F.coalesce("_to", F.lit(0)) + F.coalesce("_n", F.lit(1)) - 1).alias("links"))
