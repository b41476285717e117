"""Subject areas of documents by a seeded non-negative factorisation.

The document-term matrix (words and word pairs) of a bounded sample of labelled
documents is factored into W (documents by components) and H (components by terms).
There is one anchored component a subject, seeded with the subject's own name and
description; a background component that stays at the sample's term frequencies,
and others without a subject. W holds most of its weight on those, so a subject
keeps only terms that the rest does not explain; the labels say which subjects a
document may use. Alternating multiplicative updates fit both factors.

Every document of the corpus is then solved against H in the same way: updates give
its W, and what each of its sentences, entries and rows owes to a subject under W
says which they belong to. A document's subjects are those of enough of its units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import arrow_once
from ._texts import U64, Words, chunks, hash_windows, hash_words
from .quality import damaged, forms_of, words_of


CHUNK = 1 << 17  # characters that are judged at once, so that their counts stay in the cache


@dataclass(frozen=True)
class SubjectConfig:
    """least_share: of a text's units that a subject needs.

    sample: labelled documents that are read for the fit, at most, and sample_chars:
    characters of each, at most (longer ones are left to others), which bound what
    comes to the driver; max_subjects: more are an error.
    other: components without a subject, besides the background; background: weight
    of these in every document; seeded: how much more a subject's own words weigh at
    the start; doubt: what a document may use of subjects that its labels do not
    name; taught: weight of the documents with subjects in what the other components
    learn; rounds: of updates; support: documents of the sample that a term must
    occur in. solving: rounds of updates for a document of the corpus; prior: weight
    spread over all subjects then; owed: terms' worth of a subject that a unit needs.
    prose_words and different_words: shares of a text's words from which it is surely
    no junk, so that its form need not be told.
    """

    least_share: float = 0.25
    min_chars: int = 25
    sample: int = 2000
    sample_chars: int = 20_000
    max_subjects: int = 1000
    other: int = 4
    background: float = 0.9
    seeded: float = 3.0
    taught: float = 0.5
    doubt: float = 0.02
    rounds: int = 20
    support: int = 2
    solving: int = 2
    prior: float = 0.1
    owed: float = 1.2
    prose_words: float = 0.18
    different_words: float = 0.3


_STOP = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_JOINT = re.compile(r";\s+| - ")
_ENDED = re.compile(r"[.!?:][\"')\]]*\s*$")
_INNER = re.compile(r"[a-z]{2}[.!?][\"')\]]*\s", re.I)
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_LETTERS = re.compile(r"[^\W\d_]{2}")


def units_of(text: str) -> list[str]:
    """The sentences, entries and rows of a text.

    Lines are joined where sentences run over their ends; sentences strung together
    are cut at their joints.
    """
    lines = [s for x in text.split("\n") if (s := x.strip())]
    if len(lines) > 2:
        ended = sum(_ENDED.search(x) is not None for x in lines)
        if 2 * ended < len(lines) and 3 * len(_INNER.findall(" ".join(lines))) >= len(lines):
            lines = [" ".join(lines)]
    out = []
    for line in lines:
        for s in _STOP.split(line):
            if ";" in s or " - " in s:
                out.extend(_JOINT.split(s))
            else:
                out.append(s)
    return [u for u in out if _LETTERS.search(u)]


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word pairs of units, and the unit of each."""
    pair, of = hash_windows(words, 2, seed=5)
    return np.concatenate([words.hashes, pair]), np.concatenate([words.document_of(), of])


def _weights(w: np.ndarray, mine: int, own: np.ndarray | float) -> np.ndarray:
    """Rows of W with so much weight on the subjects, the first components, and the rest on the others."""
    subjects, rest = w[:, :mine] + 1e-9, w[:, mine:] + 1e-9
    return np.concatenate([subjects * (own / subjects.sum(axis=1, keepdims=True)), rest * ((1 - own) / rest.sum(axis=1, keepdims=True))], axis=1)


def _owed(w: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How each count, 1 each, is shared among the components; h: the column of H of each count, row: its row of W."""
    part = w[row] * h
    part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
    return part


def _sums(part: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, part[:, j], n) for j in range(part.shape[1])], axis=1)


def factor(row: np.ndarray, col: np.ndarray, allowed: np.ndarray, seed: np.ndarray, config: SubjectConfig) -> tuple[np.ndarray, np.ndarray]:
    """W (documents x components) and H (components x terms) with W H close to the ones at (row, col).

    allowed: what each document may use of each subject; seed: the start of H, whose
    first row after the subjects, the background, stays as it is.
    """
    n, mine = allowed.shape
    k, terms = seed.shape
    h = seed / seed.sum(axis=1, keepdims=True)
    own = (1 - config.background) * allowed.max(axis=1, keepdims=True)  # a document without subjects has next to none
    w = _weights(np.concatenate([allowed, np.ones((n, k - mine))], axis=1), mine, own)
    teaches = allowed.max(axis=1) >= 1  # documents with subjects, which teach the other components less
    for _ in range(config.rounds):
        part = _owed(w, h.T[col], row)
        w = _sums(part, row, n)
        w[:, :mine] *= allowed
        w = _weights(w, mine, own)
        part[teaches[row], mine + 1 :] *= config.taught
        new = _sums(part, col, terms).T + 1e-9
        new /= new.sum(axis=1, keepdims=True)
        new[mine] = h[mine]
        h = new
    return w, h


@dataclass
class SubjectModel:
    """Hashes of the terms, sorted, and H: a row for each component, the subjects first."""

    subjects: list[str]
    terms: np.ndarray
    h: np.ndarray
    config: SubjectConfig
    common: frozenset[str]

    def __post_init__(self):
        self._maybe = np.zeros(1 << 18, dtype=bool)
        self._maybe[self.terms >> U64(46)] = True
        self._common = np.unique(hash_words([w for w in self.common if w.isascii() and w.isalnum()]).hashes)

    def mixture(self, texts: list[str | None]) -> list[list[str]]:
        """The subjects of each text, those with the largest share first."""
        out: list[list[str]] = [[] for _ in texts]
        units: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            if text and len(text) >= self.config.min_chars and (text.isascii() or 4 * len(_CJK.findall(text)) < len(text)):
                found = units_of(text)
                units.extend(found)
                owner.extend([i] * len(found))
        if not units or not len(self.terms):
            return out
        of, n, k = np.array(owner), len(texts), len(self.subjects)
        words = hash_words(units)
        owed = self.owed(words, of, n)
        best = owed.argmax(axis=1)
        sure = owed[np.arange(len(best)), best] >= self.config.owed
        share = np.bincount(of[sure] * k + best[sure], minlength=n * k).reshape(n, k) / np.maximum(np.bincount(of, minlength=n), 1)[:, None]
        likely = np.flatnonzero((share >= self.config.least_share).any(axis=1))
        doubtful = likely[~self.surely_prose(words, of, texts)[likely]]
        junk = {i for i, form in zip(doubtful.tolist(), forms_of([texts[i] for i in doubtful], self.common)) if form == "junk"}
        for i in likely.tolist():
            if i not in junk:
                out[i] = [self.subjects[j] for j in np.argsort(-share[i], kind="stable") if share[i, j] >= self.config.least_share]
        return out

    def surely_prose(self, words: Words, of: np.ndarray, texts: list[str | None]) -> np.ndarray:
        """Texts that cannot be junk: undamaged, full of common words and of different words.

        Junk by its lines has hardly a common word in more than half of its
        characters, and junk by repetition few different words.
        """
        n = len(texts)
        text = of[words.document_of()]
        count = np.maximum(np.bincount(text, minlength=n), 1)
        common = np.bincount(text, weights=np.isin(words.hashes, self._common), minlength=n) / count
        # the text in the upper bits: equal neighbours after sorting are one text's word
        key = np.sort((text.astype(np.uint64) << U64(44)) | (words.hashes >> U64(20)))
        new = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        different = np.bincount((new >> U64(44)).astype(np.int64), minlength=n) / count
        whole = np.array([t is not None and (t.isascii() or not damaged(t)) for t in texts], dtype=bool)
        return whole & (common >= self.config.prose_words) & (different >= self.config.different_words)

    def owed(self, words: Words, of: np.ndarray, n: int) -> np.ndarray:
        """What each unit owes to each subject, in terms, under the W of its text, one of n; of: the text of each unit."""
        term, unit = _terms(words)
        maybe = np.flatnonzero(self._maybe[term >> U64(46)])
        term, unit = term[maybe], unit[maybe]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == term)
        hit = hit[np.argsort(unit[hit], kind="stable")]
        unit, h = unit[hit], self.h[:, at[hit]]
        mine, out = len(self.subjects), np.zeros((len(words.offsets) - 1, len(self.subjects)), dtype=np.float32)
        if not len(unit):
            return out
        # counts lie in order of their units, and so of their texts: sums are over runs
        text = of[unit]
        runs = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sizes = np.diff(np.append(runs, len(text)))
        own = np.float32(1 - self.config.background)

        def shared(w: np.ndarray) -> np.ndarray:
            part = np.repeat(w.T, sizes, axis=1)
            part *= h
            part /= np.maximum(part.sum(axis=0), np.float32(1e-30))
            return part

        w = _weights(np.ones((len(runs), len(h)), dtype=np.float32), mine, own).astype(np.float32)
        for _ in range(self.config.solving):
            w = np.add.reduceat(shared(w), runs, axis=1).T
            w[:, :mine] += self.config.prior / mine
            w = _weights(w, mine, own).astype(np.float32)
        units = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        out[unit[units]] = np.add.reduceat(shared(w)[:mine], units, axis=1).T
        return out


def fit(subjects: list[tuple[str, str]], labelled: list[tuple[str, list[str]]], common: frozenset[str], config: SubjectConfig = SubjectConfig()) -> SubjectModel:
    """A model from (subject, description), (text, its subjects) and the common words that junk lacks.

    A text without subjects teaches the other components. Labels are doubted a
    little, so a wrong one is outvoted.
    """
    names = sorted({s for s, _ in subjects})
    index = {s: i for i, s in enumerate(names)}
    mine, n = len(names), len(labelled) + len(subjects)
    allowed = np.full((n, mine), config.doubt)
    units: list[str] = []
    document: list[int] = []
    for d, (text, own) in enumerate(labelled):
        found = units_of(text)
        units.extend(found)
        document.extend([d] * len(found))
        allowed[d, [index[s] for s in own if s in index]] = 1.0
    for d, (s, about) in enumerate(subjects, len(labelled)):
        units.append(f"{s.replace('_', ' ')} {about or ''}")
        document.append(d)
        allowed[d, index[s]] = 1.0
    term, unit = _terms(hash_words(units))
    vocabulary, col = np.unique(term, return_inverse=True)
    # a document counts a term once
    once = np.unique(np.array(document, dtype=np.int64)[unit] * len(vocabulary) + col)
    row, col = once // max(len(vocabulary), 1), once % max(len(vocabulary), 1)
    keep = np.bincount(col, minlength=len(vocabulary)) >= config.support
    if not keep.any():
        return SubjectModel(names, np.zeros(0, dtype=np.uint64), np.zeros((mine + 1 + config.other, 0), dtype=np.float32), config, common)
    mask = keep[col]
    row, col, vocabulary = row[mask], (np.cumsum(keep) - 1)[col[mask]], vocabulary[keep]
    count = np.bincount(col, minlength=len(vocabulary)).astype(float)
    seed = count * (1 + 0.2 * np.random.default_rng(3).random((mine + 1 + config.other, len(vocabulary))))
    seed[mine] = count
    for d, (s, _) in enumerate(subjects, len(labelled)):
        seed[index[s], col[row == d]] *= 1 + config.seeded
    _, h = factor(row, col, allowed, seed, config)
    return SubjectModel(names, vocabulary, np.ascontiguousarray(h.astype(np.float32)), config, common)


def document_subjects(df: DataFrame, labels: DataFrame, subjects: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "subject", about_col: str = "description", config: SubjectConfig = SubjectConfig()) -> DataFrame:
    """id_col, label_col: a row for each subject of each document.

    Texts that are null, short, junk or in Chinese or Japanese have no subject. The
    model is fitted on at most ``sample`` labelled documents, those with the
    smallest hashes of their ids, of at most ``sample_chars`` characters each;
    labels of unknown documents are passed over. Rows that occur twice come out
    twice. More than ``max_subjects`` subjects are an error.
    """
    rows = subjects.select(label_col, about_col).filter(F.col(label_col).isNotNull()).distinct().limit(config.max_subjects + 1).collect()
    if len(rows) > config.max_subjects:
        raise ValueError(f"more than {config.max_subjects} subjects")
    areas = sorted((r[0], r[1] or "") for r in rows)
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter("_id is not null").groupBy("_id").agg(F.array_sort(F.collect_set("_label")).alias("_labels"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(config.sample)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.length("_text") <= config.sample_chars).join(F.broadcast(chosen), "_id").limit(2 * config.sample).collect()
    model = fit(areas, [(r["_text"], list(r["_labels"])) for r in sorted(texts, key=lambda r: (r["_id"], r["_text"]))], words_of(common_words), config)
    held = df.sparkSession.sparkContext.broadcast(model)

    @arrow_once("array<string>")
    def mixture(values: pa.Array) -> pa.Array:
        out: list[list[str]] = []
        for begin in range(0, len(values), 1024):
            part = values.slice(begin, 1024).to_pylist()
            for a, b in chunks(part, CHUNK):
                out.extend(held.value.mixture(part[a:b]))
        return pa.array(out, pa.list_(pa.string()))

    found = df.select(F.col(id_col).alias("_id"), mixture(F.col(text_col)).alias("_subjects"))
    return found.select(F.col("_id").alias(id_col), F.explode("_subjects").alias(label_col))
