"""Languages of short texts, by profiles of character n-grams.

The profiles are learned from the data: texts in which the frequent words of one
language stand out are counted by their n-grams and words, and the frequent words
themselves count besides. A text's language is the one whose profile makes its
n-grams most likely. Scripts that belong to one language need no profile.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import arrow_once
from ._texts import U64, chunks, mix, powers

BITS = 16  # of a feature's bucket
SIZES = (2, 3, 4)
WORD_COUNT = 30.0  # what a frequent word counts for its own sake
SMOOTH = 0.5
WORD_WEIGHT = 6.0  # of log likelihood that a frequent word adds, since technical terms stay in their own language
LEAST_MARGIN = 12.0  # of log likelihood, by which a language must lead
LEAST_WORDS = 5  # of a text whose language its words tell
MAX_LANGUAGES = 200

_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[一-鿿]")
_SCRIPTS = {"ru": re.compile(r"[Ѐ-ӿ]"), "ar": re.compile(r"[؀-ۿ]"), "ko": re.compile(r"[가-힯]"), "el": re.compile(r"[Ͱ-Ͽ]"), "hi": re.compile(r"[ऀ-ॿ]"), "he": re.compile(r"[֐-׿]"), "th": re.compile(r"[฀-๿]")}


def script_language(text: str) -> str | None:
    """The language that most of a text's letters belong to by their script alone."""
    if text.isascii():
        return None
    letters = sum(map(str.isalpha, text))
    if not letters:
        return None
    han, kana = len(_HAN.findall(text)), len(_KANA.findall(text))
    if han + kana > 0.3 * letters:
        return "ja" if kana else "zh"
    return next((lang for lang, rx in _SCRIPTS.items() if len(rx.findall(text)) > 0.5 * letters), None)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """What takes part in n-grams: letters, and marks such as an opening question mark; by code, the last for all beyond."""
    return np.array([chr(c).isalpha() or 0xA0 < c < 0xC0 for c in range((1 << 16) - 1)] + [True])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams and words of texts, and the text of each, in order.

    Runs of anything but letters are one space; n-grams do not leave their text.
    """
    code = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # lower-casing may lengthen a text: texts are told by the line feeds between them
    lengths = [len(t.lower()) + 1 for t in texts]
    of = np.repeat(np.arange(len(texts)), lengths)[: len(code)]
    letter = _letters()[np.minimum(code, (1 << 16) - 1)]
    keep = letter | np.concatenate([[False], letter[:-1]])
    code, of, letter = np.where(letter, code, 32)[keep].astype(np.uint64), of[keep], letter[keep]
    if not len(code):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # the space that ended a text's last word begins the next text's first
    buckets, owners = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        acc = np.full(len(code) - n + 1, U64(n))
        for i in range(n):
            acc = acc * U64(0x9E3779B97F4A7C15) + code[i : len(code) - n + 1 + i]
        inside = of[: len(code) - n + 1] == of[n - 1 :]
        buckets.append(mix(acc[inside]))
        owners.append(of[: len(code) - n + 1][inside])
    begin = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    inside = np.flatnonzero(letter)
    word = np.cumsum(np.isin(inside, begin)) - 1
    local = inside - begin[word]
    hashed = np.zeros(len(begin), dtype=np.uint64)
    np.add.at(hashed, word, mix(code[inside]) * powers(int(local.max(initial=0)) + 1)[local])
    buckets.append(mix(hashed ^ U64(0xC0FFEE)))
    owners.append(of[begin])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (bucket[order] >> U64(64 - BITS)).astype(np.int64), owner[order]


@dataclass
class Languages:
    """Names and the log likelihood of each feature in each of them."""

    names: list[str]
    likelihood: np.ndarray

    def of(self, texts: list[str]) -> list[str | None]:
        """The language of each text, or None where it does not show."""
        out = [script_language(t) for t in texts]
        if len(self.names) < 2:
            return out  # nothing to tell apart
        rest = [i for i, lang in enumerate(out) if lang is None]
        if rest:
            bucket, owner = features([texts[i] for i in rest])
            score = np.stack([np.bincount(owner, row[bucket], len(rest)) for row in self.likelihood], axis=1)
            best = score.argmax(axis=1)
            lead = score[np.arange(len(rest)), best]
            if len(self.names) > 1:
                lead = lead - np.partition(score, -2, axis=1)[:, -2]
            for i, b, m in zip(rest, best.tolist(), lead.tolist()):
                if m >= LEAST_MARGIN and len(_WORD.findall(texts[i])) >= LEAST_WORDS:
                    out[i] = self.names[b]
        return out


def by_words(text: str, words: dict[str, tuple[str, ...]]) -> str | None:
    """The language whose frequent words stand out in a text: at least two, and half as many again as of any other."""
    score: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        for lang in words.get(w, ()):
            score[lang] = score.get(lang, 0.0) + 1.0 / len(words[w])
    if not score:
        return None
    best = max(sorted(score), key=score.get)
    second = max((v for k, v in score.items() if k != best), default=0.0)
    return best if score[best] >= 2 and score[best] > 1.5 * second else None


def learn(texts: DataFrame, text_col: str, words: list[tuple[str, str]]) -> Languages:
    """Profiles from all texts of a table and the frequent words (language, word).

    Counts are summed over the cluster; 2**BITS numbers a language come to the
    driver. Null texts and words are passed over. More than MAX_LANGUAGES are an error.
    """
    names = sorted({lang for lang, w in words if lang and w})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return Languages([], np.zeros((0, 1 << BITS), dtype=np.float32))
    lookup: dict[str, tuple[str, ...]] = {}
    for lang, w in sorted({(lang, w.lower()) for lang, w in words if lang and w}):
        lookup[w] = (*lookup.get(w, ()), lang)
    held = texts.sparkSession.sparkContext.broadcast(lookup)

    @arrow_once("array<struct<lang:string,bucket:int>>")
    def counted(values: pa.Array) -> pa.Array:
        langs, buckets, sizes = [], [], [np.zeros(1, dtype=np.int64)]
        for begin in range(0, len(values), 1024):
            part = [v or "" for v in values.slice(begin, 1024).to_pylist()]
            for a, b in chunks(part):
                known = [by_words(t, held.value) for t in part[a:b]]
                bucket, owner = features([t if lang else "" for t, lang in zip(part[a:b], known)])
                langs.extend(known[i] for i in owner.tolist())
                buckets.append(bucket)
                sizes.append(np.bincount(owner, minlength=b - a))
        flat = np.concatenate(buckets) if buckets else np.zeros(0, dtype=np.int64)
        each = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(flat.astype(np.int32))], ["lang", "bucket"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), each)

    rows = texts.select(F.explode(counted(F.col(text_col))).alias("_f")).groupBy("_f.lang", "_f.bucket").agg(F.count(F.lit(1)).alias("n"))
    count = np.zeros((len(names), 1 << BITS))
    table = rows.toArrow().to_pydict()  # at most 2**BITS rows a language
    if table["lang"]:
        np.add.at(count, (np.searchsorted(names, table["lang"]), np.array(table["bucket"])), np.array(table["n"], dtype=float))
    for i, lang in enumerate(names):
        own = [w for w, langs in lookup.items() if lang in langs]
        bucket, owner = features(own)
        np.add.at(count[i], bucket, WORD_COUNT / np.array([len(lookup[w]) for w in own])[owner])
    seen = count.sum(axis=0) > 0
    likelihood = np.log(count + SMOOTH) - np.log(count.sum(axis=1, keepdims=True) + SMOOTH * max(seen.sum(), 1))
    likelihood[:, ~seen] = 0.0  # what nobody has said speaks for none
    for w, langs in lookup.items():
        likelihood[np.searchsorted(names, langs), features([w])[0][-1]] += WORD_WEIGHT / len(langs)
    return Languages(names, likelihood.astype(np.float32))
