"""Statistics of a text's form, and whether it is prose, a list, a table or junk.

Lines are told apart by combined rules (bullets, cells, code, damage, common
words, sentence ends); the form is what most of the text's characters are.
Repetition is measured by duplicate lines, paragraphs and runs of words and by the
share of the characters that the most dominant n-gram covers; a text that is
little but repetition is boilerplate, and so junk.
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

FORMS = ("prose", "list", "table", "junk")


@dataclass(frozen=True)
class FormConfig:
    """min_chars: shorter texts have no form but prose; most: the share of characters that decides; dominant: the share that one n-gram covers in junk; repeated: the share of lines, paragraphs or runs of words that have occurred before in boilerplate."""

    min_chars: int = 60
    most: float = 0.5
    dominant: float = 0.6
    repeated: float = 0.75


MAX_COMMON = 1_000_000

_BULLET = re.compile(r"\s*(?:[-*•–+>]\s|\(?\d{1,4}[.)]\s|[a-z]\)\s|v?\d+\.\d+(?:\.\d+)*\s)\s*")
_STOP = re.compile(r"[.!?。！？…;][\"'”’)\]»]*$")
_INNER_STOP = re.compile(r"[.!?][\"')]?\s+[A-Z\"'¿¡]|[。！？]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ一-鿿가-힯]")
_DAMAGE = re.compile(r"�|ï¿½|â€|Ã[\x80-\xff]|Â[\x80-\xff ]|Ã.|Ð.|Ñ.")
_HEX_ROW = re.compile(r"^[0-9a-fA-F]{4,16}[: ]\s*(?:[0-9a-fA-F]{2,8}\s+){3,}|^[0-9a-fA-F]{6,8}\s*$")
_LONG_TOKEN = re.compile(r"[A-Za-z0-9+/=_%-]{30,}")
_MARKUP = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|&(?:[a-z]{2,8}|#\d{2,5});|^\s*[.#@]?[\w-]+\s*\{.*[;}]|\b(?:var|let|const) \w+\s*=|\bfunction\b[^(]{0,30}\([^)]*\)\s*\{?.*|=>\s*\{|\w+\(\);|^\s*[{\[].*[}\]],?\s*$|!important|<!--|-->")
_GAP = re.compile(r"(?<=\S)(?: {2,}|\t+)(?=\S)")
_VOWEL = re.compile(r"[aeiouyäöüéèêáíóúàâîôûœæ]", re.I)
_LETTER = re.compile(r"[^\W\d_]")
_SYMBOLS = re.compile(r"[^\w\s]")
_SENTENCE_END = re.compile(r"[^\W\d_]{2}[.!?][\"')]?(?=\s|$)")

_PROSE, _ENTRY, _CELLS, _JUNK, _LOOSE = 0, 1, 2, 3, 4
_MARKED = re.compile(r"[<>{}&!]|\(\)")


def damaged(text: str) -> bool:
    """Whether a text has marks of a wrong encoding."""
    return _DAMAGE.search(text) is not None


def _cells(line: str) -> tuple[str, int] | None:
    """The separator of a line's cells and their number, if it has cells."""
    n = line.count("\t")
    if n >= 2 and max(len(c.split()) for c in line.split("\t")) <= 7:
        return "tab", n
    n = line.count("|")
    if n >= 2 and (line.startswith("|") or line.count(" | ") >= 2 or n >= 4):
        return "pipe", n
    n = line.count(",")
    if n >= 2 and n > 2 * line.count(", "):
        return "comma", n
    n = line.count(";")
    if n >= 3 and n > 2 * line.count("; "):
        return "semicolon", n
    gaps = _GAP.findall(line) if "  " in line or "\t" in line else []
    wide = sum(len(g) > 2 for g in gaps)
    if 0 < wide < 2 and len(gaps) > 1 or not wide and len(gaps) < line.count(" ") - 2 * len(gaps):
        wide = len(gaps)  # two spaces part cells too where single ones part words
    if wide >= 2 and len(line.split()) <= 3 * (wide + 1) + 2:
        return "fixed", wide
    return None


def _kind(line: str, common: frozenset[str]) -> int:
    """What a non-empty line is by itself; prose is full of common words and entries are not."""
    n, ascii_ = len(line), line.isascii()
    tokens = line.lower().split()
    known = sum(map(common.__contains__, tokens))
    if not ascii_:
        damage = len(_DAMAGE.findall(line))
        if damage >= 2 and damage >= 0.15 * len(tokens):
            return _JUNK
        if len(_CJK.findall(line)) * 3 > n:
            return _PROSE if n >= 12 or _INNER_STOP.search(line) else _ENTRY
    if len(tokens) >= 10 and 5 * known >= len(tokens) and line.count("|") < 2:
        return _PROSE
    words = _WORD.findall(line)
    letters = sum(map(len, words))
    if _HEX_ROW.match(line):
        return _JUNK
    if n >= 30 and max(map(len, tokens)) >= 30 and "://" not in line and sum(map(len, _LONG_TOKEN.findall(line))) > 0.6 * n:
        return _JUNK
    if _MARKED.search(line):
        marks = _MARKUP.findall(line)
        if marks and (sum(map(len, marks)) > 0.3 * n or len(_SYMBOLS.findall(line)) > 0.12 * n):
            return _JUNK
    if _cells(line):
        return _CELLS
    bullet = _BULLET.match(line)
    if letters < 0.4 * n and n >= 8 and not bullet:
        return _JUNK
    if letters >= 8 and len(words) >= 3 and not known and ascii_ and len(_VOWEL.findall(line)) < 0.17 * letters:
        return _JUNK
    body = line[bullet.end() :] if bullet else line
    count = len(body.split())
    if count > 24 and known < 0.06 * count:
        return _JUNK  # words strung together
    if _INNER_STOP.search(body) and known >= 0.1 * count:
        return _PROSE
    stopped = _STOP.search(body.rstrip())
    if count >= 6 and stopped and known >= 0.12 * count:
        return _PROSE
    if count <= 16 and known < 0.26 * count + (0.5 if count <= 6 else 0):
        return _ENTRY
    if bullet and count <= 8 and not stopped:
        return _ENTRY
    return _PROSE if stopped or count > 16 else _LOOSE


def _reads_as_sentences(lines: list[str]) -> bool:
    """Whether lines, taken together, are full of sentence ends: wrapped prose, not entries."""
    words = stops = 0
    for line in lines:
        body = line[m.end() :] if (m := _BULLET.match(line)) else line
        words += len(body.split())
        stops += len(_SENTENCE_END.findall(body))
    return stops * 32 >= words


@dataclass(frozen=True)
class _Lines:
    """What the lines of a text say: its form and the statistics of its lines."""

    form: str
    ended: float
    repeated: float
    repeated_paragraphs: float


def _share_repeated(parts: list[str]) -> float:
    """The share of the characters in parts that have occurred before."""
    if len(parts) < 2 or len(set(parts)) == len(parts):
        return 0.0
    seen: set[str] = set()
    again = 0
    for p in parts:
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / sum(map(len, parts))


def _lines_of(text: str, said_again: tuple[float, float], common: frozenset[str], config: FormConfig) -> _Lines:
    lines = [s for line in text.split("\n") if (s := line.strip())]
    if not lines:
        return _Lines("prose", 0.0, 0.0, 0.0)
    ended = sum(_STOP.search(s) is not None for s in lines) / len(lines)
    repeated = _share_repeated(lines)
    repeated_paragraphs = _share_repeated(_paragraphs(text))
    return _Lines(_form(text, lines, said_again, (repeated, repeated_paragraphs), common, config), ended, repeated, repeated_paragraphs)


_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


def _paragraphs(text: str) -> list[str]:
    return [p for b in _BLANK_LINE.split(text) if (p := " ".join(b.split()))] if "\n" in text else []


def _form(text: str, lines: list[str], said_again: tuple[float, float], repeated: tuple[float, float], common: frozenset[str], config: FormConfig) -> str:
    """said_again: the shares of the dominant n-gram and of runs of words that have occurred before; repeated: of lines and paragraphs."""
    if len(text) < config.min_chars:
        return "prose"
    if max(repeated) >= config.repeated:
        return "junk"  # hardly more than a few lines or paragraphs again and again
    dominant, runs = said_again
    prose = "junk" if dominant >= config.dominant or runs >= config.repeated else "prose"  # phrases again and again
    kinds = [_kind(s, common) for s in lines]
    if not any(k in (_ENTRY, _CELLS, _JUNK) for k in kinds):
        return prose
    size = [0, 0, 0, 0, 0]
    for k, s in zip(kinds, lines):
        size[k] += len(s)
    # a loose line, such as a site's notice, says little about the rest
    total = sum(size) - size[_LOOSE] / 2
    if size[_JUNK] > config.most * total:
        return "junk"
    if size[_CELLS] > config.most * total and kinds.count(_CELLS) >= 2:
        return "table"
    if size[_ENTRY] > config.most * total and kinds.count(_ENTRY) >= 3:
        if not _reads_as_sentences([s for k, s in zip(kinds, lines) if k in (_ENTRY, _PROSE, _LOOSE)]):
            return "list"
    return prose


def forms_of(texts: list[str | None], common: frozenset[str], config: FormConfig = FormConfig()) -> list[str]:
    """prose, list, table or junk for each text."""
    return [_lines_of(t, again, common, config).form if t else "prose" for t, again in zip(texts, _repetition(hash_words(texts)).tolist())]


def form_of(text: str | None, common: frozenset[str], config: FormConfig = FormConfig()) -> str:
    """prose, list, table or junk."""
    return forms_of([text], common, config)[0]


def _repetition(words: Words) -> np.ndarray:
    """For each text two shares: of its words' characters, the largest that one n-gram (2 to 4 words, twice or more) covers; of its runs of 4 words, those that have occurred before."""
    n = len(words.offsets) - 1
    out = np.zeros((n, 2))
    of = words.document_of()
    total = np.maximum(np.bincount(of, weights=words.lengths, minlength=n), 1)
    ends = np.concatenate([[0], np.cumsum(words.lengths)])
    for k in (2, 3, 4):
        gram, doc = hash_windows(words, k)
        if not len(gram):
            continue
        # the text in the upper bits: equal neighbours after sorting are one text's n-gram
        key = (doc.astype(np.uint64) << U64(44)) | (gram >> U64(20))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([first, [len(key)]]))
        many = count > 1
        at = order[first[many]]
        inside = np.flatnonzero(of[: len(words.hashes) - k + 1] == of[k - 1 :])
        size = ends[inside[at] + k] - ends[inside[at]]
        np.maximum.at(out[:, 0], doc[at], count[many] * size / total[doc[at]])
        if k == 4:
            runs = np.bincount(doc, minlength=n)
            out[:, 1] = np.where(runs >= 8, 1 - np.bincount(doc[order[first]], minlength=n) / np.maximum(runs, 1), 0.0)
    return np.minimum(out, 1.0)


STATISTICS = "words int, mean_word_length double, symbol_share double, ended_line_share double, common_word_share double, repeated_line_share double, repeated_paragraph_share double, dominant_ngram_share double, form string"


def words_of(common_words: DataFrame, word_col: str = "word") -> frozenset[str]:
    """The distinct words of a table in lower case; more than MAX_COMMON, 1,000,000, are no common words: an error."""
    rows = common_words.select(F.lower(F.col(word_col)).alias("_w")).filter("_w is not null").distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return frozenset(r[0] for r in rows)


_RUN = re.compile(r"[^\W_]+")


def describe(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", config: FormConfig = FormConfig()) -> DataFrame:
    """id_col, the statistics and the form of every row.

    words and mean_word_length: of runs of ASCII letters and digits; symbol_share:
    of the characters, those neither white space, letter nor digit;
    common_word_share: of the runs of letters and digits of any script. A null text
    has null statistics and form; an empty one has zeros and is prose, as is a text
    of fewer than min_chars characters. Rows that occur twice come out twice.
    """
    common = words_of(common_words, word_col)
    held = df.sparkSession.sparkContext.broadcast(common)
    kind = "struct<" + STATISTICS.replace(", ", ",").replace(" ", ":") + ">"

    @arrow_once(kind)
    def statistics(texts: pa.Array) -> pa.Array:
        known = held.value
        ascii_ = np.unique(hash_words([w for w in known if w.isascii() and w.isalnum()]).hashes)
        columns: list[list] = [[] for _ in range(9)]
        for begin in range(0, len(texts), 1024):
            part = texts.slice(begin, 1024).to_pylist()
            for a, b in chunks(part):
                values = part[a:b]
                words = hash_words(values)
                doc, n = words.document_of(), b - a
                count = words.counts
                length = np.bincount(doc, weights=words.lengths, minlength=n)
                share = np.bincount(doc, weights=np.isin(words.hashes, ascii_), minlength=n) / np.maximum(count, 1)
                again = _repetition(words)
                columns[0].extend(None if v is None else int(c) for v, c in zip(values, count))
                for i, x in ((1, length / np.maximum(count, 1)), (4, share), (7, again[:, 0])):
                    columns[i].extend(None if v is None else float(y) for v, y in zip(values, x))
                for v, r in zip(values, again.tolist()):
                    if v is None:
                        row = (None,) * 5
                    else:
                        if not v.isascii():
                            runs = _RUN.findall(v.lower())
                            columns[4][len(columns[2])] = sum(map(known.__contains__, runs)) / max(len(runs), 1)
                        said = _lines_of(v, r, known, config)
                        row = (len(_SYMBOLS.findall(v)) / max(len(v), 1), said.ended, said.repeated, said.repeated_paragraphs, said.form)
                    for i, x in zip((2, 3, 5, 6, 8), row):
                        columns[i].append(x)
        types = [pa.int32(), *[pa.float64()] * 7, pa.string()]
        names = [f.split()[0] for f in STATISTICS.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return df.select(F.col(id_col).alias("_id"), statistics(F.col(text_col)).alias("_s")).select(F.col("_id").alias(id_col), "_s.*")
