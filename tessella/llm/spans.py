"""Substring dedup by sliding sentence spans.

A text is cut into sentences after ``.``, ``!`` or ``?`` followed by white space, after full-width ends, and at line
breaks. A sentence of more than ``LONG`` words is cut further after commas, after words picked by their own hash and after
``MOST`` words at the latest, so that a passage pasted into the middle of a sentence finds its cuts again. Words are runs
without white space; in scripts that set no spaces, every character with the marks after it is one. At every sentence starts a
span: the shortest run of at least ``SENTENCES`` sentences and ``WORDS`` words. A span that stands in several documents is
kept where the doc_id is smallest, one that repeats inside a document at its first place; every sentence that any
other occurrence covers is removed.

Spans are compared by 64-bit hashes of their lower-cased words. Only (hash, doc_id) pairs are shuffled, once for
each document that holds the span: counts and smallest ids are pre-aggregated, and in the join back the most frequent
spans, a bounded number, are broadcast, so a passage that a third of all documents share lands in no single task.

Defined cases: null and empty texts come back as they are; rows that share a doc_id count as one document; a null
doc_id takes part in no comparison between documents; extra columns pass through; columns named n_sentences or
n_removed are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import staged, with_groups

SENTENCES = 3
WORDS = 20
LONG = 12
#: A word of a long sentence whose hash this divides ends a piece of it.
ONE_IN = 6
#: A piece ends after so many words at the latest, counted from a cut that the words themselves make.
MOST = 16
#: Characters analysed in one piece; texts are never split, so a longer one is a piece of its own.
PIECE = 300_000
_ENDS, _CLOSERS, _COMMAS = ".!?…。！？｡", "\"'”’)]»」』）】〉》", ",，、､"
#: First and last code points of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, ideographs.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """By code point: lower case of one character, white space, sentence ends, closing marks, commas, words of their own, full-width marks."""
    if not _TABLES:
        every = [chr(c) for c in range(65536)]
        _TABLES["lower"] = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in every], dtype=np.uint32)
        _TABLES["blank"] = np.array([x.isspace() for x in every])
        _TABLES["ends"] = np.array([x in _ENDS for x in every])
        _TABLES["closers"] = np.array([x in _CLOSERS for x in every])
        _TABLES["commas"] = np.array([x in _COMMAS for x in every])
        _TABLES["solo"] = np.array([any(a <= c <= b for a, b in _UNSPACED) and unicodedata.category(x)[0] != "M" for c, x in enumerate(every)])
        _TABLES["mark"] = np.array([unicodedata.category(x)[0] == "M" for x in every])
        _TABLES["wide"] = np.array([0x3000 <= c <= 0x303F or 0xFF00 <= c <= 0xFF65 and not x.isalnum() for c, x in enumerate(every)])
    return _TABLES


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_TABLES.get("powers", ())) < n:
        for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
            _TABLES[name] = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, base, dtype=np.uint64)]))
    return _TABLES["powers"][:n], _TABLES["inverses"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@dataclass
class Cut:
    """Sentences of some texts, and their spans. Ends are counted in characters from each text's start."""

    doc: np.ndarray
    end: np.ndarray
    span_first: np.ndarray
    span_end: np.ndarray
    span_hash: np.ndarray

    def first_places(self) -> np.ndarray:
        """Of each span, whether none before it in the same text is equal."""
        order = np.lexsort((self.span_first, self.span_hash, self.doc[self.span_first]))
        d, h = self.doc[self.span_first][order], self.span_hash[order]
        first = np.ones(len(order), dtype=bool)
        first[order[1:]] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        return first


def _runs(stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last and first word of each piece."""
    final = np.flatnonzero(stop)
    return final, np.concatenate([[0], final[:-1] + 1])


def analyse(texts: list[str]) -> Cut:
    """Sentences and spans of several texts at once."""
    none = np.zeros(0, dtype=np.int64)
    t = _tables()
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(points, 65535)
    blank = t["blank"][small]
    solo = t["solo"][small] | (points > 65535) & (points >= _UNSPACED[-1][0]) & (points <= _UNSPACED[-1][1])
    starts = ~blank & np.append(True, blank[:-1])
    if solo.any():
        # Such a character starts a word, and after one, or its marks, another letter does.
        wide = solo | t["wide"][small]
        after = np.append(False, wide[:-1]) & ~wide & ~blank & ~t["ends"][small] & ~t["closers"][small] & ~t["commas"][small]
        after[points > 767] &= ~t["mark"][small[points > 767]]
        starts |= solo | after
    start = np.flatnonzero(starts)
    end = np.flatnonzero(~blank & np.append(starts[1:] | blank[1:], True)) + 1
    if not len(start):
        return Cut(none, none, none, none, none.copy())
    low = np.where(points > 65535, points, t["lower"][small]).astype(np.uint64)
    low[blank] = 0
    length = end - start
    at = np.arange(len(points)) - np.repeat(start, np.diff(np.append(start, len(points)))) if start[0] == 0 else None
    if at is None:
        at = np.arange(len(points))
        at[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(points))))
    at[blank] = 0
    powers, _ = _powers(int(length.max()) + 1)
    word = _mix(np.add.reduceat((low + np.uint64(1)) * ~blank * powers[at], start) + length.astype(np.uint64))
    last, before = small[end - 1], small[np.maximum(end - 2, 0)]
    lines = np.cumsum(points == 10)
    following = np.append(start[1:], len(points) - 1)
    stop = t["ends"][last] | t["closers"][last] & t["ends"][before] & (length > 1) | (lines[following] > lines[end - 1])
    stop[-1] = True
    sentence = np.cumsum(stop) - stop
    long = np.bincount(sentence) > LONG
    stop |= long[sentence] & (t["commas"][last] | (word % np.uint64(ONE_IN) == 0))
    final, first = _runs(stop)
    stop |= (np.arange(len(stop)) - np.repeat(first, final + 1 - first)) % MOST == MOST - 1
    final, first = _runs(stop)
    doc = np.searchsorted(begin, start[first], side="right") - 1
    limit = begin[doc] + sizes[doc]
    ends = np.minimum(np.append(start[first[1:]], len(points)), limit) - begin[doc]
    n = len(final)
    total = np.append(0, final + 1)
    i = np.arange(n)
    j = np.maximum(i + SENTENCES, np.searchsorted(total, total[:-1] + WORDS))
    whole = j <= n
    i, j = i[whole], j[whole]
    whole = doc[i] == doc[j - 1]
    i, j = i[whole], j[whole]
    powers, inverses = _powers(len(word) + 1)
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word * powers[: len(word)])])
    a, b = total[i], total[j]
    hashed = _mix((prefix[b] - prefix[a]) * inverses[a] + (b - a).astype(np.uint64))
    return Cut(doc, ends, i, j, hashed.view(np.int64))


def pieces(texts: list[str]) -> Iterator[slice]:
    """Slices of neighbouring texts, about ``PIECE`` characters each."""
    begin = n = 0
    for k, x in enumerate(texts):
        n += len(x)
        if n >= PIECE or k + 1 == len(texts):
            yield slice(begin, k + 1)
            begin, n = k + 1, 0


def _own_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
        for part in pieces(texts):
            cut = analyse(texts[part])
            once = cut.first_places()
            yield pd.DataFrame({"h": cut.span_hash[once], "doc_id": ids[part][cut.doc[cut.span_first[once]]]})


def strip(texts: list[str | None], repeated: list[np.ndarray | None]) -> list[tuple[str | None, int, int]]:
    """Each text without the sentences that its ``repeated`` spans, or later places of a span, cover; all and removed sentences."""
    cut = analyse([x or "" for x in texts])
    later = ~cut.first_places()
    owner = cut.doc[cut.span_first]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, given in enumerate(repeated):
        if given is not None and len(given):
            own = slice(bounds[k], bounds[k + 1])
            later[own] |= np.isin(cut.span_hash[own], given)
    depth = np.zeros(len(cut.doc) + 1, dtype=np.int64)
    np.add.at(depth, cut.span_first[later], 1)
    np.add.at(depth, cut.span_end[later], -1)
    gone = np.cumsum(depth[:-1]) > 0
    bounds = np.searchsorted(cut.doc, np.arange(len(texts) + 1))
    out: list[tuple[str | None, int, int]] = []
    for k, text in enumerate(texts):
        own = slice(bounds[k], bounds[k + 1])
        n, removed = bounds[k + 1] - bounds[k], int(gone[own].sum())
        if removed:
            ends = cut.end[own].tolist()
            text = "".join(text[a:b] for a, b, x in zip([0, *ends], ends, gone[own]) if not x)
        out.append((text, int(n), removed))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated sentences taken out of text, and n_sentences and n_removed."""
    kept = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed", "_spans", "_cut")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    own = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null").mapInPandas(_own_spans, "h long, doc_id long")
    shared = staged(own.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1"), "spans")
    later = with_groups(own, shared, "h", F.xxhash64("doc_id", "h")).filter("doc_id > first_id").groupBy("doc_id").agg(F.collect_set("h").alias("_spans"))

    def cut(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, repeated in rows:
            given, spans_of = texts.tolist(), repeated.tolist()
            done = [row for part in pieces([t or "" for t in given]) for row in strip(given[part], spans_of[part])]
            yield pd.DataFrame(done, columns=["text", "n_sentences", "n_removed"])

    stripped = F.pandas_udf(cut, "text string, n_sentences long, n_removed long").asNondeterministic()
    joined = docs.join(later.hint("shuffle_hash"), "doc_id", "left").withColumn("_cut", stripped("text", "_spans"))
    return joined.select(
        *(F.col("_cut.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in kept), F.col("_cut.n_sentences").alias("n_sentences"), F.col("_cut.n_removed").alias("n_removed")
    )
