"""SimHash near-duplicates by anchor-point covering.

The 64 bits are three blocks of 21, 21 and 22. Two fingerprints that differ in at most ``4`` bits differ in at
most one bit of some block, since 3 x 2 > 4. In each block the anchors are the codewords of the perfect binary
Golay code of length 23 (blocks are padded with zeros), whose covering radius is 3: a fingerprint is at home at
the one anchor within distance 3, and is replicated to every anchor within 3 + 1. Whoever differs from it in one
bit of the block stands at its home anchor too, so comparing the homes of an anchor with all its replicas
misses no pair. Only distinct fingerprints are compared; documents that share one follow it.

Beyond ``WIDE_FROM`` distinct fingerprints an anchor is a pair of codewords, one in each of two blocks, of which there
are 2**24: of three pairs of blocks, one holds at most two of the four differing bits, so whoever is near stands within
3 + e and 3 + f of the home's codewords with e + f at most 2. That takes about 183 replicas of a fingerprint instead
of 16, but a 4096th of the comparisons. Both ways find the same links.

An anchor with more rows than ``BLOCK`` is dealt over pairs of row blocks, so no task holds more than two
blocks. A task gives back a spanning forest of the links it finds, never all pairs.

Defined cases: a null or wordless text has fingerprint zero and links like any other; repeated rows and ties
follow the smallest doc_id; a null doc_id is judged like a document of its own that no group is named after:
it gets its fingerprint, and the component of the documents near it, or null if there is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.shared import staged, with_groups

SHINGLE = 4
MAX_BITS = 4
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Rows of one anchor that are compared in one piece.
BLOCK = 4096
#: From so many distinct fingerprints on, single blocks would be split into more pieces than pairs of blocks have replicas.
WIDE_FROM = 30_000_000
#: Neighbouring small anchors that share a call, of thousands (single blocks) and of millions (pairs).
CELL, WIDE_CELL = 16, 64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_TABLES: dict[str, np.ndarray] = {}


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, 42)]
    else:
        hashes = [digest(line[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends[:-shingle])], ends[shingle - 1 :])]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _tables() -> dict[str, np.ndarray]:
    """Of the [23, 12] Golay code: the codeword of each message, each syndrome's error, the words of weight 4 by syndrome."""
    if not _TABLES:
        generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a fixed value
        rest = np.arange(1 << 12, dtype=np.uint32) << 11
        remainder = rest.copy()
        for bit in range(22, 10, -1):
            remainder = np.where(remainder >> bit & 1, remainder ^ np.uint32(generator << (bit - 11)), remainder)
        code = rest | remainder
        unit = np.array([remainder[1 << (i - 11)] if i >= 11 else 1 << i for i in range(23)], dtype=np.uint32)
        error = np.zeros(1 << 11, dtype=np.uint32)
        heavier: dict[int, list[list[int]]] = {w: [[] for _ in range(1 << 11)] for w in (4, 5)}
        for weight in range(1, 6):
            for bits in combinations(range(23), weight):
                word = syndrome = 0
                for i in bits:
                    word |= 1 << i
                    syndrome ^= int(unit[i])
                if weight <= 3:
                    error[syndrome] = word
                else:
                    heavier[weight][syndrome].append(word)
        _TABLES["unit"], _TABLES["error"], _TABLES["code"] = unit, error, code
        for weight, words in heavier.items():
            width = max(map(len, words))
            _TABLES[f"weight {weight}"] = np.array([w + [0] * (width - len(w)) for w in words], dtype=np.uint32)
    return _TABLES


def _codewords(prints: np.ndarray, low: int, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the codewords within 3 bits of a block, at 4 and at 5 bits: for each, (words, which of them count) by row."""
    t = _tables()
    block = (prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32)
    syndrome = np.zeros(len(block), dtype=np.uint32)
    for i in range(width):
        syndrome ^= np.where(block >> np.uint32(i) & np.uint32(1), t["unit"][i], np.uint32(0))
    out = [(((block ^ t["error"][syndrome]) >> np.uint32(11)).astype(np.int32)[:, None], np.ones((len(block), 1), dtype=bool))]
    for weight in (4, 5):
        more = t[f"weight {weight}"][syndrome]
        out.append((((block[:, None] ^ more) >> np.uint32(11)).astype(np.int32), more != 0))
    return out


def anchors(prints: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every replica of uint64 fingerprints; anchors are below 3 * 2**12, or 3 * 2**24 if wide."""
    blocks = [_codewords(prints, *b) for b in BLOCKS]
    rows, names, homes = [], [], []

    def found(at: np.ndarray, anchor: np.ndarray, home: bool) -> None:
        rows.append(at)
        names.append(anchor)
        homes.append(np.full(len(at), home))

    if not wide:
        for b, near in enumerate(blocks):
            for distance in (0, 1):
                words, counts = near[distance]
                at, which = np.nonzero(counts)
                found(at, words[at, which] + b * 4096, distance == 0)
    else:
        for k, (a, b) in enumerate(combinations(range(3), 2)):
            for e, f in ((e, f) for e in range(3) for f in range(3 - e)):
                (wa, ca), (wb, cb) = blocks[a][e], blocks[b][f]
                at, i, j = np.nonzero(ca[:, :, None] & cb[:, None, :])
                found(at, (k << 24) + (wa[at, i] << 12) + wb[at, j], e == f == 0)
    return np.concatenate(rows), np.concatenate(names), np.concatenate(homes)


def forest(prints: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """For each fingerprint the least index that links of left with right lead to; ``left``, ``right``: indices."""
    label = np.arange(len(prints))
    other = prints[right]
    for i in left:
        near = right[np.bitwise_count(other ^ prints[i]) <= most]
        met = np.unique(np.append(label[near], label[i]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column fingerprint, 16 lower-case hex digits."""

    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([f"{fingerprint(t):016x}" for t in batch], dtype=object)

    return docs.withColumn("fingerprint", F.pandas_udf(digests, "string").asNondeterministic()(F.col(text)))


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning links of a piece, or pair of pieces, of one anchor, or of several whole anchors."""
    pdf = pdf.sort_values(["anchor", "f"], ignore_index=True)
    starts = np.flatnonzero(np.diff(pdf["anchor"].to_numpy(), prepend=-1))
    ends = [*starts[1:], len(pdf)]
    f, home, own = pdf["f"].to_numpy(np.int64), pdf["home"].to_numpy(bool), pdf["own"].to_numpy()
    first, second = pdf["p"].iat[0], pdf["q"].iat[0]
    root = np.arange(len(f))
    for a, b in zip(starts, ends):
        u, h = f[a:b].view(np.uint64), home[a:b]
        if first == second:
            label = forest(u, np.flatnonzero(h), np.arange(b - a))
        else:
            label, left = np.arange(b - a), own[a:b] == first
            for x, y in ((left, ~left), (~left, left)):
                got = forest(u, np.flatnonzero(h & x), np.flatnonzero(y))
                for i in np.flatnonzero(got != np.arange(b - a)):
                    met = np.unique(label[[i, got[i]]])
                    if len(met) > 1:
                        label[label == met[1]] = met[0]
        root[a:b] = label + a
    at = np.flatnonzero(root != np.arange(len(f)))
    return pd.DataFrame({"a": f[at], "b": f[root[at]]})


def links(prints: DataFrame, wide: bool = False) -> DataFrame:
    """Spanning links (a, b) between fingerprints of ``prints`` (f long, distinct) that differ in 4 bits or fewer."""

    def replicas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                f = pdf["f"].to_numpy(np.int64)[at : at + 4096]
                row, anchor, home = anchors(f.view(np.uint64), wide)
                yield pd.DataFrame({"anchor": anchor.astype(np.int32), "home": home, "f": f[row]})

    spread = prints.mapInPandas(replicas, "anchor int, home boolean, f long")
    sizes = spread.groupBy("anchor").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / BLOCK).cast("int"))
    if wide:
        met = with_groups(spread, staged(sizes.filter("pieces > 1"), "anchors"), "anchor", F.hash("f"), outer=True).withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    else:
        # At most 3 x 4096 anchors, whatever the input: their pieces are a small table by construction.
        met = spread.join(F.broadcast(sizes.drop("n")), "anchor")
    shared = -1 - F.floor(F.col("anchor") / (WIDE_CELL if wide else CELL)).cast("int")
    cell = F.when(F.col("pieces") > 1, F.col("anchor")).otherwise(shared)
    dealt = (
        met.withColumn("cell", cell)
        .withColumn("own", F.pmod(F.xxhash64("f"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("cell", "anchor", "home", "f", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )
    # Without this, rows could stay dealt by anchor alone, and a split anchor in one task.
    return dealt.repartition("cell", "p", "q").groupBy("cell", "p", "q").applyInPandas(_compared, "a long, b long")


def near_duplicates(docs: DataFrame, groups: bool = False) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable by links, itself included) for every row of ``docs``.

    ``groups``: also component, the smallest fingerprint reachable, which tells groups apart that share a doc_id.
    """
    marked = staged(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint"), "fingerprints")
    half = lambda at: F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("long")
    signed = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    prints = staged(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).withColumn("f", signed), "prints")
    wide = prints.count() > WIDE_FROM
    joined = components(links(prints.select("f"), wide), "a", "b").withColumnRenamed("node", "f")
    grouped = prints.join(joined, "f", "left").select("fingerprint", "n", "first_id", F.coalesce("component", "f").alias("component"))
    least = staged(grouped.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "components")
    # Neither a group of very many fingerprints nor a fingerprint of very many documents fills a task.
    named = with_groups(grouped.withColumnRenamed("n", "rows"), least, "component", F.xxhash64("fingerprint")).select("fingerprint", F.col("rows").alias("n"), "component", "component_id")
    spread = F.hex(F.xxhash64("doc_id", F.monotonically_increasing_id()))
    out = with_groups(marked, staged(named, "named"), "fingerprint", spread)
    return out.select("doc_id", "fingerprint", "component_id", *["component"] * groups)
