"""Removal of repeated byte strings by a suffix array that sampled splitters deal into buckets.

Every string of ``length`` bytes that also starts earlier (smaller doc_id, or the same document and an earlier start) is found,
and the bytes that such strings cover are taken out. A suffix array over every byte would shuffle many times the corpus, so it is
sparse: suffixes start at anchors. The anchor of a window of ``length`` bytes is the place in it whose next ``length`` // 2
bytes have the least hash, so equal windows have equal anchors; neighbouring windows share one, and the bytes of all windows of
one anchor are its block. A suffix's leading tokens are two 64-bit digests: of the anchor's bytes, and of its block.

1. Suffixes are dealt into buckets by splitters, suffixes of a sample of documents in the order (tokens, doc_id, start), so a
   passage that a third of all documents share is split like any other. Each bucket is sorted by multikey quicksort. Blocks equal
   to an earlier one in order are repeats as a whole. Blocks that share an anchor but aren't equal (edges of passages, edits)
   are asked for window by window, unless sketches of what surrounds the anchor rule it out; so is a bucket's first block,
   whose equals may lie in the bucket before.
2. The windows asked for are suffixes with all ``length`` bytes as tokens (two digests of 64 bits), dealt by range, sorted alike; the last
   suffix of each bucket is compared with the first of the next.

Both levels ask for equality of 128 bits of digests. Texts meet their repeats by a shuffle; nothing is collected but splitters.

Defined cases: a null text is empty; a null doc_id stands after all others, and rows without one, like rows that share one, count
as versions of one document: an equal start in another version is not an earlier one; empty tables give empty results; extra
columns pass through, columns named n_bytes, n_removed, n_spans or kept are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import terms
from tessella.llm.shared import freed, share_by_hash, staged

LENGTH = 100
#: Bytes that are analysed together; longer texts are analysed in parts that overlap by a window.
PIECE = 1 << 19
#: Suffixes of a bucket, about, and those that splitters are picked from, about.
BUCKET, SAMPLED = 300_000, 60_000
#: Ranges shorter than this are sorted in one step instead of being divided.
SMALL = 4_096
_NONE = np.iinfo(np.int64).max
_LOW = np.uint64(PIECE * 2 - 1)
#: A value for each byte, and odd bases, of two independent rolling hashes.
_BYTES = [terms.mixed(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (0, 1)]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SUFFIX = "bucket int, h long, b long, doc long, version long, start int, more int"
_KEYS = ("h", "b", "doc", "version", "start")
_FOUND = "kind int, doc long, version long, start int, n int"
REPEATED, ASKED = 0, 1


class Digests:
    """Hashes of all byte strings of one length, by doubling."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        self.base, self.by_size = _BASES[which], {1: _BYTES[which][data]}

    def of(self, n: int) -> np.ndarray:
        """At i, the hash of data[i:i + n]."""
        size = 1
        while size * 2 <= n:
            h = self.by_size[size]
            if size * 2 not in self.by_size:
                self.by_size[size * 2] = h[:-size] * np.uint64(pow(self.base, size, 1 << 64)) + h[size:] if len(h) > size else h[:0]
            size *= 2
        out, at = self.by_size[size], size
        while at < n:
            step = 1 << (n - at).bit_length() - 1
            then = self.by_size[step][at:]
            out = out[: len(then)] * np.uint64(pow(self.base, step, 1 << 64)) + then[: len(out)]
            at += step
        return terms.mixed(out)


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """At i, the least of values[i:i + width]."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def parts_of(begin: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, first byte, byte after the last) of what is analysed together."""
    for part in terms.pieces(begin, PIECE):
        low, high = int(begin[part.start]), int(begin[part.stop])
        for at in range(low, max(high - length + 1, low + 1), PIECE):
            yield part.start, part.stop, at, min(high, at + PIECE + length - 1)


def anchored(data: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(h, b, first window, anchor, windows, left and right sketch) of each block; ``text`` numbers the text of each byte."""
    core, n = length // 2, len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(7))
    digests = Digests(data)
    hashed = digests.of(core)
    anchor = (least_in((hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64), length - core + 1) & _LOW).astype(np.int64)[:n]
    whole = text[:n] == text[length - 1 :]
    opens = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (text[1:n] != text[: n - 1])))
    last = np.append(opens[1:], n) - 1
    opens, last = opens[whole[opens]], last[whole[opens]]
    at = anchor[opens]
    # Three strings of half a window or more reach from the block's first byte to its last.
    size = length * 2 // 3
    piece, end = digests.of(size), last + length - size
    block = np.zeros(len(opens), dtype=np.uint64)
    for places in (opens, np.minimum(opens + size, end), end):
        block = terms.mixed(block * np.uint64(5) + piece[places])
    block = terms.mixed(block + (last - opens).astype(np.uint64))
    half = (length - core) // 2
    left = digests.of(core + half)[np.maximum(at - half, 0)]
    reach = digests.of(length - half)
    right = reach[np.minimum(at, len(reach) - 1)]
    return hashed[at].view(np.int64), block.view(np.int64), opens, at, last - opens + 1, (left >> np.uint64(56)).astype(np.int64), (right >> np.uint64(56)).astype(np.int64)


def _suffixes(ids: np.ndarray, versions: np.ndarray, data: np.ndarray, begin: np.ndarray, length: int) -> Iterator[dict[str, np.ndarray]]:
    for first, after, low, high in parts_of(begin, length):
        own = np.repeat(np.arange(first, after), np.diff(np.clip(begin[first : after + 1], low, high)))
        h, b, opens, anchor, windows, left, right = anchored(data[low:high], own, length)
        of = own[opens]
        yield {
            "h": h, "b": b, "doc": ids[of], "version": versions[of], "start": (opens + low - begin[of]).astype(np.int32),
            "more": ((anchor - opens) << 24 | windows << 16 | left << 8 | right).astype(np.uint32).view(np.int32),
        }


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several columns of tokens: multikey quicksort.

    A range is divided by a pivot of its current token into less, equal and greater; only the equal part goes on to
    the next token. Small ranges are sorted in one step.
    """
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        rows = order[low:high]
        if high - low <= SMALL or depth == len(columns) - 1:
            order[low:high] = rows[np.lexsort([c[rows] for c in columns[depth:][::-1]])]
            continue
        token = columns[depth][rows]
        some = np.sort(token[:: max(1, len(token) // 63)])
        pivot = some[len(some) // 2]
        less, equal = token < pivot, token == pivot
        parts = (rows[less], rows[equal], rows[~(less | equal)])
        order[low:high] = np.concatenate(parts)
        a, b = low + len(parts[0]), low + len(parts[0]) + len(parts[1])
        todo += [(x, y, d) for x, y, d in ((low, a, depth), (a, b, depth + 1), (b, high, depth)) if y - x > 1]
    return order


def bucket_numbers(rows: dict[str, np.ndarray], splitters: dict[str, np.ndarray]) -> np.ndarray:
    """How many splitters are not above each row, by binary search over all keys."""
    n = len(splitters["h"])
    low, high = np.zeros(len(rows["h"]), dtype=np.int64), np.full(len(rows["h"]), n)
    for _ in range(n.bit_length()):
        middle = (low + high) // 2
        at = np.minimum(middle, max(n - 1, 0))
        below, tied = np.zeros(len(low), dtype=bool), np.ones(len(low), dtype=bool)
        for c in _KEYS:
            s, r = splitters[c][at], rows[c]
            below |= tied & (s < r)
            tied &= s == r
            if not tied.any():
                break
        up, open_ = (below | tied), low < high
        low, high = np.where(open_ & up, middle + 1, low), np.where(open_ & ~up, middle, high)
    return low.astype(np.int32)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where ordered rows differ from the one before."""
    out = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    out[:1] = True
    return out


def judged(rows: dict[str, np.ndarray], length: int) -> list[tuple[int, dict[str, np.ndarray]]]:
    """What a bucket tells: blocks repeated whole, and windows to be compared one by one."""
    order = multikey_order([rows[c] for c in _KEYS])
    h, b, doc, version, start, more = (rows[c][order] for c in (*_KEYS, "more"))
    more = more.view(np.uint32).astype(np.int64)
    before, windows, left, right = more >> 24, more >> 16 & 255, more >> 8 & 255, more & 255
    run, block = _new(h), _new(h, b)
    first = np.maximum.accumulate(np.where(block, np.arange(len(h)), 0))
    # An equal place in another version of a document is no earlier one.
    later = ~block & ((doc != doc[first]) | (start != start[first]))
    half = (length - length // 2) // 2
    group = np.cumsum(run) - 1
    heads = np.flatnonzero(block)
    mixed = np.bincount(group[heads])[group[heads]] > 1
    # Other buckets may hold more of the first and the last run.
    edge = (group[heads] == 0) | (group[heads] == group[-1])
    least = before[heads] - windows[heads] + 1
    asked = []
    for sketch, low, high in ((left[heads], np.maximum(least, half), before[heads]), (right[heads], least, np.minimum(before[heads], half - 1))):
        has = low <= high
        key = group[heads] << 8 | sketch
        _, number, n = np.unique(np.where(has, key, -1), return_inverse=True, return_counts=True)
        ask = np.flatnonzero(has & (edge | mixed & (n[number] > 1)))
        at = heads[ask]
        asked.append({"doc": doc[at], "version": version[at], "start": start[at] + (before[at] - high[ask]), "n": high[ask] - low[ask] + 1})
    whole = {"doc": doc[later], "version": version[later], "start": start[later], "n": windows[later]}
    return [(REPEATED, whole), *((ASKED, x) for x in asked)]


def _gathered(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    held = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
    return {c: np.concatenate(x) for c, x in zip(names, zip(*held))} if held else {}


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, begin = terms.bytes_of(batch.column("text"))
    return batch.column("doc").to_numpy(zero_copy_only=False), batch.column("version").to_numpy(zero_copy_only=False), data, begin


def _splitters(docs: DataFrame, length: int) -> tuple[dict[str, np.ndarray], int]:
    """Suffixes that part the buckets, from a sample of documents by hash; and how many buckets there are."""
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    expected = (size or 0) * 2 / (length - length // 2 + 2)
    wanted = int(expected // BUCKET) + 1
    if wanted < 2:
        return {c: np.zeros(0, dtype=np.int64) for c in _KEYS}, 1
    share = min(1.0, max(SAMPLED, 16 * wanted) / expected)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _suffixes(*_texts(batch), length):
                # Every document gives the share of its suffixes that has the least hashes of their own places.
                keep = terms.mixed(rows["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows["start"].astype(np.uint64)) < np.uint64(min(share * few, 1.0) * (2**64 - 1025))
                yield pa.RecordBatch.from_arrays([pa.array(rows[c][keep]) for c in _KEYS], list(_KEYS))

    # A tenth of the documents is read at most, so of each of them ten times the share.
    few = 10 if share <= 0.1 else 1
    some = docs.filter(share_by_hash("doc", 12, 1 / few)) if few > 1 else docs
    rows = some.mapInArrow(drawn, "h long, b long, doc long, version long, start int").toPandas()
    held = {c: rows[c].to_numpy() for c in _KEYS}
    order = multikey_order([held[c] for c in _KEYS]) if len(rows) else np.zeros(0, dtype=np.int64)
    picked = order[[len(order) * i // wanted for i in range(1, wanted)]] if len(order) else order
    parted = {c: held[c][picked] for c in _KEYS}
    fresh = _new(*parted.values()) if len(picked) else np.zeros(0, dtype=bool)
    return {c: v[fresh] for c, v in parted.items()}, int(fresh.sum()) + 1


def _of_blocks(docs: DataFrame, length: int) -> DataFrame:
    """(kind, doc, version, start, n): windows of blocks repeated whole, and windows asked for, written."""
    picked, buckets = _splitters(docs, length)
    shared = docs.sparkSession.sparkContext.broadcast(picked)  # one suffix a bucket

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _suffixes(*_texts(batch), length):
                rows["bucket"] = bucket_numbers(rows, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c]) for c in ("bucket", *_KEYS, "more")], ["bucket", *_KEYS, "more"])

    def in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches, (*_KEYS, "more"))
        for kind, found in judged(rows, length) if rows else ():
            for at in range(0, len(found["doc"]), 100_000):
                part = slice(at, at + 100_000)
                columns = [found["doc"][part], found["version"][part], found["start"][part].astype(np.int32), found["n"][part].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *map(pa.array, columns)], ["kind", "doc", "version", "start", "n"])

    dealt = docs.mapInArrow(suffixes, _SUFFIX).repartitionById(buckets, "bucket").drop("bucket")
    return staged(dealt.mapInArrow(in_bucket, _FOUND), "blocks")


def _with_texts(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` with the places (start and number of windows) found in each."""
    packed = F.shiftleft(F.col("start").cast("long"), 16).bitwiseOR(F.col("n"))
    places = found.groupBy("doc", "version").agg(F.collect_list(packed).alias("_places"))
    return docs.join(places.hint("shuffle_hash"), ["doc", "version"], how)


def _of_windows(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(doc, version, start, n) of asked windows that start earlier elsewhere."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, data, begin = _texts(batch)
            for part in terms.pieces(begin, PIECE):
                places = batch.column("_places").slice(part.start, part.stop - part.start)
                of = np.repeat(np.arange(part.start, part.stop), places.value_lengths().to_numpy(zero_copy_only=False))
                place = places.flatten().to_numpy(zero_copy_only=False)
                size = place & 65535
                row = np.repeat(np.arange(len(place)), size)
                start = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + (place >> 16)[row]
                at, text = start + begin[of[row]], of[row]
                order = np.argsort(at, kind="stable")
                at, start, text = at[order], start[order], text[order]
                for _, _, low, high in parts_of(begin[part.start : part.stop + 1], length):
                    here = slice(*np.searchsorted(at, [low, max(high - length + 1, low)]))
                    if here.start < here.stop:
                        digests = [Digests(data[low:high], k).of(length)[at[here] - low].view(np.int64) for k in (0, 1)]
                        columns = [*digests, ids[text[here]], versions[text[here]], start[here].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(_KEYS))

    names = ", ".join(f"{c} {'int' if c == 'start' else 'long'}" for c in _KEYS)
    rows = staged(_with_texts(docs, asked, "inner").mapInArrow(windows, names), "windows")
    freed(docs.sparkSession)

    def in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches, _KEYS)
        if not rows:
            return
        order = multikey_order([rows[c] for c in _KEYS])
        h, b, doc, version, start = (rows[c][order] for c in _KEYS)
        heads = _new(h, b)
        first = np.maximum.accumulate(np.where(heads, np.arange(len(h)), 0))
        later = ~heads & ((doc != doc[first]) | (start != start[first]))
        # The ends of a bucket, and with them all rows equal to its first one that it doesn't call repeated.
        ends = np.zeros(len(h), dtype=bool)
        ends[[0, -1]] = True
        ends |= (first == 0) & ~later
        side = np.where(np.arange(len(h)) == len(h) - 1, 1, 0).astype(np.int32)
        at = np.flatnonzero(later | ends)
        columns = [np.full(len(at), TaskContext.get().partitionId(), dtype=np.int32), later[at], side[at], first[at] == 0, *(x[at] for x in (h, b, doc, version, start))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "later", "last", "opening", *_KEYS])

    # As many ranges as the session shuffles into, or as keep a range to about BUCKET rows.
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET + 1)
    sorted_ = staged(rows.repartitionByRange(ranges, *_KEYS).mapInArrow(in_bucket, f"bucket int, later boolean, last int, opening boolean, {names}"), "sorted")
    # The first key of a bucket against the last of the one before: an equal one there is earlier, or the same place.
    before = sorted_.filter("last = 1").select((F.col("bucket") + 1).alias("bucket"), "h", "b", F.col("doc").alias("_doc"), F.col("start").alias("_start"))
    across = sorted_.filter("opening and not later").join(before, ["bucket", "h", "b"]).filter("doc != _doc or start != _start")
    columns = ["doc", "version", "start", F.lit(1).alias("n")]
    return sorted_.filter("later").select(columns).unionByName(across.select(columns))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept, the bytes that are left of each text."""
    if not 16 <= length <= 400:
        raise ValueError("strings of 16 to 400 bytes")
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_removed", "n_spans", "kept", "doc", "version", "_places", "_cut")]
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    # Texts that share an id, or have none, are told apart by their hash.
    version = F.lit(0).cast("long") if rows == ids else F.xxhash64("text")
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), version.alias("version"))
    plain = keyed.select("doc", "version", F.coalesce("text", F.lit("")).alias("text"))
    found = _of_blocks(plain, length)
    freed(spark)
    whole = found.filter(F.col("kind") == REPEATED).select("doc", "version", "start", "n")
    repeats = staged(whole.unionByName(_of_windows(plain, found.filter(F.col("kind") == ASKED), length)), "repeats")
    freed(spark)

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            whole, borders = terms.bytes_of(texts)
            for part in terms.pieces(borders):
                begin = borders[part.start : part.stop + 1]
                data, begin, own = whole[begin[0] : begin[-1]], begin - begin[0], places.slice(part.start, part.stop - part.start)
                size, value = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), own.flatten().to_numpy(zero_copy_only=False)
                depth = np.zeros(len(data) + 1, dtype=np.int32)
                at = np.repeat(begin[:-1], size) + (value >> 16)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + (value & 65535) + length - 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                border = np.zeros(len(data) + 1, dtype=bool)
                border[begin] = True
                opens = gone & ~(np.append(False, gone[:-1]) & ~border[:-1]) if len(data) else gone
                removed, spans = (np.append(0, np.cumsum(x))[begin] for x in (gone, opens))
                buffers = [None, pa.py_buffer((begin - removed).astype(np.int64)), pa.py_buffer(data[~gone])]
                kept = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, buffers).cast(pa.binary())
                yield pa.StructArray.from_arrays([pa.array(np.diff(begin)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), kept], ["n_bytes", "n_removed", "n_spans", "kept"])

    stripped = F.arrow_udf(cut, "n_bytes long, n_removed long, n_spans long, kept binary").asNondeterministic()
    met = _with_texts(keyed, repeats, "left").withColumn("_cut", stripped("text", "_places"))
    return met.select(*(F.col(f"`{c}`") for c in names), "_cut.*")
