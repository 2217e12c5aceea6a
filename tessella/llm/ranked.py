"""Ranked lexical search by MaxScore over an index in shards.

``index`` writes one row a shard: some neighbouring documents, their lengths, the shard's terms, and a posting list for each
(documents by number, occurrences), packed in as few bytes as the largest value needs. No shuffle builds it. ``search``
takes queries in blocks; of each block it sums the documents that hold its terms over all shards, then walks the shards.

In a shard a term's upper bound is its largest contribution there. For one query, terms are ordered by bound, and as long as the
bounds of the weakest ones together don't reach the score of the k-th best document so far, these are non-essential: only
documents of the essential lists are candidates. Non-essential lists are probed from the strongest on, and only for
candidates that can still qualify with what is left. The k-th best score is carried from shard to shard of a task.

Scores are integers: weight w = floor(1000 ln((2N+2)/(2df+1))) of a term, m = 75 + (25 n N) div L of a document of n terms, and
w * ((10^9 tf) div (1000 tf + 12 m)) for each occurrence of a term in the query.

Defined cases: null and empty texts hold no term and are in no result, and a query without terms has no rows; rows that share
an item_id are one query of all their terms; a null item_id is a query like any other; documents with a null doc_id count, and stand
last among equal scores; rows that share a doc_id are ranked one by one; empty tables give empty results; extra columns
aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import terms
from tessella.llm.shared import staged

TOP = 20
#: Bytes of text, and documents, in one shard at most; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCUMENTS = 6 << 20, 60_000
#: Terms of the queries of one block, about; a longer query is a block of its own.
BLOCK_TERMS = 200_000
_INDEX = "n_docs long, n_terms long, doc_ids binary, missing binary, lengths binary, terms array<string>, ends binary, docs binary, tfs binary"
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in 1, 2, 4 or 8 bytes each, behind a byte that tells which."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: pa.BinaryScalar) -> np.ndarray:
    buffer = data.as_buffer()
    width = int(np.frombuffer(buffer, np.uint8, count=1)[0])
    return np.frombuffer(buffer, f"<u{width}", offset=1).astype(np.int64)


def _shard(ids: list[pa.Array], texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The index row of some documents."""
    places, hashes, spelled, lengths, base = [], [], [], [], 0
    for data, begin in texts:
        words = terms.Words(data, begin)
        first, number = words.distinct()
        places.append(words.doc + base)
        hashes.append(words.hash)
        spelled.append((words.hash[first], words.spelled(first)))
        lengths.append(np.bincount(words.doc, minlength=len(begin) - 1))
        base += len(begin) - 1
    doc, word, length = np.concatenate(places), np.concatenate(hashes), np.concatenate(lengths)
    known, number = np.unique(word, return_inverse=True)
    distinct, at = np.unique(np.concatenate([h for h, _ in spelled]), return_index=True)
    names = pa.concat_arrays([s for _, s in spelled]).take(pa.array(at)).cast(pa.string())
    posting, tf = np.unique(number * base + doc, return_counts=True)
    ends = np.cumsum(np.bincount(posting // max(base, 1), minlength=len(known)))
    of = pa.concat_arrays(ids)
    columns = [
        pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]), *(pa.array([x], pa.binary()) for x in (
            of.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.asarray(of.is_null()).astype(np.uint8).tobytes(), packed(length),
        )),
        pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), *(pa.array([packed(x)], pa.binary()) for x in (ends, posting % max(base, 1), tf)),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, count = [], [], 0, 0
        for batch in batches:
            data, begin = terms.bytes_of(batch.column("text"))
            for part in terms.pieces(begin):
                own = begin[part.start : part.stop + 1]
                n, held = part.stop - part.start, int(own[-1] - own[0])
                if ids and (size + held > SHARD_BYTES or count + n > SHARD_DOCUMENTS):
                    yield _shard(ids, texts)
                    ids, texts, size, count = [], [], 0, 0
                ids.append(batch.column("doc_id").slice(part.start, n))
                texts.append((data[own[0] : own[-1]].copy(), own - own[0]))
                size, count = size + held, count + n
        if ids:
            yield _shard(ids, texts)

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(shards, _INDEX), "index")


@dataclass
class Best:
    """The best documents of one query so far, as (score, null id last, id)."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    missing: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint8))
    doc_id: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def least(self) -> int:
        """A document of a lower score can't be among them; one of the same score can, by its id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray) -> None:
        score, missing, doc_id = np.append(self.score, score), np.append(self.missing, missing), np.append(self.doc_id, doc_id)
        order = np.lexsort((doc_id, missing, -score))[: self.k]
        self.score, self.missing, self.doc_id = score[order], missing[order], doc_id[order]


class Shard:
    """A shard opened for a block's terms: contributions without weight, worked out once a term."""

    def __init__(self, row: dict, wanted: pa.Array, n_all: int, l_all: int) -> None:
        self.doc_id, self.missing = np.frombuffer(row["doc_ids"].as_buffer(), "<i8"), np.frombuffer(row["missing"].as_buffer(), np.uint8)
        m = 75 + (25 * unpacked(row["lengths"]) * n_all) // l_all
        ends, docs, tfs = (unpacked(row[c]) for c in ("ends", "docs", "tfs"))
        begin = np.append(0, ends)
        found = pc.index_in(wanted, value_set=row["terms"].values.cast(wanted.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for t in np.flatnonzero(found >= 0).tolist():
            own = slice(int(begin[found[t]]), int(begin[found[t] + 1]))
            parts = (1_000_000_000 * tfs[own]) // (1000 * tfs[own] + 12 * m[docs[own]])
            self.lists[t] = (docs[own], parts, int(parts.max()))

    def search(self, query: list[tuple[int, int]], best: Best) -> None:
        """Adds to ``best`` the documents of this shard that qualify; ``query``: (term number, weight times repeats)."""
        lists = sorted(((w * self.lists[t][2], w, t) for t, w in query if t in self.lists and w > 0), reverse=True)
        if not lists:
            return
        # left[i]: what the lists from i on can add at most.
        left = np.append(np.cumsum([b for b, _, _ in lists][::-1])[::-1], 0)
        least = best.least()
        essential = next(i for i in range(len(lists) + 1) if left[i] < least)
        if not essential:
            return
        total = np.zeros(len(self.doc_id), dtype=np.int64)
        for _, w, t in lists[:essential]:
            docs, parts, _ = self.lists[t]
            total[docs] += w * parts
        candidates = np.flatnonzero(total > 0)
        for i in range(essential, len(lists) + 1):
            candidates = candidates[total[candidates] + left[i] >= least]
            if i == len(lists) or not len(candidates):
                break
            _, w, t = lists[i]
            docs, parts, _ = self.lists[t]
            at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
            hit = docs[at] == candidates
            total[candidates[hit]] += w * parts[at[hit]]
        if len(candidates):
            best.add(total[candidates], self.missing[candidates], self.doc_id[candidates])


def _query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, terms, block): all terms of each query, repeats included."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = terms.bytes_of(batch.column("text"))
            words = terms.Words(data, begin)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(words.doc)), words.spelled(np.arange(len(words.start))).cast(pa.string())], ["item_id", "term"])

    rows = queries.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, term string")
    return rows.groupBy("item_id", "term").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.collect_list(F.struct("term", "n")).alias("terms"))


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int | None, list[tuple[str, int]]]]]:
    """Queries of about BLOCK_TERMS terms at a time."""
    asked = staged(_query_terms(queries), "queries")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if rows:
            yield [(r["item_id"], [(t["term"], t["n"]) for t in r["terms"]]) for r in rows]


def _document_counts(shards: DataFrame, wanted: list[str]) -> np.ndarray:
    """Of each wanted term the documents that hold it."""
    names = pa.array(wanted, pa.string())

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ends in zip(batch.column("terms"), batch.column("ends")):
                found = pc.index_in(names, value_set=own.values.cast(pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
                n = np.diff(np.append(0, unpacked(ends)))
                at = np.flatnonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[found[at]])], ["t", "df"])

    df = np.zeros(len(wanted), dtype=np.int64)
    for r in shards.select("terms", "ends").mapInArrow(held, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r["t"]] = r["df"]
    return df


def search(shards: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query (item_id, text) with a score above 0."""
    spark = shards.sparkSession
    n_all, l_all = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    out = None
    for block in _blocks(queries) if n_all else ():
        wanted = sorted({t for _, asked in block for t, _ in asked})
        number = {t: i for i, t in enumerate(wanted)}
        weight = [math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1))) for df in _document_counts(shards, wanted).tolist()]
        plans = [(item, [(number[t], n * weight[number[t]]) for t, n in asked]) for item, asked in block]
        shared = spark.sparkContext.broadcast((wanted, plans))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = pa.array(shared.value[0], pa.string()), shared.value[1]
            found = [Best(k) for _ in asked]
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = Shard({c: batch.column(c)[i] for c in batch.schema.names}, names, n_all, l_all)
                    for (_, query), own in zip(asked, found):
                        shard.search(query, own)
            items = pa.array([item for (item, _), own in zip(asked, found) for _ in own.score], pa.int64())
            score, missing, doc_id = (np.concatenate([getattr(own, c) for own in found]) for c in ("score", "missing", "doc_id"))
            yield pa.RecordBatch.from_arrays([items, pa.array(doc_id, mask=missing.astype(bool)), pa.array(score)], ["item_id", "doc_id", "score"])

        found = shards.drop("n_docs", "n_terms").mapInArrow(best, "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
