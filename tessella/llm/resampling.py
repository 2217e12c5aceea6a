"""Target-distribution importance resampling by an external sort-count of packed bucket streams.

Each text's features, runs of ``LEAST_RUN`` to ``MOST_RUN`` consecutive words, fall into buckets by crc32. The buckets of a
piece of documents are written as one packed stream of uint16 with the place where each document's part ends, to the
shared folder. Counts come from the streams: each is sorted and run-length encoded, so a bucket that holds a third of all
features is one row of its stream before anything is shuffled. The gains of all buckets, a table of ``BUCKETS``
numbers, go back to the streams, where ``np.add.reduceat`` sums them by document. Documents with enough words are drawn by
weight plus Gumbel noise of a hash of their id (draws without replacement), ranked by ranges of score: no task
holds all scores.

Defined cases: a null text has no words and weight 0; a null doc_id draws as the empty text and stands after all others of
its score; rows that share a doc_id draw alike and are ranked one by one; empty tables give empty results, an empty target
leaves the prior of one feature a bucket; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import terms
from tessella.llm.shared import staged

BUCKETS = 10_000
LEAST_RUN, MOST_RUN = 1, 1
#: Documents of fewer words are never drawn; of all others this share, in percent, is.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
#: One row for each piece of text: ids, which of them are null, where each document ends, its words, and all buckets.
_STREAM = "doc_ids binary, missing binary, ends binary, n_words binary, stream binary, features long"
_NAMES = [c.split()[0] for c in _STREAM.split(", ")]
#: Ranges of score that are ranked apart at most.
RANGES = 128


def _features(words: terms.Words, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each feature, by text."""
    first, number = words.distinct()
    spelled = words.spelled(first).cast(pa.large_binary()).to_pylist()
    if (least, most) == (1, 1):
        by_word = np.array([zlib.crc32(w) % buckets for w in spelled], dtype=np.uint16)
        return words.doc, by_word[number] if len(first) else by_word
    docs, found = [], []
    for k in range(least, most + 1):
        at = np.flatnonzero(words.doc[k - 1 :] == words.doc[: len(words.doc) - k + 1]) if len(number) >= k else np.zeros(0, dtype=np.int64)
        runs, inverse = np.unique(np.stack([number[at + j] for j in range(k)]), axis=1, return_inverse=True)
        crc = np.array([zlib.crc32(b" ".join(spelled[i] for i in run)) % buckets for run in runs.T], dtype=np.uint16)
        docs.append(words.doc[at])
        found.append(crc[inverse.ravel()] if len(at) else crc)
    doc, bucket = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order]


def streams(docs: DataFrame, least: int = LEAST_RUN, most: int = MOST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """Packed bucket streams of ``docs`` (doc_id, text), written: one row for each piece of neighbouring documents."""
    if not 1 <= buckets <= 65_536 or not 1 <= least <= most:
        raise ValueError("1 to 65536 buckets, and runs of at least one word")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            data, begin = terms.bytes_of(texts)
            for part in terms.pieces(begin):
                own = begin[part.start : part.stop + 1]
                words = terms.Words(data[own[0] : own[-1]], own - own[0])
                n = part.stop - part.start
                doc, bucket = _features(words, least, most, buckets)
                of = ids.slice(part.start, n)
                columns = [
                    of.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), np.asarray(of.is_null()).astype(np.uint8), np.cumsum(np.bincount(doc, minlength=n)).astype("<i8"),
                    np.bincount(words.doc, minlength=n).astype("<i8"), bucket.astype("<u2"),
                ]
                yield pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([len(bucket)], pa.int64())], _NAMES)

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, _STREAM), "streams")


def counts(packed: DataFrame) -> DataFrame:
    """(bucket, n) of all features: streams are sorted and run-length encoded before they meet."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("stream"):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), dtype="<u2"))
                at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ordered[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(ordered))))], ["bucket", "n"])

    return packed.select("stream").mapInArrow(encoded, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket floor(1000 ln of its smoothed share in the target over that in the source); at most 65,536 rows each."""
    held = []
    for packed in (source, target):
        n = np.zeros(buckets, dtype=np.int64)
        for r in counts(packed).collect():
            n[r["bucket"]] = r["n"]
        held.append(n)
    s, t = held
    ratio = ((t + 1) * (int(s.sum()) + buckets)) / ((s + 1) * (int(t.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the gains of each document's features, summed by its place in a stream."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, missing, ends, n_words, stream in zip(*(batch.column(c) for c in ("doc_ids", "missing", "ends", "n_words", "stream"))):
                ids, end = np.frombuffer(doc_ids.as_buffer(), "<i8"), np.frombuffer(ends.as_buffer(), "<i8")
                n = np.diff(np.append(0, end))
                weight = np.zeros(len(ids), dtype=np.int64)
                # reduceat gives an empty part the value at its place: only documents with features are summed.
                full = np.flatnonzero(n)
                if len(full):
                    weight[full] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], (end - n)[full])
                nulls = np.frombuffer(missing.as_buffer(), np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(np.frombuffer(n_words.as_buffer(), "<i8")), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return packed.drop("features").mapInArrow(gathered, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths by the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, score, ...), a written table, with ``rank`` of those drawn, null for all others.

    Borders cut the upper ``percent`` into ranges of about as many rows. Rows are counted by range; each range that a drawn row may
    stand in is numbered from what the ranges above it hold. One score holds few documents, since the noise differs
    by id, so no range is a hot one.
    """
    enough = F.col("n_words") >= least_words
    fit = scored.filter(enough)
    n = fit.count()
    drawn = n * percent // 100
    wanted = max(1, min(RANGES, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = [max(0.0, 1 - percent / 100 * i / wanted) for i in range(1, wanted + 1)]
    borders = sorted({int(x) for x in fit.approxQuantile("score", shares, 0.0005)}, reverse=True) if drawn else []
    # Range 0 holds the scores from the highest border on; each further border opens one more.
    number = F.greatest(F.lit(0), F.lit(0), *(F.when(F.col("score") < b, i + 1) for i, b in enumerate(borders)))
    dealt = scored.withColumn("_range", F.when(enough, number))
    offsets, before = [], 0
    for i, held in sorted((r["_range"], r["n"]) for r in dealt.filter(enough).groupBy("_range").agg(F.count("*").alias("n")).collect()):
        if before < drawn:
            offsets.append((i, before))
        before += held
    table = F.broadcast(scored.sparkSession.createDataFrame(offsets, "_range int, _before long"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    upper = dealt.join(table, "_range").withColumn("_place", place).withColumn("rank", F.when(F.col("_place") <= drawn, F.col("_place")))
    rest = dealt.join(table, "_range", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    columns = [*scored.columns, "rank"]
    return upper.select(columns).unionByName(rest.select(columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, least: int = LEAST_RUN, most: int = MOST_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``, drawn towards ``target`` (text)."""
    source = streams(docs, least, most, buckets)
    aim = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), least, most, buckets)
    scored = weights(source, gains(source, aim, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(staged(scored, "scores"), percent, least_words)
