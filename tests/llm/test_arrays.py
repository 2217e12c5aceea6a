"""Resampling, suffix-array dedup and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from common import no_documents, odd_documents
from tessella.llm import ranked, resampling, suffixes, terms

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ITEMS = "item_id long, text string"


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def invented(rng, n, longest=60):
    pool = ["der", "Fuchs", "läuft", "x1", "42", "の本", "again", "AND", "and"] + [f"w{int(rng.paretovariate(0.7))}" for _ in range(60)]
    return [rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "-", "  "]) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = [*invented(rng, 40), "É…ß", "A", "ab" * 3000, "\x00a\x7fb`c", " a"]
    data, begin = terms.bytes_of(pa.array(texts))
    words = terms.Words(data, begin)
    got = [[] for _ in texts]
    for k, w in zip(words.doc, words.spelled(np.arange(len(words.start))).cast(pa.large_binary()).to_pylist()):
        got[k].append(w)
    assert got == [words_of(t) for t in texts]
    first, number = words.distinct()
    assert [words.spelled(first).to_pylist()[i] for i in number] == words.spelled(np.arange(len(number))).to_pylist()
    for texts in ([], [None], ["", ""], ["--"]):
        assert len(terms.Words(*terms.bytes_of(pa.array(texts, pa.string()))).hash) == 0


# Resampling


def drawn_plainly(docs, target, percent, least_words, least, most, buckets, seed):
    runs = lambda ws: [b" ".join(ws[i : i + k]) for k in range(least, most + 1) for i in range(len(ws) - k + 1)]
    hit = lambda text: [zlib.crc32(r) % buckets for r in runs(words_of(text))]
    s, t = (collections.Counter(b for x in side for b in hit(x)) for side in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for k, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in hit(text))
        rows.append((k, len(words_of(text)), len(hit(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= least_words)
    places = collections.defaultdict(list)
    for i, (score, _, k) in enumerate(fit[: len(fit) * percent // 100]):
        places[-score, k].append(i + 1)
    return sorted(((*r, places[r[4], r[0] or 0].pop(0) if places[r[4], r[0] or 0] and r[1] >= least_words else None) for r in rows), key=str)


@pytest.mark.parametrize(("least", "most", "buckets"), [(1, 1, 10_000), (1, 2, 97), (2, 3, 65_536)])
def test_resampling_against_plain_python(spark, least, most, buckets):
    rng = random.Random(least + most)
    docs = list(enumerate(invented(rng, 300)))
    target = invented(rng, 30)
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(list(enumerate(target)), ITEMS), 30, 10, least, most, buckets, 7)
    assert sorted(map(tuple, got.collect()), key=str) == drawn_plainly(docs, target, 30, 10, least, most, buckets, 7)


def test_ranks_are_dealt_by_ranges(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, 20 + i % 3, rng.randint(0, 300) if i % 4 else 77) for i in range(4000)] + [(None, 30, 300), (None, 30, 77)]
    for ranges in (1, 4, 64):
        monkeypatch.setattr(resampling, "RANGES", ranges)
        got = resampling.ranked(spark.createDataFrame(rows, "doc_id long, n_words long, score long"), 40, 21).collect()
        fit = sorted((-s, k is None, k or 0) for k, n, s in rows if n >= 21)
        want = [(k if not none else None, -s) for s, none, k in fit[: len(fit) * 40 // 100]]
        assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want
        assert len(got) == len(rows) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(want) + 1))


def test_resampling_of_odd_documents(spark):
    target = spark.createDataFrame([(1, "The quick fox"), (2, None), (None, "")], ITEMS)
    docs = [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()]
    got = resampling.resample(odd_documents(spark, ["rank", "score", "stream"]), target, 50, 1)
    assert sorted(map(tuple, got.collect()), key=str) == drawn_plainly(docs, ["The quick fox", None, ""], 50, 1, 1, 1, 10_000, 2024)
    assert resampling.resample(no_documents(spark), target).count() == 0
    alone = resampling.resample(odd_documents(spark), no_documents(spark), 50, 1).collect()
    assert sorted(map(tuple, alone), key=str) == drawn_plainly(docs, [], 50, 1, 1, 1, 10_000, 2024)
    with pytest.raises(ValueError):
        resampling.resample(odd_documents(spark), target, buckets=70_000)


# Suffix array


def cut_plainly(docs, length):
    """docs: (doc_id, text); a null id stands last, rows of one id are versions of one document."""
    place = lambda k, i: (k is None, k or 0, i)
    data = [(k, (t or "").encode()) for k, t in docs]
    first = {}
    for k, b in data:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, place(k, i)), place(k, i))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < place(k, i):
                gone[i : i + length] = b"\1" * length
        out.append((k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def cut_by_spark(df, length):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(df, length).collect()), key=str)


def repeating(rng, n, alphabet):
    texts, passages = [], ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 90))) for _ in range(6)]
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            t = list(rng.choice(texts) or "")
            for _ in range(rng.randint(1, 4)):
                t[rng.randint(0, len(t)) : rng.randint(0, 3)] = rng.choice(alphabet)
            texts.append("".join(t))
        else:
            texts.append("".join(rng.choice([rng.choice(passages), "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))]) for _ in range(rng.randint(0, 6))))
    return texts


@pytest.mark.parametrize(("length", "alphabet", "bucket"), [(16, "ab", 200), (20, "abcdé語 ", 50), (33, "abcdefgh \n", 400), (100, "ab c", 100), (40, "abc", 300_000)])
def test_repeated_strings_against_brute_force(spark, monkeypatch, length, alphabet, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rng = random.Random(length)
    docs = [(rng.randint(0, 10**6), t) for t in repeating(rng, 150, alphabet)] + [(3, "ab" * 400), (4, "a" * 700), (5, "x" + "ab" * 300)]
    docs = list({k: (k, t) for k, t in docs}.values())
    assert cut_by_spark(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), length) == cut_plainly(docs, length)


def test_a_passage_of_most_documents_is_split_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 60)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(150))
    text = lambda n: "".join(rng.choice("klmnopqrs ") for _ in range(n))
    docs = [(i, text(rng.randint(0, 40)) + passage + text(rng.randint(0, 40))) for i in range(400)] + [(1000 + i, passage) for i in range(100)]
    assert cut_by_spark(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 50) == cut_plainly(docs, 50)


def test_repeated_strings_of_odd_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect() if r["doc_id"] != 8]
    docs += [(10, docs[0][1]), (10, "no" + docs[0][1]), (None, "x" + docs[0][1]), (None, "y" + docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'e' AS kept", "7 AS h", "'z' AS doc")
    assert cut_by_spark(df, 40) == cut_plainly(docs, 40)
    assert set(suffixes.dedup(df).columns) == {"doc_id", "text", "h", "n_bytes", "n_removed", "n_spans", "kept"}
    assert suffixes.dedup(no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        suffixes.dedup(df, 8)
    long = spark.createDataFrame([(8, "long " * 60_000)], "doc_id long, text string")
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(long).collect()] == [(300_000, 299_995, 1, b"long ")]


def test_texts_longer_than_a_piece_are_whole(monkeypatch):
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(3000)), dtype=np.uint8)
    begin = np.array([0, 0, 5, 2000, 2100, 3000])
    ids, versions = np.arange(5), np.zeros(5, dtype=np.int64)
    seen = lambda: {(int(d), int(s) + k) for rows in suffixes._suffixes(ids, versions, data, begin, 32) for d, s, m in zip(rows["doc"], rows["start"], rows["more"].view(np.uint32)) for k in range(m >> 16 & 255)}
    every = {(d, i) for d in range(5) for i in range(begin[d + 1] - begin[d] - 31)}
    assert seen() == every
    monkeypatch.setattr(suffixes, "PIECE", 256)
    assert seen() == every


def test_multikey_order_sorts():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-3, 3, 30_000), rng.integers(-2, 900, 30_000), rng.integers(0, 5, 30_000), rng.integers(0, 9, 30_000)]
    columns[0][:10_000] = 1
    got = suffixes.multikey_order(columns)
    rows = list(zip(*columns))
    assert [rows[i] for i in got] == sorted(rows) and len(set(got.tolist())) == 30_000
    assert suffixes.multikey_order([np.zeros(0), np.zeros(0)]).tolist() == []


# Ranked search


def found_plainly(docs, items, k):
    held = [(d, collections.Counter(words_of(t))) for d, t in docs]
    n_all, l_all = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    asked = collections.defaultdict(collections.Counter)
    for item, t in items:
        asked[item].update(words_of(t))
    out = []
    for item, query in asked.items():
        scored = []
        for d, c in held:
            m = 75 + 25 * c.total() * n_all // max(l_all, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in query.items() if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block"), [(1 << 22, 10**6), (3000, 40)])
def test_ranked_search_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    rng = random.Random(5)
    docs = list(enumerate(invented(rng, 800))) + [(1000 + i, "w1 w2 the same") for i in range(60)]
    items = [(i % 25, t) for i, t in enumerate(invented(rng, 30, 25))] + [(90, "the same w1 w1"), (91, "nowhere"), (None, "w2 again")]
    index = ranked.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3 if shard > 10**6 else 40))
    got = ranked.search(index, spark.createDataFrame(items, ITEMS), 7)
    assert sorted(map(tuple, got.collect()), key=str) == found_plainly(docs, items, 7)


def test_a_task_of_many_shards_keeps_the_best():
    rng = random.Random(6)
    docs = list(enumerate(invented(rng, 400, 30)))
    n_all, l_all = sum(bool(words_of(t)) for _, t in docs), sum(len(words_of(t)) for _, t in docs)
    df = collections.Counter(w for _, t in docs for w in set(words_of(t)))
    query = sorted(df, key=lambda w: zlib.crc32(w))[:12]
    wanted, best = pa.array([w.decode() for w in query]), ranked.Best(5)
    for at in range(0, 400, 23):
        part = docs[at : at + 23]
        row = ranked._shard([pa.array([d for d, _ in part])], [terms.bytes_of(pa.array([t for _, t in part]))])
        shard = ranked.Shard({c: row.column(c)[0] for c in row.schema.names}, wanted, n_all, l_all)
        shard.search([(i, math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1)))) for i, w in enumerate(query)], best)
    want = [(d, s) for _, _, d, s in sorted(found_plainly(docs, [(0, b" ".join(query).decode())], 5), key=lambda r: r[1])]
    assert list(zip(best.doc_id.tolist(), best.score.tolist())) == want


def test_ranked_search_of_odd_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()]
    items = [(1, "the fox"), (2, None), (3, ""), (3, "Fuchs word"), (4, "long word long"), (None, "clocks"), (5, "ä")]
    index = ranked.index(odd_documents(spark, ["terms", "score"]))
    queries = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS rank")
    assert sorted(map(tuple, ranked.search(index, queries).collect()), key=str) == found_plainly(docs, items, 20)
    assert ranked.search(ranked.index(no_documents(spark)), queries).count() == 0
    assert ranked.search(index, queries.limit(0)).count() == 0 and ranked.search(index, queries.filter("item_id = 2")).count() == 0


def test_packed_numbers_come_back():
    for values in ([], [0, 255], [256], [65_536, 1], [1 << 40]):
        assert ranked.unpacked(pa.scalar(ranked.packed(np.array(values, dtype=np.int64)))).tolist() == values
