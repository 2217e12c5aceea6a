import collections
import decimal
import hashlib
import math
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import GERMAN, PROSE, SCHEMA, no_documents, odd_documents
from tessella.llm import bpe, components, langid, mixing, quality, simhash, spans, toxicity
from tessella.llm.shared import held_out

FOLDER = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# Language identification


def test_language_of_held_out_documents(spark):
    got = langid.identify(documents(spark)).select("doc_id", "lang", "held_out", "lang_pred", "score").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_language_of_odd_documents(spark):
    got = langid.identify(odd_documents(spark, ["lang_pred", "held_out", "h"])).collect()
    assert len(got) == 14 and {r["h"] for r in got} == {"kept"}
    for r in got:
        assert (r["lang_pred"] == "und") == (r["text"] is None or not re.search(r"[^\W\d_]", r["text"]))
        assert 0 <= r["score"] <= 1
    assert langid.identify(no_documents(spark)).count() == 0
    unlabelled = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}


def test_only_the_most_frequent_labels_are_learned(spark):
    rows = [(3 * i, f"{PROSE if i % 2 else GERMAN} {i}", ("en" if i % 2 else "de") if i < 60 else f"odd{i}") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2)
    assert sorted(a for within in model.langs.values() for a in within) == ["de", "en"]


def test_prediction_sees_only_the_text(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    blind = docs.select(F.lit(0).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"), F.col("doc_id").alias("k"))
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert {r["k"]: r["lang_pred"] for r in langid.predict(blind, model).collect()} == a


@pytest.mark.parametrize("text", ["123", "❤️ 123", "1️⃣", "\u0301", "\u0301 \u0308 5", "🎉🎉", "\u200d", "٣٤"])
def test_marks_and_digits_are_no_letters(spark, text):
    rows = [(3 * i, f"{PROSE} {i}", "en") for i in range(9)] + [(100, text, None), (101, f"é{text}", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] == "en"


def test_language_svms_against_plain_python(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((60, 5)), np.where(np.arange(60) % 3 == 0, 1.0, -1.0)
    x[y > 0, 0] += 0.4

    def objective(w):  # L2 regularised squared hinge loss, classes balanced
        total = sum(v * v for v in w) / 2
        for row, sign in zip(x, y):
            share = len(y) / (2 * sum(y == sign))
            total += 0.2 * share * max(0.0, 1 - sign * (sum(a * b for a, b in zip(row, w)) + w[-1])) ** 2
        return total

    fitted = langid.linear_svm(x, y, cost=0.2, epochs=300)
    for k in range(6):  # no step along any axis is better
        for step in (-0.02, 0.02):
            w = fitted.copy()
            w[k] += step
            assert objective(w) > objective(fitted)
    assert objective(langid.linear_svm(x, y, cost=0.2)) <= 1.02 * objective(fitted)
    docs = documents(spark)
    model = langid.fit(docs)
    families = sorted(model.langs)
    for r in docs.select("text").limit(60).collect():
        v = langid.features(r["text"])
        margins = {f: sum(a * b for a, b in zip(model.family_w[i], [*v, 1.0])) for i, f in enumerate(families)}
        family = max(margins, key=lambda f: margins[f])
        votes = dict.fromkeys(model.langs[family], 0)
        for (a, b), w in model.duels.items():
            if a in votes:
                votes[a if sum(p * q for p, q in zip(w, [*v, 1.0])) >= 0 else b] += 1
        assert votes[model.predict(r["text"])[0]] == max(votes.values())


# Mixing


def inverted(rate, key):
    u = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    upto = p
    while upto <= u:
        k += 1
        p *= rate / k
        upto += p
    return k


def test_mixing_is_the_inverted_poisson(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "source").collect()
    n = collections.Counter(r["source"] for r in rows)
    total = sum(math.sqrt(c) for c in n.values())
    want = {r["doc_id"]: inverted(len(rows) * math.sqrt(n[r["source"]]) / total / n[r["source"]], r["doc_id"]) for r in rows}
    got = collections.Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_mixing_to_given_weights(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id < 4000 THEN 'hot' WHEN id < 5999 THEN 'b' END AS source")
    weights = spark.createDataFrame([("hot", 1.0), ("b", 3.0), ("unknown", 9.0)], "source string, weight double")
    got = collections.Counter(r["source"] for r in mixing.mix(docs, weights, 8000).collect())
    assert abs(got["hot"] - 2000) < 150 and abs(got["b"] - 6000) < 300 and got[None] == 0
    salted = mixing.BROADCAST_SOURCES
    mixing.BROADCAST_SOURCES = 0
    try:
        assert collections.Counter(r["source"] for r in mixing.mix(docs, weights, 8000).collect()) == got
    finally:
        mixing.BROADCAST_SOURCES = salted


@pytest.mark.parametrize("salted", [False, True])
def test_mixing_takes_any_rate_and_rows_without_ids(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    docs = spark.range(40).selectExpr("CASE WHEN id < 2 THEN id END AS doc_id", "concat('t', id) AS text", "CASE WHEN id < 2 THEN 'a' END AS source")
    weights = spark.createDataFrame([("a", 3.0), (None, 1.0)], "source string, weight double")
    got = collections.Counter(r["source"] for r in mixing.mix(docs, weights, 40 * 20_000).select("source").collect())
    assert abs(got["a"] - 600_000) < 5_000 and abs(got[None] - 200_000) < 3_000
    few = docs.filter("source IS NULL")
    assert few.select(mixing.salt().alias("s")).distinct().count() > 10


def test_mixing_rare_sources_at_high_rates(spark):
    """Rates of about 190, 900 and 1,600, by a recurrence in decimals that can't underflow."""
    docs = spark.range(5020).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id < 5 THEN 'a' WHEN id < 10 THEN 'b' WHEN id < 20 THEN 'c' ELSE 'd' END AS source")
    weights = spark.createDataFrame([("a", 8000.0), ("b", 4500.0), ("c", 1900.0), ("d", 2500.0)], "source string, weight double")
    want = {}
    for i in range(20):
        rate = decimal.Decimal(1600 if i < 5 else 900 if i < 10 else 190)
        u = decimal.Decimal(int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16)) / 2**52
        p = upto = (-rate).exp()
        k = 0
        while upto <= u:
            k += 1
            p *= rate / k
            upto += p
        want[i] = k
    got = collections.Counter(r["doc_id"] for r in mixing.mix(docs, weights, 16900).filter("doc_id < 20").collect())
    assert got == want


def test_mixing_of_many_documents_and_one_rare_against_sql(spark, tmp_path):
    import duckdb

    from oracle import same
    from tessella.llm import queries

    many = spark.range(100_000).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"), F.lit("en").alias("lang"), F.expr("CASE WHEN id < 60000 THEN 'src0' WHEN id < 99900 THEN 'src4' ELSE 'src1' END").alias("source"))
    docs = many.unionByName(spark.createDataFrame([(200_000, "rare", "en", "rare"), (200_001, "none", "en", None)], "doc_id long, text string, lang string, source string")).withColumn("n_chars", F.length("text").cast("long"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(spark, con, queries.op3_mix_sources, queries.OP3_SQL, str(tmp_path))
    n = {r["source"]: r["n"] for r in queries.op3_mix_sources(spark, str(tmp_path)).groupBy("source").agg(F.count("*").alias("n")).collect()}
    given = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert n["rare"] > 300 and n[None] > 300 and n["src1"] > 100 * given["src1"] and n["src4"] < 0.8 * given["src4"]


def test_mixing_odd_documents(spark):
    got = mixing.mix(odd_documents(spark, ["copy", "n", "weight"]), target=60).collect()
    assert got and {r["n"] for r in got} == {"kept"} and all(isinstance(r["copy"], int) for r in got)
    assert mixing.mix(no_documents(spark)).count() == 0
    a = mixing.mix(odd_documents(spark), target=60).orderBy("order_key").collect()
    assert a == mixing.mix(odd_documents(spark).repartition(5), target=60).orderBy("order_key").collect()


# Byte-level BPE


def reference_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec().tokens, special_tokens={})


def test_bpe_equals_the_library_and_comes_back(spark):
    enc = reference_encoding()
    rows = documents(spark).limit(150).unionByName(odd_documents(spark).select(*documents(spark).columns))
    got = bpe.decode(bpe.encode(rows.select("text"))).collect()
    for r in got:
        text = r["text"] or ""
        assert r["token_ids"] == enc.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    trip = bpe.round_trip(odd_documents(spark, ["token_ids", "n_tokens"]), ids=True).collect()
    for r in trip:
        ids = enc.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["token_ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(no_documents(spark)).count() == 0


def test_bpe_of_long_words():
    enc, own, rng = reference_encoding(), bpe.codec(), random.Random(1)
    odd = ["a" * 3000, "ab" * 700, "aab" * 900, "".join(rng.choice("etaoin") for _ in range(900)), " " * 500 + "x", "\n" * 300, "😀" * 90, "漢字" * 300, "!?" * 400]
    odd += ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200)), "".join(rng.choice("ab") for _ in range(400))]
    got = own.encode(odd)
    assert [g.tolist() for g in got] == [enc.encode_ordinary(x) for x in odd]
    assert own.decode(got) == [x.encode() for x in odd]
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode([[1, 10**6]])


@pytest.mark.parametrize("kind", ["the", "aaab", "ACGT", "syllables", "=", "ideographs", "mixed"])
def test_bpe_of_words_of_a_hundred_thousand_letters(kind):
    import public_tokenizers

    own = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)  # its pieces are counted in no other test
    enc, rng = reference_encoding(), random.Random(kind)
    parts = {"ACGT": list("ACGT"), "syllables": ["ba", "ton", "ing", "re", "thou", "est", "er", "ka"], "ideographs": [chr(0x4E00 + k) for k in range(3000)], "mixed": ["the", "a" * 33, "xy", "===="]}.get(kind, [kind])
    text = "".join(rng.choice(parts) for _ in range(100_000 // len(parts[0])))[:100_000]
    began = time.process_time()
    got = own.encode([text])[0].tolist()
    assert time.process_time() - began < 10  # it grows with the length; about a second, and hours if each merge walked the word
    assert got == enc.encode_ordinary(text)


def test_bpe_of_many_unspaced_runs():
    enc, own, rng = reference_encoding(), bpe.codec(), random.Random(3)
    scripts = [(0x4E00, 0x9FFF), (0x3041, 0x3094), (0xE01, 0xE3A), (0x900, 0x950), (0xAC00, 0xD7A3), (0x41, 0x5A), (0x61, 0x7A), (0x600, 0x64A)]
    texts = ["，".join("".join(chr(rng.randrange(a, b)) for _ in range(rng.randint(17, 60))) for _ in range(100)) for a, b in scripts for _ in range(13)]
    assert [g.tolist() for g in own.encode(texts)] == [enc.encode_ordinary(x) for x in texts]
    pieces = [x for x in own.pieces.index if len(x) > bpe.LONG]
    assert len(pieces) < 100  # the runs, over 10,000 of them, are hardly ever contracted as a whole


def test_no_token_reaches_over_a_cut():
    own, rng = bpe.codec(), random.Random(4)
    tokens = set(own.tokens)
    raw = bytes(rng.choice(b"etaoinqzx \xe4\xb8\xad\xff") for _ in range(3000)) + "das Wörterbuch 漢字かな".encode() * 5
    cut = own.cuts(np.frombuffer(raw, dtype=np.uint8))
    crossed = np.zeros(len(raw) - 1, dtype=bool)
    for a in range(len(raw)):
        for b in range(a + 2, min(len(raw), a + 128) + 1):
            if raw[a:b] in tokens:
                crossed[a : b - 1] = True
    assert cut.any() and not (cut & crossed).any()


def test_bpe_forgets_without_harm(monkeypatch):
    enc, own, rng = reference_encoding(), bpe.codec(), random.Random(2)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(60)) for _ in range(3)]
        assert [g.tolist() for g in own.encode(texts)] == [enc.encode_ordinary(x) for x in texts]


# Sentence spans


def plain_units(text):
    """The text cut into sentences, character by character, with the words of each."""
    unspaced = lambda c: any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))) and unicodedata.category(c)[0] != "M"
    wide = lambda c: unspaced(c) or 0x3000 <= ord(c) <= 0x303F or 0xFF00 <= ord(c) <= 0xFF65 and not c.isalnum()
    ends, closers, commas = ".!?…。！？｡", "\"'”’)]»」』）】〉》", ",，、､"
    starts, stops = [], []
    for i, c in enumerate(text):
        before = text[i - 1] if i else " "
        if not c.isspace():
            new = before.isspace() or unspaced(c)
            new = new or wide(before) and not wide(c) and c not in ends + closers + commas and unicodedata.category(c)[0] != "M"
            if new:
                starts.append(i)
                stops.append(i + 1)
            stops[-1] = i + 1
    words = [text[a:b] for a, b in zip(starts, stops)]
    if not words:
        return [text] if text else [], [[]] if text else []
    mask = (1 << 64) - 1

    def hashed(word):
        x = (sum((ord(c.lower() if len(c.lower()) == 1 else c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(word)) + len(word)) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def pieces(cut):
        held, out = [], []
        for i in range(len(words)):
            held.append(i)
            if cut(i, held) or i + 1 == len(words):
                out.append(held)
                held = []
        return out

    def natural(i, _):
        w = words[i]
        gap = text[stops[i] : starts[i + 1]] if i + 1 < len(words) else ""
        return w[-1] in ends or (len(w) > 1 and w[-1] in closers and w[-2] in ends) or "\n" in gap

    long = {i for s in pieces(natural) if len(s) > spans.LONG for i in s}
    finer = lambda i, held: natural(i, held) or i in long and (words[i][-1] in commas or hashed(words[i]) % spans.ONE_IN == 0)
    found = pieces(lambda i, held: finer(i, held) or len(held) == spans.MOST)
    borders = [0, *(starts[s[0]] for s in found[1:]), len(text)]
    return [text[a:b] for a, b in zip(borders, borders[1:])], [[words[i].lower() for i in s] for s in found]


def plain_spans(text):
    """Sentences and spans of one text, word by word."""
    units, words = plain_units(text)
    found = []
    for i in range(len(units)):
        for j in range(i + spans.SENTENCES, len(units) + 1):
            flat = [w for u in words[i:j] for w in u]
            if len(flat) >= spans.WORDS:
                found.append((i, j, tuple(flat)))
                break
    return units, found


def test_sentences_against_plain_python(spark):
    texts = [r["text"] for r in documents(spark).select("text").limit(80).collect() if r["text"]]
    texts += ["Er sagte: 「今日は雨です。」それから、彼は家に帰りました。Then he left. 雨が降る！また明日？", "กขฃคฅ ฆงจฉ ำ่ะั กา", "a\n\nb. c? (d!) e", "x" * 50, "  ", ".", "…」", "中" * 40 + "。" + "国" * 9, "\U00020000\U00020001。a"]
    for t in texts:
        cut = spans.analyse([t])
        ends = [0, *cut.end.tolist()]
        units, found = plain_spans(t)
        if t.strip():
            assert [t[a:b] for a, b in zip(ends, ends[1:])] == units
        assert [(int(i), int(j)) for i, j in zip(cut.span_first, cut.span_end)] == [(i, j) for i, j, _ in found]


def test_passages_of_unspaced_scripts_are_found(spark):
    rng = random.Random(12)
    fresh = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) + ("。" if rng.random() < 0.1 else "") for _ in range(n))
    passage = fresh(120)
    rows = [(1, fresh(50) + passage + fresh(70)), (2, fresh(80) + passage + fresh(30)), (3, fresh(200))]
    got = {r["doc_id"]: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == got[3]["n_removed"] == 0 and got[2]["n_removed"] >= 3
    assert passage[30:90] not in got[2]["text"] and got[2]["text"].startswith(rows[1][1][:50])


def test_spans_against_brute_force(spark):
    passage = "Rain fell on the old harbour all night. Nobody at the inn slept, and the lamps burned low. By morning the ships were gone. Only ropes lay on the quay, wet and heavy. The keeper wrote it all down in his book. Then he shut the door and left the town for good, as he had said he would. "
    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(i, f"{fresh(30)}. {fresh(9)} {passage if i % 3 else ''}{fresh(25)}. {fresh(12)}.") for i in range(12)]
    rows += [(20, passage + fresh(40)), (21, ". ".join([fresh(6) + ", " + fresh(9)] * 5)), (22, "Once. Twice. "), (23, None), (24, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first: dict[tuple, tuple] = {}
    for k, t in sorted((k, t) for k, t in rows if t):
        for i, _, flat in plain_spans(t)[1]:
            first.setdefault(flat, (k, i))
    want = {}
    for k, t in rows:
        if not t:
            want[k] = t
            continue
        units, found = plain_spans(t)
        assert "".join(units) == t
        gone = {u for i, j, flat in found if first[flat] != (k, i) for u in range(i, j)}
        want[k] = "".join(u for n, u in enumerate(units) if n not in gone)
    got = {r["doc_id"]: r for r in spans.dedup(docs).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    later = [k for k in range(12) if k % 3][1:] + [20]
    for k in later:
        assert "wet and heavy" not in got[k]["text"] and got[k]["n_removed"] >= 5
    assert all(got[k]["n_removed"] == 0 for k in (0, 3, 6, 9, 22, 24)) and "wet and heavy" in got[1]["text"]


def test_texts_cut_alike_alone_and_together(spark):
    texts = [r["text"] for r in documents(spark).select("text").limit(60).collect()]
    together = spans.analyse(texts)
    for k, t in enumerate(texts):
        alone, own = spans.analyse([t]), together.doc == k
        assert together.end[own].tolist() == alone.end.tolist()
        assert together.span_hash[together.doc[together.span_first] == k].tolist() == alone.span_hash.tolist()


def test_spans_of_odd_documents(spark):
    got = spans.dedup(odd_documents(spark, ["h", "first_id", "n_removed"])).collect()
    assert len(got) == 14 and {r["h"] for r in got} == {"kept"}
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    first_copy = next(r for r in by[1])
    assert PROSE in first_copy["text"] and by[2][0]["text"] == "" and by[3][0]["text"] is None
    assert spans.dedup(no_documents(spark)).count() == 0


# SimHash


def plain_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in linked(i):
            parent[find(int(j))] = find(i)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_and_groups_against_brute_force(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark)).collect()}
    for r in rows[:200]:
        assert got[r["doc_id"]]["fingerprint"] == f"{plain_fingerprint(r['text']):016x}"
    prints = np.array([int(got[r["doc_id"]]["fingerprint"], 16) for r in rows], dtype=np.uint64)
    want = smallest_reachable([r["doc_id"] for r in rows], lambda i: np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4))
    assert [got[r["doc_id"]]["component_id"] for r in rows] == want


@pytest.mark.parametrize("wide", [False, True])
def test_covering_misses_no_pair(wide):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    homes = collections.defaultdict(set)
    for r, a, h in zip(*simhash.anchors(x, wide)):
        if h:
            homes[r].add(a)
    places = collections.defaultdict(list)
    for r, a, _ in zip(*simhash.anchors(y, wide)):
        places[r].append(a)
    assert all(len(homes[r]) == 3 and homes[r] & set(places[r]) and len(set(places[r])) == len(places[r]) for r in range(len(x)))


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("block", [20, 4096])
def test_large_anchors_are_split_without_loss(spark, monkeypatch, wide, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    f = set()
    for k in range(300):
        v = int(base[k % 5])
        for b in rng.choice(64, 2, replace=False):
            v ^= 1 << int(b)
        f.add(v)
    values = np.array(sorted(f), dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "f long")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(df, wide), "a", "b").collect()}
    ids = values.view(np.int64).tolist()
    want = smallest_reachable(ids, lambda i: np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4))
    assert [got.get(k, k) for k in ids] == want


def test_simhash_of_odd_documents(spark):
    got = simhash.near_duplicates(odd_documents(spark, ["fingerprint", "anchor", "f"])).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == 14 and by[2][0]["component_id"] == 1 and {r["component_id"] for r in by[10]} <= {6, 10}
    assert by[3][0]["fingerprint"] == "0" * 16 and by[3][0]["component_id"] == by[4][0]["component_id"] == by[5][0]["component_id"] == 3
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_components_of_chains_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUBS", 5)
    rng = random.Random(8)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(i, i + 1) for i in range(2000, 2100)] + [(3000, 3001 + k) for k in range(400)] + [(1, None), (7, 7)]
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    near = collections.defaultdict(list)
    for a, b in edges:
        if a in at and b in at:
            near[at[a]].append(at[b])
    want = dict(zip(nodes, smallest_reachable(nodes, lambda i: near[i])))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == want


# Toxicity


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").select("held_out", "toxic", "score", "predicted").toPandas()
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert held[held.toxic == 1].predicted.mean() >= 0.8 and held[held.toxic == 0].predicted.mean() <= 0.03


def test_toxicity_cut_counts_what_a_sample_stands_for(spark, monkeypatch):
    """The cut of a class-balanced sample is that of all rows, and a fit hands over the shares of its draw."""
    rng = np.random.default_rng(8)
    margins, toxic = np.concatenate([rng.normal(2, 1, 20_000), rng.normal(-1, 1, 160_000)]), np.repeat([1, 0], [20_000, 160_000])
    drawn = np.concatenate([np.arange(20_000), 20_000 + rng.choice(160_000, 20_000, replace=False)])
    whole = toxicity.cheapest_cut(margins, toxic, np.ones(180_000))
    assert abs(toxicity.cheapest_cut(margins[drawn], toxic[drawn], np.repeat([1.0, 8.0], 20_000)) - whole) < 0.15
    assert abs(toxicity.cheapest_cut(margins[drawn], toxic[drawn], np.ones(40_000)) - whole) > 0.4
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('word', id % 40, IF(id % 9 = 0, ' bad', ' good')) AS text")
    seen, cut = [], toxicity.cheapest_cut
    monkeypatch.setattr(toxicity, "cheapest_cut", lambda *a: seen.append(a) or cut(*a))
    toxicity.fit(docs, docs.selectExpr("doc_id", "CAST(doc_id % 9 = 0 AS INT) AS toxic"), 50)
    n = collections.Counter(i % 9 == 0 for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1)
    _, labels, times = seen[0]
    assert len(labels) < 200 and np.isclose(times[labels == 1].sum(), n[True]) and np.isclose(times[labels == 0].sum(), n[False])


def test_toxicity_gathers_a_bounded_number_of_bytes(spark, monkeypatch):
    docs, labels = documents(spark), spark.read.parquet(f"{FOLDER}/labels.parquet")
    gathered = []
    own = toxicity.fit_rows
    monkeypatch.setattr(toxicity, "fit_rows", lambda features, toxic: (gathered.append(sum(4 * len(x) for x in features)), own(features, toxic))[1])
    toxicity.fit(docs, labels)
    whole, limit = gathered[0], gathered[0] // 4
    gathered.clear()
    toxicity.fit(docs, labels, feature_bytes=limit)
    assert 0 < gathered[0] < 1.5 * limit < whole


def test_toxicity_weights_against_plain_python():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["awful", "stupid", "idiot"] if k % 3 == 0 and rng.random() < 0.6 else ["garden", "river", "table", "summer"]) for _ in range(4)) for k in range(40)]
    toxic = np.array([int(k % 3 == 0) for k in range(40)])
    features = [np.unique(toxicity.slots(t)) for t in texts]
    weights, b = toxicity.fit_rows(features, toxic)
    n_bad, n_good, checked = int(toxic.sum()), int((1 - toxic).sum()), 0
    ratio = {}
    for slot in {int(s) for f in features for s in f}:
        bad = sum(slot in f for f, t in zip(features, toxic) if t)
        good = sum(slot in f for f, t in zip(features, toxic) if not t)
        r = math.log((bad + 1) / (n_bad + 2)) - math.log((good + 1) / (n_good + 2))
        if bad + good >= toxicity.LEAST_TEXTS and abs(r) >= toxicity.LEAST_RATIO:
            ratio[slot] = r
    assert set(np.flatnonzero(weights)) <= set(ratio) and len(ratio) > 20
    margins = [sum(float(weights[s]) for s in f) + b for f in features]
    share = [40 / (2 * (n_bad if t else n_good)) for t in toxic]
    errors = [c * (1 / (1 + math.exp(-m)) - t) for c, m, t in zip(share, margins, toxic)]
    for slot, r in ratio.items():  # the gradient of the regularised loss is nought where the fit ended
        slope = sum(e * r for e, f in zip(errors, features) if slot in f) + toxicity.PENALTY * float(weights[slot]) / r
        assert abs(slope) < 0.02
        checked += 1
    assert checked == len(ratio) and abs(sum(errors)) < 0.05


def test_toxicity_of_odd_documents(spark):
    docs = odd_documents(spark, ["score", "toxic"])
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 0, 0), (6, 1, 0), (8, 1, 0), (None, 1, 1), (10, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 14 and {r["toxic"] for r in got} == {"kept"} and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.classify(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.classify(no_documents(spark), labels).count() == 0


# Quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_posterior(spark):
    docs = documents(spark).unionByName(odd_documents(spark))
    texts = docs.select("text").collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality.judge(docs)
    assert collections.Counter(tuple(r[c] for c in columns) for r in got.collect()) == collections.Counter(plain_counts(r["text"]) for r in texts)
    votes = [quality.vote(share(), good, bad).alias(f"v{i}") for i, (_, share, good, bad) in enumerate(quality.RULES)]
    rows = [tuple(r) for r in quality.counts(docs).select(*votes).collect()]
    share, habits = quality.estimate(collections.Counter(rows))
    want = sorted(round(quality.posterior(r, share, habits), 6) for r in rows)
    assert np.allclose(sorted(r["quality"] for r in got.collect()), want, atol=2e-6)
    assert all(abs(sum(h) - 1) < 1e-9 for kind in habits for h in kind)


def test_quality_of_odd_documents(spark):
    odd = odd_documents(spark, ["n_words", "quality", "good", "v0", "w", "l"])
    got = quality.judge(odd).collect()
    assert len(got) == 14 and all(0 <= r["quality"] <= 1 and r["good"] == (r["quality"] >= quality.KEPT_FROM) for r in got)
    counts = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_repeat_words"]) for r in got if r["doc_id"] in (3, 4, 5, 7, 8)}
    assert counts == {3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0), 7: (1, 4, 0), 8: (60_000, 240_000, 60_000)}
    assert len({(r["n_words"], r["quality"]) for r in got if r["doc_id"] == 10}) == 1
    assert quality.judge(no_documents(spark)).count() == 0


def test_quality_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    judged = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).filter(~quality.base_failed())
    got = judged.join(labels, "doc_id").toPandas()
    assert got[got.label == 1].good.mean() >= 0.99 and got[got.label == 0].good.mean() <= 0.1
    assert quality.judge(no_documents(spark)).count() == 0


def test_held_out_rule(spark):
    import zlib

    got = {r["doc_id"]: r["h"] for r in spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_pipeline_against_its_parts(spark):
    """run() against a brute-force version of its stages on a small table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark).orderBy("doc_id").limit(250)
    docs = docs.unionByName(spark.createDataFrame([(9_000_001, None, None, "s", None), (9_000_002, "12 34 !", "en", "s", 7)], SCHEMA)).cache()
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert {9_000_001, 9_000_002}.isdisjoint({r["doc_id"] for r in kept.select("doc_id").collect()})
    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    prints = np.array([plain_fingerprint(r["text"]) for r in rows], dtype=np.uint64)
    leaders = smallest_reachable([r["doc_id"] for r in rows], lambda i: np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4))
    rows = [r for r, k in zip(rows, leaders) if r["doc_id"] == k]
    first = {}
    for r in rows:
        for i, _, flat in plain_spans(r["text"])[1]:
            first.setdefault(flat, (r["doc_id"], i))
    left = []
    for r in rows:
        units, found = plain_spans(r["text"])
        gone = {u for i, j, flat in found if first[flat] != (r["doc_id"], i) for u in range(i, j)}
        text = "".join(u for n, u in enumerate(units) if n not in gone)
        if not gone or text.strip(" "):
            left.append((r["doc_id"], r["source"], text))
    n = collections.Counter(s for _, s, _ in left)
    weight = {s: math.sqrt(c) * mixing.BOOSTS.get(s, 1.0) for s, c in n.items()}
    total = sum(weight.values())
    enc = reference_encoding()
    want = collections.Counter()
    for k, s, text in left:
        ids = enc.encode_ordinary(text)
        if copies := inverted(len(left) * weight[s] / total / n[s], k):
            want[k, s, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += copies
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
    got = collections.Counter((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"]) for r in out.collect())
    assert got == want


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    other = " ".join(f"w{k}" for k in range(90))
    third = " ".join(f"v{k * k}" for k in range(90))
    rows = [(1, PROSE, "en", "a"), (1, other, "en", "a"), (1, other, "en", "a"), (2, PROSE, "en", "b"), (2, third, "en", "b"), (3, other, "en", "c"), (4, third, "en", "c"), (5, GERMAN, "de", "c")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([(1, PROSE), (1, other), (2, third), (5, GERMAN)])


def test_near_dedup_keeps_one_of_copies_without_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    other, third = (" ".join(f"{c}{k * k}" for k in range(90)) for c in "wv")
    rows = [(None, PROSE), (None, PROSE), (7, PROSE), (None, other), (None, other), (None, other + " w"), (None, third), (None, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == 4 and (7, PROSE) in got and (None, third) in got
    assert len([t for k, t in got if t and t.startswith("w0 ")]) == 1 and len([t for _, t in got if not t]) == 1


@pytest.mark.parametrize("empty", [False, True])
def test_the_whole_pipeline_on_odd_and_empty_tables(spark, tmp_path, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tessella.llm import shared

    docs = odd_documents(spark, ["score", "component"]).unionByName(documents(spark).limit(60).withColumns({"score": F.lit("e"), "component": F.lit("e")}))
    docs.limit(0 if empty else 1000).write.parquet(f"{tmp_path}/documents.parquet")
    before = shared.staged_so_far()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    assert shared.staged_so_far() == before + 1  # all other tables are deleted
    rows = out.collect()
    assert (len(rows) == 0) == empty
    for r in rows:
        assert hashlib.sha256(" ".join(map(str, r["token_ids"])).encode()).hexdigest() == r["ids_sha256"] and r["n_tokens"] == len(r["token_ids"])


def test_stages_take_odd_and_empty_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clashing = ["score", "rows", "component_id", "_copies", "h", "token_ids", "copy"]
    odd = odd_documents(spark, clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, no_documents(spark), "").count() == 0, name
    assert corpus_pipeline.tokenize(spark, no_documents(spark), "").count() == 0
    assert len(corpus_pipeline.tokenize(spark, odd, "").collect()) == 14
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd, "").collect()]
    # Both rows without an id are copies of documents that have one: of the first, and of the empty ones.
    nameless = [r for r in simhash.near_duplicates(odd, groups=True).collect() if r["doc_id"] is None]
    assert sorted(r["component_id"] for r in nameless) == [1, 3]
    assert kept.count(None) == 0 and 2 not in kept and 4 not in kept and 5 not in kept and kept.count(10) <= 1 and 1 in kept and 3 in kept
    letters = {r["doc_id"] for r in corpus_pipeline.language_id(spark, odd, "").collect()}
    assert not letters & {3, 4, 5, 9} and {1, 2, 6} <= letters
    assert len(corpus_pipeline.substring_dedup(spark, odd, "").collect()) >= 12
    assert corpus_pipeline.mix_sources(spark, odd, "").count() > 0


def test_staged_tables_are_shared_and_can_be_cleared(spark):
    from pathlib import Path

    from tessella.llm.shared import cleared, scratch, staged

    df = staged(spark.range(5).toDF("k"), "kept")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent.parent
    assert str(folder).startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert scratch(spark, "a") != scratch(spark, "a") and staged(spark.range(0).toDF("k"), "none").count() == 0
    cleared(spark)
    assert not folder.exists()
