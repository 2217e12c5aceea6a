"""WARC archives, URL filters and vectors."""

import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from oracle import connection, same
from tessella.llm import queries, urls, vectors, warc

FOLDER = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    same(spark, connection(FOLDER), queries.queries()[name], queries.oracle_sql()[name], FOLDER)


# WARC


def pages(spark):
    long = "<p>é" * 400
    rows = [
        (1, "http://a.net/x", long), (2, "http://a.net/ y\r\nz", long), (3, None, "short"), (4, "http://b", "short"), (5, "u", None), (None, "n", long), (None, None, None),
        (7, "v", long), (7, "v", long), (8, "w", "x" * 200_000), (9, "w", ""), (10, "z", "y" * 1000), (11, "z", "y" * 999), (12, "z", "y" * 1000), (13, "z", "y" * 999),
    ]
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'e' AS refers_to", "'e' AS digest")


def test_archives_come_back(spark):
    archives = warc.write(pages(spark))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) for r in warc.read(archives, payloads=True).collect()), key=str)
    long = ("<p>é" * 400).encode()
    want = [
        (1, "revisit", 7, len(long), None), (2, "revisit", 7, len(long), None), (3, "response", None, 5, b"short"), (4, "response", None, 5, b"short"), (5, "response", None, 0, b""),
        (None, "response", None, len(long), long), (None, "response", None, 0, b""), (7, "response", None, len(long), long), (7, "response", None, len(long), long),
        (8, "response", None, 200_000, b"x" * 200_000), (9, "response", None, 0, b""), (10, "revisit", 12, 1000, None), (11, "response", None, 999, b"y" * 999),
        (12, "response", None, 1000, b"y" * 1000), (13, "response", None, 999, b"y" * 999),
    ]
    assert [(a, b, c, d, e if e is None else bytes(e)) for a, b, c, d, e in got] == sorted(want, key=str)
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    named = []
    for k in range(40):
        uri = f"file://{tmp_path}/{k}.warc.zst"
        warc.write_archive(uri, iter([warc.record_bytes(100 * k + i, "http://h/", b"text %d" % i, None, i) for i in range(20)]))
        named.append((uri,))
    archives = spark.createDataFrame(named, "uri string")
    got = warc.read(archives).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["page_id"] for r in got) == [100 * k + i for k in range(40) for i in range(20)]
    assert len({r["task"] for r in got}) >= 20


def one_archive(tmp_path, n=60, enough=1 << 30):
    records = [warc.record_bytes(i, f"http://h/{i}", f"<html>page {i} of the same kind {'x' * (i % 9)}</html>".encode(), None, i) for i in range(n)]
    path = tmp_path / "a.warc.zst"
    left = iter(records)
    count, size = warc.write_archive(f"file://{path}", left, enough)
    return path, records, count, size


def test_the_file_is_a_dictionary_frame_and_one_frame_a_record(tmp_path):
    path, records, count, size = one_archive(tmp_path)
    data = path.read_bytes()
    magic, length = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and count == 60 and len(data) == size
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + length]))
    rest, found = data[8 + length :], []
    while rest:
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        found.append(d.decompress(rest))
        rest = d.unused_data
    assert found == records == list(warc.read_archive(f"file://{path}", chunk=7))


def test_archives_roll_over(tmp_path):
    _, records, count, _ = one_archive(tmp_path, enough=3000)
    assert 0 < count < len(records)


def test_broken_archives_are_refused(tmp_path):
    path, records, _, _ = one_archive(tmp_path)
    data = path.read_bytes()
    for bad in (b"", data[:6], b"x" + data, data[:50], data[:-3]):
        path.write_bytes(bad)
        with pytest.raises((warc.BadRecord, zstandard.ZstdError)):
            list(warc.read_archive(f"file://{path}"))
    good = records[3]
    assert warc.parse_record(good)["payload_bytes"] == len(warc.parse_record(good)["payload"])
    for old, new in (
        (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type: response\r\n", b""), (b"WARC-Type: response", b"WARC-Type: other"), (b"page 3", b"page 4"), (b"page 3", b"page 33"),
        (b"WARC-Date:", b"WARC Date"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 1"), (b"sha1:", b"md5:"),
    ):
        assert old in good
        with pytest.raises(warc.BadRecord):
            warc.parse_record(good.replace(old, new, 1))
    with pytest.raises(warc.BadRecord):
        warc.parse_record(good[:-1])
    revisit = warc.record_bytes(1, "u", b"x" * 2000, 9, 0)
    got = warc.parse_record(revisit)
    assert got["payload"] is None and got["payload_bytes"] == 2000 and got["warc-refers-to"] == "<urn:page:9>"
    with pytest.raises(warc.BadRecord):
        warc.parse_record(revisit.replace(b"WARC-Refers-To", b"WARC-Refers-Ta"))


# URLs


def plain_rule(url):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for rule, verdict in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def odd_urls(spark):
    rows = [
        "http://A.Example.NET/en/x?y=1#z", "https://example.net/en", "http://example.net/En/", "http://notexample.net/en/1", "http://net/", "http://net", "http://x.org/fr/1", "http://org/fr/",
        "http://x.org/de/1", "//a.net/x", "no scheme", "", None, "http://a.net/x://b.org/fr/", "ftp://Ä.COM/de/ö", "http://example.com/de/?a=b&c=d", "http://u@example.com:80/de/", "http://a.net\n/en/", "x" * 50_000,
    ]
    return spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").selectExpr("*", "'kept' AS length", "'e' AS verdict", "'kept' AS n")


def test_rules_against_brute_force(spark):
    docs = odd_urls(spark).select("page_id", "url").unionByName(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url"))
    for r in urls.judge(docs).collect():
        host, path, rule, verdict = plain_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] == verdict if verdict else r["verdict"] == ("block" if r["block_score"] >= 0.5 else "allow")
        assert 0 <= r["block_score"] <= 1


def test_trees_learn_what_rules_say(spark):
    got = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")).filter("rule is not null").toPandas()
    blocked = got.verdict == "block"
    assert ((got.block_score >= 0.5) == blocked).mean() > 0.75


def test_trees_judge_urls_that_taught_nothing(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    teaches = F.pmod(F.xxhash64("url", F.lit(99)), F.lit(3)) != 0
    got = urls.judge(pages, teaches=teaches).filter("rule is not null").withColumn("taught", teaches).toPandas()
    got["right"] = (got.block_score >= 0.5) == (got.verdict == "block")
    held = got[~got.taught]
    assert len(held) > 300
    by_rule = held.groupby("rule").right.mean()
    # Beside the largest class of each group of rules, the trees have to tell paths and hosts apart.
    assert held.right.mean() > max(0.75, (held.verdict == "block").mean()) and (by_rule > 0.5).sum() >= 3, by_rule


def test_the_expression_of_trees_is_the_model(spark):
    rng = np.random.default_rng(6)
    rows = [(*map(float, rng.normal(size=len(urls.FEATURES)).round(1)), float(rng.random() < 0.4), float(rng.integers(1, 4))) for _ in range(400)]
    df = urls.assembled(spark.createDataFrame(rows, [*urls.FEATURES, "label", "n"]))
    model = urls.fitted(df)
    got = model.transform(df).withColumn("s", urls.tree_score(model)).toPandas()
    assert np.allclose(got.s, got.probability.map(lambda v: v[1])) and got.s.nunique() > 20


def test_odd_urls(spark):
    got = urls.judge(odd_urls(spark)).collect()
    assert len(got) == 19 and {(r["length"], r["n"]) for r in got} == {("kept", "kept")}
    alike = urls.judge(odd_urls(spark).filter("url like '%en/x%'")).collect()
    assert [r["verdict"] for r in alike] == ["allow"]
    assert {r["verdict"] for r in urls.judge(odd_urls(spark).filter("url = 'no scheme'")).collect()} == {"allow"}
    assert urls.judge(odd_urls(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.rule_columns([("a/", "block")] * 501)


def test_features(spark):
    row = urls.with_features(urls.with_host_and_path(spark.createDataFrame([("http://ab-c.example.net/p/q?x=1&y=2#f",)], "url string")), *map(F.lit, (0.5, 0.25, 0.125, 0.75))).first()
    url = "http://ab-c.example.net/p/q?x=1&y=2#f"
    p = np.array([url.count(c) for c in set(url)]) / len(url)
    want = {"length": len(url), "host_length": len("ab-c.example.net"), "path_length": 4, "depth": 2, "labels": 3, "digits": 2 / len(url), "hyphens": 1 / len(url), "capitals": 0, "parameters": 2, "query_length": 7, "fragment": 1}
    assert all(abs(row[f"_{k}"] - v) < 1e-12 for k, v in want.items())
    assert abs(row["_entropy"] + (p * np.log2(p)).sum()) < 1e-9


# Vectors


def brute_force(rows):
    """(links, component) of each vec_id, copies and all."""
    good = {}
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))
    near = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and good[k] @ good[j] >= 0.9} for k in good}
    component = {k: k for k, _ in rows if k is not None}
    for k in sorted(good):
        todo = [k]
        while todo:
            x = todo.pop()
            for j in near[x]:
                if component[j] > component[k] or (component[j] == j and j > k):
                    component[j] = component[k]
                    todo.append(j)
    return {k: (len(near.get(k, ())), component[k]) for k in component}


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 16))
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    rows += [(200 + i, (centers[i % 6] + 0.1 * rng.normal(size=16)).tolist()) for i in range(180)]
    rows += [(500 + i, rows[3][1]) for i in range(90)] + [(600, (np.array(rows[3][1]) * 2).tolist())]
    rows += [(700, None), (701, [0.0] * 16), (702, [None] + [1.0] * 15), (703, [float("nan")] * 16), (704, [float("inf")] + [0.0] * 15), (705, []), (706, [1.0, 0.0]), (707, [2.0, 0.1]), (None, [1.0] * 16), (None, None)]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("key", F.lit("e"))
    tiny = [[1e200, 0.0, 0.0], [1e200, 1e198, 0.0], [1e-200, 0.0, 0.0], [1e-200, 1e-202, 0.0], [5e-324, 0.0, 5e-324]]
    extreme = [(800 + i, v) for i, v in enumerate(tiny)]
    assert [(r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(extreme, df.schema[:2])).orderBy("vec_id").collect()] == [(3, 800)] * 4 + [(0, 804)]
    got = vectors.near_duplicates(df).collect()
    want = brute_force(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert len(got) == len(want) + 1
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_passes(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    degree = {r["vec_id"]: int((m @ m[i] >= 0.9).sum()) - 1 for i, r in enumerate(rows)}
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()}
    assert all(got[k] <= n for k, n in degree.items())
    assert sum(got.values()) >= 0.9 * sum(degree.values())


def cone_with_pairs(n, pairs, dim=64, seed=11):
    """Random unit vectors, a third of them in one cone (cosine about 0.7), the first ``pairs`` rows of either with a partner at cosine 0.905."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[: n // 3] = np.sqrt(0.7) * m[0] + np.sqrt(0.3) * m[: n // 3]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    at = np.concatenate([np.arange(pairs), n // 3 + np.arange(pairs)])
    aside = rng.normal(size=(2 * pairs, dim))
    aside -= (aside * m[at]).sum(axis=1, keepdims=True) * m[at]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    return np.concatenate([m, 0.905 * m[at] + np.sqrt(1 - 0.905**2) * aside]), at


@pytest.mark.parametrize("windows", [(64, 256), (64, 256, 1024, 4096)])
def test_planted_pairs_in_a_hot_cone(spark, monkeypatch, windows):
    monkeypatch.setattr(vectors, "WINDOWS", windows)
    m, at = cone_with_pairs(20_000, 300)
    passes, window = vectors.planned(m, len(m))
    assert passes > 1 and window < len(m) / 2
    df = spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in vectors.near_duplicates(df).collect()}
    found = np.array([got[20_000 + k] == got[i] for k, i in enumerate(at)])
    assert found[:300].mean() >= 0.97 and found[300:].mean() >= 0.98


def test_vectors_of_many_lengths_share_the_passes(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3 + i % 40).tolist()) for i in range(1200)]
    rows += [(5000 + i, [2 * x for x in v]) for i, v in rows[:400]]
    want = brute_force(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()} == want


@pytest.mark.parametrize(("rows", "part"), [(2048, 8192), (100, 700)])
def test_no_link_depends_on_the_plan(spark, monkeypatch, rows, part):
    for name, value in (("WINDOWS", (64,)), ("MISS", 0.9), ("ROWS", rows)):
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors, "PART_ROWS", part, raising=False)
    m, _ = cone_with_pairs(2000, 300)
    data = [(i, v) for i, v in enumerate(m.tolist())] + [(9000 + i, [3 * x for x in v[:40]]) for i, v in enumerate(m[:900].tolist())] + [(9900, m[7].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()} == brute_force(data)


def test_single_precision_loses_no_pair():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    aside = rng.normal(size=a.shape)
    aside -= (aside * a).sum(axis=1, keepdims=True) * a
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    c = 0.9 + rng.choice([-1e-9, 1e-9, -1e-6, 1e-6], size=(len(a), 1))
    b = c * a + np.sqrt(1 - c * c) * aside
    of_a, of_b = np.arange(1500), np.arange(1500, 3000)
    of_b[:200] = of_a[:200]
    want = {(i, j) for i, j in zip(*np.nonzero(a @ b.T >= 0.9)) if of_a[i] != of_b[j]}
    assert {(i, j) for i, j in zip(*vectors.unlike_pairs(a, b, of_a, of_b, 0.9))} == want and 600 < len(want) < 700
    assert not len(vectors.unlike_pairs(a, a, 0 * of_a, 0 * of_a, 0.9)[0])


def test_passes_are_planned_by_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PROBES", 50)
    m, _ = cone_with_pairs(3000, 10)
    rows = list(enumerate(m.tolist())) + [(5000 + i, v[:30]) for i, v in enumerate(m[1000:2500].tolist())] + [(7000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("dim", F.size("vector")).repartition(7)
    probe = {}
    for r in df.orderBy(F.xxhash64("id", F.lit(vectors.SEED)), "id").limit(50).collect():
        probe.setdefault(r["dim"], []).append(r["vector"])
    want = []
    for dim in (30, 64):
        unit, p = (vectors._unit(np.array(x)) for x in ([v for _, v in rows if len(v) == dim], probe[dim]))
        want.append(vectors.plan(vectors.between(unit, p, vectors.partners(p, 0.9)), len(unit), 64))
    assert vectors.plans(df) == want
    assert vectors.plans(df.limit(0)) == []
