"""Survival, fuzzy search, automata and recipes against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import codes, expression, models_fit, rounds, survival
from tessella.sources import extractions, tables


def test_chi_square_p_of_known_values():
    for x, degrees, p in [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (0.5, 4, 0.9735009788392561), (60.0, 3, 5.878e-13), (0, 2, 1.0)]:
        assert math.isclose(survival.chi_square_p(x, degrees), p, rel_tol=2e-4)


def partial_likelihood(rows, beta, efron):
    """rows: (entry, stop, event, covariates); log likelihood by its definition."""
    total = 0.0
    risk = [math.exp(sum(b * v for b, v in zip(beta, x))) for *_, x in rows]
    for t in sorted({s for _, s, e, _ in rows if e}):
        dead = [i for i, (_, s, e, _) in enumerate(rows) if e and s == t]
        at_risk = sum(risk[i] for i, (a, s, _, _) in enumerate(rows) if a < t <= s)
        for k, i in enumerate(dead):
            total += math.log(risk[i]) - math.log(at_risk - (k / len(dead) * sum(risk[j] for j in dead) if efron else 0))
    return total


@pytest.mark.parametrize("efron", [False, True])
@pytest.mark.parametrize("late", [False, True])
def test_cox_is_at_the_top_of_the_likelihood(spark, efron, late):
    rng = random.Random(7)
    rows = [(rng.randint(0, 6) if late else -1, s + 7, rng.random() < 0.7, (rng.randint(0, 1), rng.gauss(0, 1))) for s in (rng.randint(1, 12) for _ in range(120))]
    df = spark.createDataFrame([(a, s, e, float(x[0]), x[1]) for a, s, e, x in rows], "a int, s int, e boolean, x double, y double")
    got = models_fit.cox(df, "s", "e", ["x", "y"], entry="a" if late else None, efron=efron)
    beta = [got["x"][0], got["y"][0]]
    top = partial_likelihood(rows, beta, efron)
    h = 1e-3
    for i in range(2):
        up, down = (partial_likelihood(rows, [b + (h * side if j == i else 0) for j, b in enumerate(beta)], efron) for side in (1, -1))
        assert up < top and down < top and abs(up - down) / (2 * h) < 1e-3
    curve = np.array([[(sum(a * b * partial_likelihood(rows, [beta[0] + h * (a * (i == 0) + b * (j == 0)), beta[1] + h * (a * (i == 1) + b * (j == 1))], efron) for a in (1, -1) for b in (1, -1))) / (-4 * h * h) for j in range(2)] for i in range(2)])
    assert np.allclose(np.sqrt(np.diag(np.linalg.inv(curve))), [got["x"][1], got["y"][1]], rtol=1e-3)


def test_curves_and_log_rank_by_definition(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 3), 4 + int(rng.expovariate(0.2 if g == "a" else 0.12)), rng.random() < 0.8) for g in "aabbc" for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, a int, t int, e boolean")
    for entry in (None, "a"):
        got = {(r["g"], r["time"]): r for r in survival.curve(df, "t", "e", "g", entry).collect()}
        for g in "abc":
            s, v = 1.0, 0.0
            for t in sorted({r[2] for r in rows if r[0] == g and r[3]}):
                n = sum(r[0] == g and r[2] >= t and (entry is None or r[1] < t) for r in rows)
                d = sum(r[0] == g and r[2] == t and r[3] for r in rows)
                s *= 1 - d / n
                v += d / (n * (n - d)) if n > d else 0
                row = got[g, t]
                assert (row["at_risk"], row["events"]) == (n, d) and math.isclose(row["survival"], s, abs_tol=1e-9) and math.isclose(row["std_error"], s * math.sqrt(v), abs_tol=1e-9)
                assert (row["lower"] is None) == (s == 0) and (s == 0 or row["lower"] <= s <= row["upper"])
    table, test = survival.log_rank(df, "t", "e", "g")
    observed, expected, v = np.zeros(3), np.zeros(3), np.zeros((3, 3))
    for t in sorted({r[2] for r in rows if r[3]}):
        n = np.array([sum(r[0] == g and r[2] >= t for r in rows) for g in "abc"], dtype=float)
        d = np.array([sum(r[0] == g and r[2] == t and r[3] for r in rows) for g in "abc"], dtype=float)
        observed, expected = observed + d, expected + d.sum() * n / n.sum()
        if n.sum() > 1:
            v += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(n / n.sum()) - np.outer(n, n) / n.sum() ** 2)
    apart = (observed - expected)[:2]
    assert math.isclose(test["statistic"], apart @ np.linalg.inv(v[:2, :2]) @ apart, rel_tol=1e-9) and test["degrees"] == 2 and 0 < test["p"] < 1
    assert [(r["g"], r["observed"]) for r in table.orderBy("g").collect()] == list(zip("abc", observed.astype(int)))
    none = survival.summary(df.filter("not e"), "t", "e", "g", [5]).collect()
    assert len(none) == 3 and all(r["median"] is None and r["at_5"] == 1.0 for r in none)
    assert survival.curve(df.limit(0), "t", "e", "g").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [70.0, 80.0, 100.0])
def test_alike_texts_are_all_found(spark, monkeypatch, cutoff):
    monkeypatch.setattr(codes, "SPLIT", 5)
    rng = random.Random(int(cutoff))
    known = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["aaaaaaaa", "aaaa", "mastocytosis"]

    def misspelt(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, len(t)) : rng.randint(0, len(t))] = rng.choice("abx")
        return "".join(t)

    values = [misspelt(rng.choice(known)) for _ in range(120)] + ["mastocitosis", "", None, "a"]
    got = codes.alike(spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame([(k,) for k in [*known, None, ""]], "k string"), "v", "k", cutoff).collect()
    want = {(v, k) for v in set(values) - {"", None} for k in set(known) if 1 - distance(v, k) / max(len(v), len(k)) >= cutoff / 100 - 1e-9}
    assert {(r["v"], r["k"]) for r in got} == want and len(got) == len(want) and len(want) > 20 - (cutoff == 100) * 15
    with pytest.raises(ValueError):
        codes.alike(spark.createDataFrame([("a",)], "v string"), spark.createDataFrame([("a",)], "k string"), "v", "k", 60.0)


@pytest.mark.parametrize("few", [True, False])
def test_alike_texts_meet_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(codes, "SPLIT", 5)
    monkeypatch.setattr(codes, "FREQUENT", 3)
    monkeypatch.setattr(codes, "LOOKED_FOR", 100_000 if few else 0)
    rng = random.Random(11)
    known = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 34))) for _ in range(80)] + ["aaaaaaaa", "aaaa"]

    def moved(t):
        t = list(t)
        for _ in range(rng.randint(0, max(2, len(t) // 4))):
            at = rng.randint(0, len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "xb"])
        return "".join(t)

    values = [moved(rng.choice(known)) for _ in range(160)]
    v, k = spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame([(k,) for k in known], "k string")
    for cutoff, turned in ((66.7, False), (66.7, True), (75.0, True), (90.0, False)):
        got = (codes.alike(k, v, "k", "v", cutoff) if turned else codes.alike(v, k, "v", "k", cutoff)).collect()
        score = {(v, k): 100 * (1 - distance(v, k) / max(len(v), len(k))) for v in set(values) - {""} for k in set(known)}
        want = {pair: s for pair, s in score.items() if s >= cutoff - 1e-9}
        assert {(r["v"], r["k"]) for r in got} == set(want) and len(got) == len(want) > 30
        assert all(math.isclose(r["score"], want[r["v"], r["k"]]) for r in got)


def broadcast_rows(plan):
    """Rows of all broadcasts in a plan that has run."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return broadcast_rows(plan.executedPlan())
    if kind.endswith("QueryStage"):
        return broadcast_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if kind == "BroadcastExchange" else 0
    return own + sum(broadcast_rows(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("known", [10, 4_000])
def test_alike_broadcasts_few_rows_though_files_are_small(spark, known):
    """A file of words is small, what is made of them isn't; joined by the estimate for the file, the driver collected it all."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(8, 12))) for _ in range(20_000)]
    got = codes.alike(spark.createDataFrame([(w,) for w in words], "v string"), spark.createDataFrame([(w[1:],) for w in words[:known]], "k string"), "v", "k", 75.0)
    assert {(r["v"], r["k"]) for r in got.collect()} >= {(w, w[1:]) for w in words[:known]}
    assert broadcast_rows(got._jdf.queryExecution().executedPlan()) <= 100_000


def test_a_misspelt_name_of_one_word_is_found(spark):
    table = spark.createDataFrame([("D47.0", "Mastocytosis"), ("C50.9", "Malignant neoplasm of breast"), ("C34.9", "Malignant neoplasm of lung")], "code string, description string")
    got = codes.fuzzy_top(spark.createDataFrame([("mastocitosis",), ("brest cancer",), ("breast",)], "v string"), table, "v", cutoff=50).collect()
    assert {(r["v"], r["code"]) for r in got} >= {("mastocitosis", "D47.0"), ("breast", "C50.9")}


def test_automata_find_what_stands_anywhere(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(100, None), (101, "")]
    words = list({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(150)})
    want = sorted((i, w) for i, t in texts for w in words if t and w in t)
    for most in (100_000, 20):
        monkeypatch.setattr(codes, "AUTOMATON", most)
        got = codes.containing(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame([(w,) for w in [*words, None, "", words[0]]], "w string"), "t", "w")
        assert sorted((r["i"], r["w"]) for r in got.collect()) == want
    assert codes.containing(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame([], "w string"), "t", "w").count() == 0


class Failing:
    """Answers a chunk with itself, but for those that hold a word; notes each call in a file."""

    def __init__(self, log, word=None):
        self.log, self.word = str(log), word

    def generate(self, prompt):
        text = prompt.split("\n", 1)[1]
        with open(self.log, "a") as f:
            f.write(text + "\n")
        if self.word and self.word in text:
            raise RuntimeError("down")
        return text


def test_rounds_go_on_where_they_stopped(spark, tmp_path):
    rng = random.Random(4)
    chunks = [(f"p{i}", k, '{"f%d": {"value": "v%d%s", "confidence": %s}}' % (rng.randint(0, 2), k, "x" if i == 2 and k == 4 else "", round(rng.random(), 2))) for i in range(6) for k in range(i + 2)]
    df = spark.createDataFrame(chunks, "p string, k int, t string")
    want = rounds.final_rows(rounds.extract(df, "p", "k", "t", Failing(tmp_path / "a"), f"file://{tmp_path}/one", 2), "p").collect()
    folder = f"file://{tmp_path}/two"
    rounds.extract(df, "p", "k", "t", Failing(tmp_path / "b"), folder, 2, most=0)
    down = {r["p"]: r["rounds"] for r in rounds.final_rows(rounds.extract(df, "p", "k", "t", Failing(tmp_path / "b", "v3"), folder, 2), "p").collect()}
    assert down["p0"] == 1 and down["p3"] == 1  # chunk 3 stands in the second round
    before = len((tmp_path / "b").read_text().splitlines())
    got = rounds.final_rows(rounds.extract(df, "p", "k", "t", Failing(tmp_path / "b"), folder, 2), "p").collect()
    assert sorted(got) == sorted(want)
    assert before < len((tmp_path / "b").read_text().splitlines())
    again = len((tmp_path / "b").read_text().splitlines())
    assert rounds.extract(df, "p", "k", "t", Failing(tmp_path / "b"), folder, 2).count() == sum(-(-(i + 2) // 2) for i in range(6))
    assert len((tmp_path / "b").read_text().splitlines()) == again  # nothing is asked twice
    assert rounds.extract(df.limit(0), "p", "k", "t", Failing(tmp_path / "c"), f"file://{tmp_path}/three").count() == 0


def test_the_last_line_over_several_files_wins(spark, tmp_path):
    line = '{"patient_id": "a", "round": 1, "extraction": "%s", "num_chunks": 1}\n'
    for name, what in (("b", "late"), ("a", "early")):
        (tmp_path / f"{name}.jsonl").write_text((line % "first") * 3 + line % what)
    assert [r["extraction"] for r in tables.read_rounds(spark, str(tmp_path)).collect()] == ["late"]


@pytest.mark.parametrize("tumor", ["null", '"two"', "1e400", "[1]", "2"])
def test_an_odd_tumour_number_ends_no_job(tumor):
    rows = list(extractions.consolidated_rows('{"patient_id": "p", "diagnoses": [{"tumor_index": %s, "site": "C50"}]}' % tumor, "p", {}))
    assert {r[3] for r in rows} == {2 if tumor == "2" else -1}


def test_tails_of_t_and_gamma_derivatives():
    for t, degrees, p in [(2.228138851964939, 10, 0.05), (12.706204736432095, 1, 0.05), (0.5, 3, 0.6514483), (1.959963984540054, math.inf, 0.05), (0.0, 5, 1.0), (-4.0, 2, 1 - 4 / math.sqrt(18)), (1.5, 1, 1 - 2 / math.pi * math.atan(1.5)), (7.0, 1, 1 - 2 / math.pi * math.atan(7))]:
        assert math.isclose(expression.t_p(np.array([t]), degrees)[0], p, rel_tol=1e-4)
    assert math.isclose(expression.digamma(1.0), -0.5772156649015329, rel_tol=1e-10) and math.isclose(expression.digamma(0.5, 1), math.pi**2 / 2, rel_tol=1e-10)
    degrees, variance = expression.prior_of(math.log(2.0) + expression.digamma(2.0) - math.log(2.0) - expression.digamma(5.0) + math.log(5.0), expression.digamma(2.0, 1) + expression.digamma(5.0, 1), 4)
    assert math.isclose(degrees, 10, rel_tol=1e-6) and math.isclose(variance, 2.0, rel_tol=1e-6)


def test_moderated_t_against_plain_python(spark):
    rng = np.random.default_rng(5)
    genes, samples = 120, 8
    level = rng.gamma(2, 60, genes)
    counts = rng.poisson(np.outer(level, np.ones(samples)) * rng.gamma(8, 1 / 8, (genes, samples)) * np.where((np.arange(genes)[:, None] < 10) & (np.arange(samples) >= 4), 4, 1))
    df = spark.createDataFrame([(g, s, int(counts[g, s])) for g in range(genes) for s in range(samples)], "g int, s int, c int")
    got = {r["g"]: r for r in expression.moderated_t(df, "g", "s", "c", F.col("s") >= 4).collect()}
    total = counts.sum(axis=0) + 1
    y = np.log2((counts + 0.5) / total * 1e6)
    side = np.arange(samples) >= 4

    def fitted(w):
        m = [np.sum(w[:, side == k] * y[:, side == k], axis=1) / w[:, side == k].sum(axis=1) for k in (False, True)]
        return m, sum(np.sum(w[:, side == k] * (y[:, side == k] - m[int(k)][:, None]) ** 2, axis=1) for k in (False, True)) / (samples - 2)

    m, variance = fitted(np.ones_like(y))
    size = y.mean(axis=1) + np.log2(total).mean() - math.log2(1e6)
    borders = sorted(set(spark.createDataFrame([(float(x),) for x in size], "x double").approxQuantile("x", [i / expression.TREND for i in range(1, expression.TREND)], 0.001)))
    part = np.searchsorted(borders, size, side="left")
    points = sorted((size[part == k].mean(), (variance[part == k] ** 0.25).mean()) for k in set(part))
    expected = np.where(side, m[1][:, None], m[0][:, None]) + np.log2(total) - math.log2(1e6)
    w = np.interp(expected, [x for x, _ in points], [v for _, v in points]) ** -4.0
    m, variance = fitted(w)
    before, usual = expression.prior_of(np.log(variance).mean(), np.log(variance).var(ddof=1), samples - 2)
    shrunk = usual if math.isinf(before) else (before * usual + (samples - 2) * variance) / (before + samples - 2)
    t = (m[1] - m[0]) / np.sqrt(shrunk * (1 / w[:, ~side].sum(axis=1) + 1 / w[:, side].sum(axis=1)))
    assert np.allclose([got[g]["t"] for g in range(genes)], t, rtol=1e-6) and np.allclose([got[g]["log_fold"] for g in range(genes)], m[1] - m[0])
    assert sum(got[g]["adjusted"] < 0.05 for g in range(10)) >= 8 and sum(got[g]["adjusted"] < 0.05 for g in range(10, genes)) <= 6


def test_enrichment_against_plain_python(spark):
    rng = random.Random(8)
    genes = [(f"g{i}", float(rng.randint(-20, 20)) or 1.0) for i in range(200)]
    order = [g for g, _ in sorted(genes, key=lambda r: (-r[1], r[0]))]
    weight = dict(genes)
    sets = {"top": order[:15], "bottom": order[-20:], "any": rng.sample(order, 30), "one": [order[40]], "none": ["x"], "all": order}
    df = spark.createDataFrame([(k, g) for k, own in sets.items() for g in own], "name string, g string")
    got = {r["name"]: r for r in expression.enrichment(spark.createDataFrame([*genes, ("null", None)], "g string, score double"), df, "g", "score", "name", draws=150).collect()}
    assert set(got) == {"top", "bottom", "any", "one"}
    for k in got:
        at, path = 0.0, [0.0]
        whole = sum(abs(weight[g]) for g in sets[k])
        for g in order:
            at += abs(weight[g]) / whole if g in sets[k] else -1 / (200 - len(sets[k]))
            path.append(at)
        assert math.isclose(got[k]["enrichment"], max(path) if max(path) >= -min(path) else min(path), abs_tol=1e-9)
    assert got["top"]["p"] < 0.05 and got["bottom"]["p"] < 0.05 and got["top"]["enrichment"] > 0.9 > 0 > got["bottom"]["enrichment"]


def test_p_of_two_groups(spark):
    rng = random.Random(12)
    rows = [(k < 30, float(rng.randint(0, 12) + (k < 30) * 2)) for k in range(70)]
    df = spark.createDataFrame([*rows, (True, None)], "g boolean, v double")
    a, b = ([v for g, v in rows if g == side] for side in (True, False))
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    got = expression.rank_test(df, "v", F.col("g"))
    assert got["u"] == u
    draws = []
    every = [v for _, v in rows]
    for _ in range(4000):
        rng.shuffle(every)
        draws.append(abs(sum((x > y) + (x == y) / 2 for x in every[:30] for y in every[30:]) - 600) >= abs(u - 600))
    assert abs(sum(draws) / 4000 - got["p"]) < 0.02 and 0 < got["p"] < 0.2
    t = expression.t_test(df, "v", F.col("g"))
    assert abs(t["p"] - got["p"]) < 0.06 and t["degrees"] > 50
    same_value = spark.createDataFrame([(True, 1.0), (False, 1.0), (True, 1.0)], "g boolean, v double")
    assert expression.rank_test(same_value, "v", F.col("g"))["p"] is None
