"""Model flows, column classes, running aggregates, derived variables, code likeness and dialect, beyond what queries show."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessella.operators import codes, deid, derive, models, models_fit, notes, stats
from tessella.plans.dialect import Refused, translated

CLASSES = {
    "patient_id": (*deid.PATIENT_IDS, "Patient ID", "the_patient_key_id"),
    "mrn": (*deid.MRN_NAMES, "hospital_mrn"),
    "birth_date": deid.BIRTH_NAMES,
    "age": (*deid.AGE_NAMES, "age_years", "onset_age"),
    "name": (*deid.PERSON_NAMES, "patient first", "member_surname", "given_name"),
    "drop": (*deid.IDENTIFIERS, *deid.STATE_NAMES, "home_phone", "account_no", "insurance_id", "policy_number", "Zip Code", "ip"),
    "date": ("visit_date", "date", "seen_dt"),
    "text": deid.TEXT_WORDS,
    None: ("disease_state", "drug_name", "facility_name", "provider_name", "hospital_first", "stage", "remarks", "state_of_disease"),
}


@pytest.mark.parametrize("kind", list(CLASSES))
def test_a_name_tells_what_a_column_holds(kind):
    assert {c: deid.class_by_name(c) for c in CLASSES[kind]} == dict.fromkeys(CLASSES[kind], kind)


def test_values_of_all_rows_decide(spark):
    rng = random.Random(1)
    sentence = lambda k: " ".join(rng.choice(["came", "with", "pain", "left", "arm", "again", "today"]) for _ in range(7)) + f" {k}"
    rows = [(i, sentence(i), "blue" if i < 400 else f"a{i}@b.org", "plain", "2020-01-02" if i % 10 else "soon", "C50" if i % 2 else None, "" if i < 500 else "555-123-4567") for i in range(600)]
    df = spark.createDataFrame(rows, "k int, remarks string, reach string, word string, seen string, code string, late string").withColumn("day", F.lit("2020-01-01").cast("date"))
    assert deid.classified(df) == {"k": "keep", "remarks": "text", "reach": "drop", "word": "keep", "seen": "date", "code": "keep", "late": "drop", "day": "date"}
    assert deid.classified(df.limit(0))["remarks"] == "keep" and deid.classified(df, {"Word": "drop"})["word"] == "drop"


def test_every_part_of_a_name_is_replaced(spark):
    df = spark.createDataFrame([("a", "Zoe", "Quux", "Wanda", "woman"), ("b", "Bob", "Baz", None, None)], "empi string, fname string, last_nm string, middle_nm string, sex string")
    classes = deid.classified(df)
    known = deid.identities(df.select(deid.identity_key(F.col("empi"), None).alias("identity"), "sex"), "s", 10)
    out = {r["empi"]: r for r in deid.deidentified(df, classes, known).collect()}
    row = out["P000001"]
    assert row["fname"] in deid.FIRST_NAMES["f"] and row["last_nm"] in deid.LAST_NAMES and len(row["middle_nm"]) == 1 and out["P000002"]["fname"] in deid.FIRST_NAMES[""]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_running_aggregates(spark, monkeypatch, descending, strict):
    monkeypatch.setattr(stats, "RANGES", 7)
    rng = random.Random(2)
    rows = [(g, float(t), rng.randint(1, 9)) for g in "ab" for t in rng.sample(range(500), 90)]
    df = spark.createDataFrame(rows, "g string, t double, m int")
    for by in (None, "g"):
        part = [r for r in rows if by or r[0] == "a"]
        got = {(r["g"], r["t"]): (r["total"], r["lowest"]) for r in stats.running(df.filter(F.lit(bool(by)) | (F.col("g") == "a")), "t", {"total": ("sum", F.col("m")), "lowest": ("min", F.col("m"))}, descending, strict, by).collect()}
        for g, t, m in part:
            before = [x for h, s, x in part if h == g and (s > t if descending else s < t)] + ([] if strict else [m])
            assert got[g, t] == ((sum(before), min(before)) if before else (None, None))


def test_survival_of_dates_and_of_nothing(spark):
    df = spark.createDataFrame([("2020-01-01", 1), ("2020-02-01", 0), ("2020-03-01", 1)], "d string, e int").withColumn("d", F.col("d").cast("date"))
    assert [round(r["survival"], 6) for r in stats.kaplan_meier(df, "d", "e").orderBy("time").collect()] == [round(2 / 3, 6), 0.0]
    assert stats.kaplan_meier(df.limit(0), "d", "e").count() == 0 and stats.adjusted_p(spark.createDataFrame([], "p double"), "p").count() == 0


def test_five_numbers_of_narrow_and_wide_columns(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randint(0, 5), rng.random(), None) for _ in range(700)]
    df = spark.createDataFrame(rows, "a int, b double, c double")
    monkeypatch.setattr(stats, "NARROW", 100)
    got = {r["column_name"]: r for r in stats.five_numbers(df, ["a", "b", "c"]).collect()}
    for k, c in enumerate("ab"):
        v = sorted(r[k] for r in rows)
        q1, q2, q3 = statistics.quantiles(v, n=4, method="inclusive")
        assert all(math.isclose(x, y) for x, y in zip((got[c]["q1"], got[c]["median"], got[c]["q3"]), (q1, q2, q3))) and got[c]["n_values"] == 700
    assert got["c"]["n_values"] == 0 and got["c"]["median"] is None


def test_derived_variables_of_odd_rows(spark):
    df = spark.createDataFrame([("a", "er", 1, None), ("a", "pr", 2, False), ("b", "er", 1, True), ("c", "er", 1, False), ("c", "pr", 1, False), (None, "er", 1, False)], "p string, test string, t int, pos boolean")
    got = {r["p"]: r["neg"] for r in derive.all_negative(df, ["p"], "test", F.col("pos"), ["er", "pr"], "neg").collect()}
    assert got == {"a": None, "b": False, "c": True, None: None}
    assert {r["p"]: r["test"] for r in derive.selected(df, ["p"], "test", "t", until=F.col("t") > 1).collect()} == {"a": "pr", "b": None, "c": None, None: None}
    assert derive.quality_flags(df.limit(0), ["p", "t"], ["t"]).collect()[0]["missing_share"] is None
    row = derive.reduced(df.filter("p = 'a'"), ["p"], "test", ["t"], {"pr": 9}, F.col("pos")).first()
    assert (row["first"], row["most_recent"], row["worst"], row["any_positive"], row["distinct_values"]) == ("er", "pr", "pr", False, "er; pr")
    assert spark.range(1).select(derive.body_mass_index(F.lit(80.0), F.lit(0.0))).first()[0] is None


def test_association_picks_its_test(spark):
    small = spark.createDataFrame([("a", "x")] * 9 + [("a", "y")] + [("b", "x")] * 2 + [("b", "y")] * 8, "u string, v string")
    assert models_fit.association(small, "u", "v") == {"method": "fisher", "p": models_fit.fisher_p(9, 1, 2, 8)}
    large = models_fit.association(small.unionByName(small).unionByName(small).unionByName(small).unionByName(small), "u", "v")
    assert large["method"] == "chi-square" and large["p"] < 0.001


def test_principal_components(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.poisson(3, size=(60, 8)).astype(float)
    m[:30, 0] += 40
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "cell int, counts array<double>")
    got = {r["cell"]: np.array(r["components"]) for r in models_fit.principal_components(df, "cell", "counts", 2, genes=5).collect()}
    logs = np.log1p(m / m.sum(axis=1, keepdims=True) * 10_000)
    kept = np.sort(np.argsort(-logs.var(axis=0))[:5])
    x = logs[:, kept]
    _, _, axes = np.linalg.svd(x - x.mean(axis=0))
    for k in range(2):
        want = x @ axes[k]
        mine = np.array([got[i][k] for i in range(60)])
        assert np.allclose(np.abs(mine), np.abs(want)) or np.allclose(mine, want) or np.allclose(mine, -want)


def test_likeness_of_descriptions():
    assert codes.similarity("breast", "Malignant neoplasm of breast") == 100
    assert codes.similarity("neoplasm of breast", "malignant neoplasm of pancreas") < 65
    assert codes.similarity("malignant neoplasm", "Malignant neoplasm of lung") == 100  # boilerplate on one side costs nothing
    assert codes.partial_ratio("lung", "left lung") == 1 and codes.partial_ratio("", "x") == 0


def test_empty_values_resolve_to_nothing(spark):
    table = spark.createDataFrame([("C50", "Breast"), ("c50", "Other"), ("C34", "Lung")], "code string, description string")
    values = spark.createDataFrame([(None,), ("",), (" ",), ("C50",), ("lung ",), ("LUNG",), ("c34",), ("none",)], "v string")
    got = [(r["v"], r["resolved_code"], r["resolution_confidence"]) for r in codes.resolved(values, table, "v").collect()]
    assert sorted(got, key=str) == sorted([(None, None, 0.0), ("", None, 0.0), (" ", None, 0.0), ("C50", "C50", 1.0), ("lung ", "C34", 0.9), ("LUNG", "C34", 0.9), ("c34", "C34", 0.95), ("none", None, 0.0)], key=str)


def test_pieces_cover_any_text():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["\n--- ", "a", "bc ", "\n"]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.randint(6, 30), rng.randint(0, 5)
        got = notes.pieces_at_boundaries(text, size, overlap, reach=rng.randint(0, 40))
        begin = end = 0
        for k, piece in enumerate(got):
            begin = max(begin + 1, end - overlap) if k else 0
            end = begin + len(piece)
            assert 0 < len(piece) <= size and text[begin:end] == piece
        assert end == len(text)
    assert notes.pieces_at_boundaries("abc", 0) == ["abc"] and notes.pieces_at_boundaries("", 5) == []


def test_functions_that_are_defined_otherwise(spark):
    import duckdb

    spark.sql("SELECT * FROM VALUES (1.0D), (2.0D), (5.0D), (9.0D), (NULL) AS v(x)").createOrReplaceTempView("moments")
    con = duckdb.connect()
    con.execute("CREATE TABLE moments AS SELECT * FROM (VALUES (1.0::DOUBLE), (2.0), (5.0), (9.0), (NULL)) v(x)")
    for call in ("kurtosis(x)", "skewness(x)", "kurtosis_pop(x)", "kurtosis(greatest(x, 2))", "skewness(x + length(')('))"):
        mine, theirs = spark.sql(translated(f"SELECT {call} AS k FROM moments")).first()[0], con.execute(f"SELECT {call} AS k FROM moments").fetchone()[0]
        assert math.isclose(mine, theirs, rel_tol=1e-9), call
    assert spark.sql(translated("SELECT skewness(x) AS s, kurtosis(x) AS k FROM moments WHERE x < 3")).first()[:] == (None, None)
    assert sorted(spark.sql(translated("SELECT list(x) AS l FROM moments")).first()[0], key=str) == [1.0, 2.0, 5.0, 9.0, None]
    for text in ("SELECT entropy(x) FROM moments", "SELECT histogram(x) FROM moments", "SELECT kurtosis(x) FILTER (WHERE x > 1) FROM moments"):
        with pytest.raises(Refused):
            translated(text)


def clerk():
    """Answers by the prompt; every third call fails, and one record is never answered."""

    class Clerk:
        def __init__(self):
            self.calls = 0

        def generate(self, prompt):
            self.calls += 1
            if self.calls % 3 == 2 or "mute" in prompt:
                raise RuntimeError("busy")
            if prompt.startswith("Name every"):
                return "thought" if "garbled" in prompt else json.dumps([{"diagnosis": "lung cancer"}, "skin cancer", ""])
            if prompt.startswith("Give each"):
                return "[]" if "uncoded" in prompt else json.dumps([{"site": "C34"}, {"site": "C44", "histology": 8720}])
            if prompt.startswith("Known so far"):
                record = prompt.rsplit("Record:\n", 1)[1]
                return json.dumps({q.upper(): a for q, _, a in (x.partition("=") for x in record.split())})
            if prompt.startswith(("Write", "Bring")):
                return f" {prompt.count('part') + prompt.count('Summary')} lines "
            return json.dumps({"stage": {"value": "II", "confidence": 0.8}, "grade": 3})

    return Clerk()


def test_diagnoses_in_two_steps(spark):
    long = " and so on for some time"
    df = spark.createDataFrame([("a", "record" + long), ("b", "short"), ("c", None), ("d", "garbled" + long), ("e", "mute" + long)], "p string, text string")
    got = {(r["p"], r["tumor_index"]): (r["diagnosis"], r["site"], r["histology"], r["how"]) for r in models.discovered(df.coalesce(1), "p", "text", clerk(), lambda d: f"see {d}").collect()}
    unknown = ("unknown", None, None, "unknown")
    assert got == {("a", 0): ("lung cancer", "C34", None, "coded"), ("a", 1): ("skin cancer", "C44", "8720", "coded"), ("b", 0): unknown, ("c", 0): unknown, ("d", 0): unknown, ("e", 0): unknown}
    plain = models.discovered(df.filter("p = 'a'"), "p", "text", clerk(), lambda d: "uncoded").collect()
    assert [(r["diagnosis"], r["how"]) for r in plain] == [("lung cancer", "plain"), ("skin cancer", "plain")]
    assert models.discovered(df.limit(0), "p", "text", clerk()).count() == 0


def test_one_call_a_request(spark):
    df = spark.createDataFrame([("a", 0, "o", "extract"), ("a", 1, "o", "mute")], "p string, tumor int, ontology string, prompt string")
    got = sorted(models.extracted(df.coalesce(1), ["p", "tumor", "ontology"], "prompt", clerk()).collect(), key=str)
    assert [(r["tumor"], r["field"], r["value"], r["confidence"]) for r in got if not r["error"]] == [(0, "grade", "3", None), (0, "stage", "II", 0.8)]
    assert [r["error"] for r in got if r["tumor"] == 1] == ["RuntimeError: busy"]


def test_questions_in_batches_and_running_summaries(spark):
    chunks = spark.createDataFrame([("p", 2, "q2=no q5=late"), ("p", 1, "q1=yes q2=maybe"), ("q", 1, "mute")], "p string, k int, text string")
    got = {(r["p"], r["question"]): (r["answer"], r["n_failed"]) for r in models.answered(chunks, "p", "k", "text", ["q1", "q2", "q5"], clerk(), batch=2).collect()}
    assert {k: v[0] for k, v in got.items()} == {("p", "q1"): "yes", ("p", "q2"): "no", ("p", "q5"): "late", ("q", "q1"): None, ("q", "q2"): None, ("q", "q5"): None}
    assert got["p", "q1"][1] == 0 and got["q", "q1"][1] == 2
    sums = {r["p"]: (r["summary"], r["n_failed"]) for r in models.summarised(chunks, "p", "k", "text", clerk()).collect()}
    assert sums["p"][0].endswith("lines") and sums["q"] == (None, 1)
