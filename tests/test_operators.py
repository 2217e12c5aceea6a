import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text, values
from tessella.operators import codes, cohort, deid, models, privacy, stats, timeline
from tessella.sources import extractions, tables
from tessella.streaming import feeds


def one(spark, column, **given_values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given_values.items()))
    return row.select(column.alias("out")).first()["out"]


def test_suppression_never_leaks(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.integers(-3, 40)), min_size=1, max_size=8), st.integers(1, 20))
    def holds(counts, least):
        df = spark.createDataFrame([(c, 0.5) for c in counts], "n_patients long, pct double")
        for r in privacy.suppressed(df, least).collect():
            assert r["n_patients"] is None or r["n_patients"] == f"<{least}" or int(r["n_patients"]) >= least
            assert (r["pct"] == "suppressed") == (r["n_patients"] == f"<{least}")

    holds()


def test_count_columns():
    assert privacy.count_columns(["N", "n_stage", "Total", "visits", "x_count", "mean"]) == ["N", "Total", "x_count"]
    assert privacy.count_columns(["Visits"], ["visits"]) == ["Visits"]


def test_text_functions(spark):
    t = "Call 555-123-4567 or a.b@c.org, SSN 123-45-6789, at 12 Main Street. MRN: AB1234. A 93 year-old, age 95."
    out = one(spark, text.cap_age_mentions(text.redact_mrns(text.redact_contacts(F.col("t")))), t=t)
    for gone in ("555-123", "a.b@c", "123-45", "Main Street", "AB1234", "93 year", "age 95"):
        assert gone not in out
    assert one(spark, text.needs_review(F.col("t")), t="seen by Mrs. Smith") is True
    assert one(spark, text.needs_review(F.col("t")), t="nothing here") is False
    assert one(spark, text.summary(F.col("t")), t="```\nSummary: fine\n```") == "fine"
    assert one(spark, text.accessions(F.col("t")), t="GSE1234 and GSE99999 and GSE1234") == ["GSE1234", "GSE99999"]
    events = one(spark, text.event_tags(F.col("t")), t="<dx>lung <rx> drug a")
    assert [(e["type"], e["text"]) for e in events] == [("dx", "lung"), ("rx", "drug a")]


def test_shift_keeps_intervals(spark):
    df = spark.createDataFrame([("a", "2020-03-04"), ("a", "2020-03-14"), ("b", "not a date")], "p string, d string")
    shift = values.stable_shift(30, F.lit("salt"), F.col("p"))
    got = df.select("p", "d", values.shifted_date(F.col("d"), shift).alias("m"), shift.alias("s")).collect()
    assert (__import__("datetime").date.fromisoformat(got[1]["m"]) - __import__("datetime").date.fromisoformat(got[0]["m"])).days == 10
    assert got[2]["m"] == "not a date" and abs(got[0]["s"]) <= 30
    with pytest.raises(ValueError):
        values.stable_shift(-1, F.lit("x"), F.lit("y"))


def test_hashes_are_pinned(spark):
    index = lambda modulo, *parts: int(__import__("hashlib").sha256("||".join(parts).encode()).hexdigest()[:16], 16) % modulo
    got = spark.range(1).select(values.stable_shift(30, F.lit("seed"), F.lit("P1")), values.stable_shift(365, F.lit(""), F.lit("mrn:7")), values.stable_index(26, F.lit("s"), F.lit("k"), F.lit("middle")), values.stable_shift(0, F.lit("s"), F.lit("k"))).first()
    assert tuple(got) == (index(61, "seed", "P1", "date_shift") - 30, index(731, "", "mrn:7", "date_shift") - 365, index(26, "s", "k", "middle"), 0) == (24, -110, 15, 0)


def test_deidentification(spark):
    df = spark.createDataFrame(
        [("p1", "M1", "Ann", "Lee", "F", "Ann Lee (MRN: M1) came on 2020-01-05, 95 years old", "2020-01-05", 95), ("p2", "M2", "Bob", "Ray", "M", None, "soon", 40), ("p1", "M1", "Ann", "Lee", "F", "x", "2020-02-05", 96)],
        "patient_id string, mrn string, first_name string, last_name string, sex string, evidence string, service_date string, age int",
    )
    classes = deid.classified(df)
    assert classes == {"patient_id": "patient_id", "mrn": "mrn", "first_name": "name", "last_name": "name", "sex": "keep", "evidence": "text", "service_date": "date", "age": "age"}
    keys = df.select(deid.identity_key(F.col("patient_id"), F.col("mrn")).alias("identity"), "sex")
    known = deid.identities(keys, "pepper", 30).cache()
    out = {(r["service_date"], r["age"]): r for r in deid.deidentified(df, classes, known).collect()}
    rows = list(out.values())
    assert len({r["patient_id"] for r in rows}) == 2 and {r["age"] for r in rows} == {"90+", "40"}
    first = next(r for r in rows if r["evidence"] and len(r["evidence"]) > 5)
    for gone in ("Ann", "Lee", "M1", "2020-01-05", "95"):
        assert gone not in first["evidence"]
    again = deid.identities(keys, "pepper", 30, known).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, known.collect()))
    with pytest.raises(PermissionError):
        deid.local_endpoint("https://api.example.org/v1")


def test_rewrites_only_flagged(spark):
    df = spark.createDataFrame([("secret", True), ("plain", False), (None, True)], "t string, review boolean")
    got = deid.rewritten(df, "t", "review", lambda t: t.upper()).collect()
    assert [r["t"] for r in got] == ["SECRET", "plain", None]


def test_model_calls(spark):
    notes = spark.createDataFrame([("a", "some note"), ("b", " "), ("c", "bad one"), ("d", None)], "p string, text string")
    got = {r["p"]: (r["summary"], r["error"]) for r in models.compressed(notes, "text", models.FakeClient(fail_on="bad")).collect()}
    assert got == {"a": ("Summary: 9 characters", None), "b": (None, "empty_text"), "c": (None, "RuntimeError: no answer"), "d": (None, "empty_text")}

    class Reader:
        def generate(self, prompt):
            known, _, chunk = prompt.partition("\n")
            return json.dumps({k: {"value": v, "confidence": float(c)} for k, v, c in (x.split(":") for x in chunk.split()) if f"'{k}'" not in known})

    chunks = spark.createDataFrame([("p", 1, "site:C50:0.95 stage:I:0.4"), ("p", 2, "site:C34:0.99 stage:II:0.6"), ("q", 1, "site:C61:0.2")], "p string, k int, text string")
    got = {(r["p"], r["field"]): (r["value"], r["pass"]) for r in models.folded(chunks, "p", "k", "text", Reader()).collect()}
    assert got == {("p", "site"): ("C50", 0), ("p", "stage"): ("II", 1), ("q", "site"): ("C61", 0)}


def test_json_layouts(spark):
    docs = [
        ("a.json", {"patient_id": "1", "categories": {"patient": {"sex": {"value": "F", "confidence": 0.9}}}}),
        ("b.json", {"patient_id": "2", "records": {"regimens": [{"drug": "x"}, {"drug": ["y", "z"]}]}}),
        ("c.json", {"patient_id": "3", "ontology_id": "o", "results": {"site": "C50", "odd": 1}}),
        ("d.json", {"diagnoses": [{"ca": "lung", "tumor_index": 4}]}),
        ("e.json", {"patient_id": "5", "cancer_diagnosis_records": [{"ca": "skin"}]}),
    ]
    df = spark.createDataFrame([(p, json.dumps(x)) for p, x in docs] + [("f.json", "{broken")], "path string, text string")
    got = {(r["patient_id"], r["category"], r["tumor_index"], r["instance"], r["field"], r["value"]) for r in extractions.consolidate(df, {"site": "cancer_diagnosis"}).collect()}
    assert got == {
        ("1", "patient", -1, 0, "sex", "F"), ("2", "regimen", 0, 0, "drug", "x"), ("2", "regimen", 1, 1, "drug", "y; z"), ("3", "cancer_diagnosis", -1, 0, "site", "C50"),
        ("3", "other", -1, 0, "odd", "1"), ("d", "cancer_diagnosis", 4, 0, "ca", "lung"), ("5", "cancer_diagnosis", 0, 0, "ca", "skin"),
    }
    assert extractions.json_object('```json\n[{"a": 1}]\n```') == {"a": 1} and extractions.json_object("no") is None
    assert extractions.json_array('x {"k": [1, 2]} y') == [1, 2]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b"), (2, None)], "id int, t string")
    for suffix in ("csv", "tsv", "parquet"):
        tables.write_table(df, f"{tmp_path}/x.{suffix}")
        assert tables.read_table(spark, f"{tmp_path}/x.{suffix}").count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/x.docx")
    (tmp_path / "rounds.jsonl").write_text('{"patient_id":"a","round":1,"extraction":"old","num_chunks":2}\n\nbroken\n{"patient_id":"a","round":1,"extraction":"new","num_chunks":2}\n')
    assert [r["extraction"] for r in tables.read_rounds(spark, str(tmp_path / "rounds.jsonl")).collect()] == ["new"]
    (tmp_path / "q.txt").write_text("# note\nWhat stage? (I; II; III)\n\nAny drug?\n")
    got = {r["question"]: r["options"] for r in tables.read_questions(spark, str(tmp_path / "q.txt")).collect()}
    assert got == {"What stage?": ["I", "II", "III"], "Any drug?": []}
    tables.save_database({"one": df, "two": df}, str(tmp_path / "db"), {"one"})
    assert ("one", "t", "string") in tables.catalog(spark) and not (tmp_path / "db" / "two").exists()
    items = spark.createDataFrame([("p", 0, "primarySite", "C50"), ("p", 1, "sex", "2"), ("q", 0, "sex", "1")], "patient_id string, tumor int, naaccr_id string, value string")
    tables.write_registry_xml(items, str(tmp_path / "x.xml"))
    xml = "".join(f.read_text() for f in (tmp_path / "x.xml").glob("part*"))
    assert 'naaccrId="primarySite"' in xml and "<NaaccrData>" in xml and xml.count("<Tumor>") == 3


def test_first_and_fill_joins(spark):
    base = spark.createDataFrame([(1, None), (2, "f"), (3, None)], "k int, sex string")
    a = spark.createDataFrame([(1, "m", "x"), (2, "m", "y")], "k int, sex string, race string")
    b = spark.createDataFrame([(1, "q", "z"), (3, "f", "w")], "k int, sex string, race string")
    got = {tuple(r) for r in cohort.fill_join(base, [a, b], "k").select("k", "sex", "race").collect()}
    assert got == {(1, "m", "x"), (2, "f", "y"), (3, "f", "w")}


def test_surrogate_ids_are_dense(spark):
    ids = cohort.surrogate_ids(spark.range(137).withColumnRenamed("id", "k"), "k").orderBy("cohort_id").collect()
    assert [r["cohort_id"] for r in ids] == [f"patient_{i:06d}" for i in range(1, 138)]
    assert [r["k"] for r in ids] == sorted(range(137), key=str)


def test_kaplan_meier_bounds(spark):
    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), min_size=1, max_size=30))
    def holds(rows):
        got = stats.kaplan_meier(spark.createDataFrame(rows, "t int, e boolean"), "t", "e").orderBy("time").collect()
        s = [1.0] + [r["survival"] for r in got]
        assert all(0 <= b <= a + 1e-12 for a, b in zip(s, s[1:]))
        alive = 1.0
        for r in got:
            n = sum(t >= r["time"] for t, _ in rows)
            assert r["at_risk"] == n
            alive *= 1 - r["events"] / n
            assert abs(alive - r["survival"]) < 1e-9

    holds()


def test_codes(spark):
    table = spark.createDataFrame([("C50", "breast cancer"), ("C34", "lung cancer")], "code string, description string")
    asked = spark.createDataFrame([("C50",), ("c34",), ("LUNG cancer",), ("",), (None,), ("zzz",)], "v string")
    got = {r["v"]: (r["resolved_code"], r["resolution_confidence"]) for r in codes.resolved(asked, table, "v").collect()}
    assert got == {"C50": ("C50", 1.0), "c34": ("C34", 0.95), "LUNG cancer": ("C34", 0.9), "": (None, 0.0), None: (None, 0.0), "zzz": (None, 0.0)}
    top = codes.fuzzy_top(spark.createDataFrame([("cancer of breast",)], "v string"), table, "v", cutoff=50).collect()
    assert top[0]["code"] == "C50"
    assert one(spark, codes.site_valid(F.col("s")), s="C34.9") and not one(spark, codes.site_valid(F.col("s")), s="C3")
    assert one(spark, codes.laterality_edit(F.col("s"), F.col("l")), s="C50", l="0") is not None
    assert one(spark, codes.treatment_edit(F.col("a"), F.col("b")), a="20200105", b="01/04/2020") is True


def test_chunks_cover_the_text(spark):
    for n in (0, 5, 10, 11, 25):
        t = "abcdefghij" * 3
        got = one(spark, timeline.chunked(F.col("t"), 10, 3), t=t[:n])
        joined = "".join(p if i == 0 else p[3:] for i, p in enumerate(got))
        assert joined == t[:n] and all(len(p) <= 10 for p in got)


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(k, i, f"2024-01-0{1 + i % 5} 00:00:00", float(i)) for i, k in enumerate("abacabcc")]
    df = spark.createDataFrame(rows, "k string, i long, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    last = run(feeds.latest(stream(), ["k"], "at", "i"), "last_rows", "update").collect()
    want = {r["k"]: r["i"] for r in timeline.last_per_key(df, ["k"], F.desc("at"), F.desc("i")).collect()}
    assert {r["k"]: r["i"] for r in last} == want
    totals = run(feeds.running_state(stream(), "k", "i", "v"), "totals", "update").collect()
    assert {r["k"]: (r["n_events"], r["total"]) for r in totals} == {"a": (3, 6.0), "b": (2, 6.0), "c": (3, 16.0)}
    counts = run(feeds.windowed_counts(stream(), "at", "k", "1 day", "1 hour"), "counts", "complete").collect()
    assert sum(r["n_events"] for r in counts) == 8
