import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import detect, models_fit, notes


def test_boundaries(spark):
    t = "--- a\n" + "x" * 50 + "\n--- b\n" + "y" * 60 + "\n--- c\n" + "z" * 10
    got = [r["piece"] for r in notes.chunked_notes(spark.createDataFrame([(t,), (None,), ("",)], "t string"), "t", 80, 0).orderBy("chunk").collect()]
    assert "".join(got) == t and all(len(p) <= 80 for p in got) and got[1].startswith("\n--- b")
    assert notes.pieces_at_boundaries("abc", 0) == ["abc"]
    assert len(notes.pieces_at_boundaries("a" * 100, 10, 9)) == 91
    by_token = notes.chunked_notes(spark.createDataFrame([(t,)], "t string"), "t", 20, 0, by_tokens=True)
    assert by_token.count() == len(got)


def test_drugs_change_alike_each_time(spark):
    docs = spark.createDataFrame([(i, "Took Aspirin and ASPIRIN plus aspirinol.") for i in range(200)], "id long, t string")
    a = notes.perturbed_drugs(docs, "id", "t", {"aspirin": ["asa", "acetylsalicylic acid"]}, 0.3, 5).orderBy("id").collect()
    assert a == notes.perturbed_drugs(docs.repartition(7), "id", "t", {"aspirin": ["asa", "acetylsalicylic acid"]}, 0.3, 5).orderBy("id").collect()
    changed = [r["t"] for r in a if "spirin and" not in r["t"]]
    assert 35 <= len(changed) <= 85 and all("aspirinol" in t and "ASPIRIN" not in t for t in changed)


def test_answers(spark):
    c = spark.createDataFrame([("<think>a</think> x\n```json\n{1}\n```\nso\n```\n{2}\n```",), ("plain",)], "t string")
    assert [r[0] for r in c.select(notes.without_reasoning(F.col("t"))).collect()] == ["{2}", "plain"]
    states = spark.createDataFrame([("p", {"a": ["x", "y"], "b": ["z"]})], "patient_id string, state map<string, array<string>>")
    assert {tuple(r) for r in notes.state_rows(states).collect()} == {("p", "a", "x; y"), ("p", "b", "z")}
    docs = spark.createDataFrame([("p", {"labs": [json.dumps({"test": "hb", "value": 9, "more": 1})]}), ("q", {})], "patient_id string, tables map<string, array<string>>")
    assert [tuple(r)[:3] for r in notes.assembled(docs, "tables", "labs", ["patient_id", "test", "value"]).collect()] == [("p", "hb", "9")]
    found = notes.snippets(spark.createDataFrame([(1, "a" * 100 + " stage IV " + "b" * 100), (2, "none")], "k int, t string"), "k", "t", "stage I[IV]*", 5).collect()
    assert [(r["k"], r["snippet"]) for r in found] == [(1, "aaaa stage IV bbbb")]


def test_detection(spark, tmp_path):
    a = spark.createDataFrame([(f"p{i}", i % 2) for i in range(20)], "patient_id string, flag int")
    b = spark.createDataFrame([(f"p{i % 5}", float(i)) for i in range(20)], "patient_id string, x double")
    assert detect.id_candidates({"a": a, "b": b})[0][0] == "patient_id"
    assert detect.shown_columns(["residual", "patient_id", "visit_date", "stage", "DataSource", "data_source"]) == ["residual", "stage", "DataSource"]
    assert detect.id_column("/x/a.csv", {"a": "pid"}, "id") == "pid" and detect.id_column("/x/b.csv", {"a": "pid"}, "id") == "id"
    assert detect.profile(a)["rows"] == 20 and len(detect.profile(a)["first"]) == 3
    assert detect.category_of_stem("run1_cancer_diagnosis", ["diagnosis", "cancer_diagnosis"]) == "cancer_diagnosis" and detect.category_of_stem("x", ["y"]) == "x"
    assert detect.problems({"input_paths": ["/no/such"], "colour": 1}) == ["unknown setting colour", "missing path /no/such"]
    detect.save_config({"min_cell": 5, "api_key": "s"}, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text()) == {"min_cell": 5}
    assert detect.staging_items(["a", "b"], {"lung": ["b", "c"]}, "l", {"l": "lung"}) == ["a", "b", "c"]
    assert detect.tumor_context(["x"], 0) == "" and "2 of 2" in detect.tumor_context(["x", "y"], 1)
    assert detect.state_block([("f", "v", 0.5), ("g", "w", 0.0)]) == "- f: v (0.50)"
    assert detect.code_block({"v": [], "w": [("C50", "breast")]}) == "### w\n- `C50` breast"
    assert "C1 = one" in detect.field_block({"id": "400", "name": "Site", "description": "d"}, [("C1", "one")])
    (tmp_path / "onto" / "one").mkdir(parents=True)
    (tmp_path / "onto" / "one" / "ontology.yaml").write_text("id: first\nitems: [a]\n")
    pytest.importorskip("yaml")
    assert detect.read_ontologies(str(tmp_path / "onto"))["first"]["items"] == ["a"]


def test_fisher():
    assert abs(models_fit.fisher_p(3, 1, 1, 3) - 0.4857142857) < 1e-9
    assert abs(models_fit.fisher_p(10, 0, 0, 10) - 2 / math.comb(20, 10)) < 1e-12


def test_logistic_and_cox(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -0.7])))
    t = np.ceil(rng.exponential(np.exp(-(x @ [0.8, -0.4]))) * 10)
    e = rng.random(400) < 0.7
    df = spark.createDataFrame([(float(a), float(b), bool(c), float(d), bool(f)) for (a, b), c, d, f in zip(x, y, t, e)], "a double, b double, y boolean, t double, e boolean")
    fit = models_fit.logistic(df, "y", ["a", "b"])
    w = np.zeros(3)
    z = np.hstack([np.ones((400, 1)), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    assert np.allclose([fit["intercept"], fit["a"], fit["b"]], w, atol=1e-4)
    beta = np.zeros(2)
    for _ in range(30):
        slope, curve = np.zeros(2), np.zeros((2, 2))
        r = np.exp(x @ beta)
        for i in np.flatnonzero(e):
            at = t >= t[i]
            m = (r[at, None] * x[at]).sum(0) / r[at].sum()
            slope += x[i] - m
            curve += (r[at, None] * x[at]).T @ x[at] / r[at].sum() - np.outer(m, m)
        beta += np.linalg.solve(curve, slope)
    got = models_fit.cox(df, "t", "e", ["a", "b"])
    assert np.allclose([got["a"][0], got["b"][0]], beta, atol=1e-6)
    assert np.allclose([got["a"][1], got["b"][1]], np.sqrt(np.diag(np.linalg.inv(curve))), atol=1e-6)


def test_ranked_genes(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0), ("i", None), (None, 4.0)], "n string, s double")
    assert [tuple(r) for r in models_fit.ranked_genes(df, "n", "s").collect()] == [("g", 3.0), ("h", 2.0)]


def test_retrieval_and_topography(spark):
    from tessella.operators import codes

    table = spark.createDataFrame([("C50.9", "breast"), ("C34.9", "lung"), ("C34.1", "upper lobe lung"), ("C61.9", "prostate gland")], "code string, description string")
    words = spark.createDataFrame([("p", "breast"), ("p", "lung"), ("q", "nothing")], "k string, w string")
    got = {(r["k"], r["code"]) for r in codes.retrieved(words, table, "k", "w").collect()}
    assert ("p", "C50.9") in got and ("p", "C34.9") in got and not any(k == "q" for k, _ in got)
    asked = spark.createDataFrame([("a", "left breast"), ("b", "prostate gland adeno"), ("c", "unknown thing")], "k string, normal string")
    groups = spark.createDataFrame([("breast", "C50.9"), ("mamma", "C50.9")], "keyword string, code string")
    got = {(r["k"], r["code"], r["how"]) for r in codes.topography(asked, groups, table, "k", "normal", [("C80.9", "unknown")]).collect()}
    assert got == {("a", "C50.9", "keyword"), ("b", "C61.9", "fuzzy"), ("c", "C80.9", "generic")}
    trail = codes.audit_trail(spark.createDataFrame([("p", "f", "v", "x" * 900)], "patient_id string, field string, value string, evidence string")).first()
    assert len(trail["evidence"]) == 500


def test_metadata(spark, tmp_path):
    from tessella.operators import metadata
    from tessella.sources import tables

    df = spark.createDataFrame([(i, "a" if i < 25 else "b", float(i)) for i in range(30)], "record_id int, grp string, x double")
    m = metadata.table_metadata(df)
    assert m["n_rows"] == 30 and m["categorical"] == {"grp": [["a", "25"], ["b", "<10"]]} and m["numeric"]["x"]["median"] == 14.5
    assert metadata.table_metadata(df.limit(5))["numeric"]["x"] == {"n_values": "<10", "mean": None, "q1": None, "median": None, "q3": None}
    metadata.write_metadata({"t": df}, str(tmp_path))
    assert "## t" in "".join(p.read_text() for p in (tmp_path / "schema.md").glob("part*"))
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 2 2\n1 1 5\n3 2 0.5\n")
    assert {tuple(r) for r in tables.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect()} == {(0, 0, 5.0), (2, 1, 0.5)}


def test_quantiles_are_exact(spark):
    from tessella.operators import stats

    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=401)] + [("b", float(v)) for v in rng.integers(0, 4, 90)] + [("c", 7.0), ("d", None)] + [("hot", 1.5)] * 300 + [("hot", 2.5)] * 3
    got = stats.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), "k", "v", [0.0, 0.1, 0.25, 0.5, 0.999, 1.0])
    for k in ("a", "b", "c", "hot"):
        assert np.allclose(got[k], np.quantile([v for g, v in rows if g == k], [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]), atol=1e-12)
    assert "d" not in got
    assert stats.quantiles(spark.createDataFrame([], "k string, v double"), "k", "v", [0.5]) == {}
