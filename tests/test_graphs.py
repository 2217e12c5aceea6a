import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import graphs


def test_neighbours_are_those_of_brute_force(spark):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((30, 16)) * 3
    x = np.vstack([centres[i % 30] + draw.standard_normal(16) for i in range(1500)] + [np.ones(16)] * 300)
    rows = [(i, [float(v) for v in row], None) for i, row in enumerate(x)]
    odd = [(None, [1.0] * 16, "a"), (9001, None, "b"), (9002, [], "c"), (9003, [float("nan")] * 16, "d"), (9004, [None] * 16, "e"), (9005, [1.0, 2.0], "f"), (9006, [1.0, 2.5], "g"), (9007, [3.0], "h")]
    points = spark.createDataFrame(rows + odd, "id long, v array<double>, src string")
    got = graphs.neighbours(points, "id", "v", 8, passes=8, block=128).toPandas()
    of = {k: part.sort_values(["distance", "dst"]) for k, part in got.groupby("src")}
    assert set(of) == {*range(1800), 9005, 9006}  # of their own lengths alone
    assert all(len(of[i]) == 8 for i in range(1800)) and of[9005]["distance"].tolist() == [0.5]
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    nearest = np.sort(apart, axis=1)[:, :8]
    mine = np.array([of[i]["distance"].to_numpy() for i in range(1800)])
    assert all(np.allclose(apart[i, of[i]["dst"]], of[i]["distance"]) for i in range(0, 1800, 7))
    assert (mine <= nearest + 1e-9).mean() > 0.9  # recall; copies may be any of theirs
    assert (mine[1500:] == 0).all()
    # A table that fits one block is compared whole.
    small = graphs.neighbours(points.filter("id < 100"), "id", "v", 5, passes=1).toPandas()
    want = {(i, j) for i in range(100) for j in np.argsort(apart[i, :100], kind="stable")[:5]}
    assert set(zip(small["src"], small["dst"])) == want
    assert graphs.neighbours(points.filter("id < 0"), "id", "v").count() == 0
    with pytest.raises(ValueError):
        graphs.neighbours(points, "id", "v", 0)


def modularity(edges, community, resolution=1.0):
    double = 2 * sum(w for *_, w in edges)
    degree, inside = {}, {}
    for u, v, w in edges:
        for x in (u, v):
            degree[community[x]] = degree.get(community[x], 0) + w
        if community[u] == community[v]:
            inside[community[u]] = inside.get(community[u], 0) + 2 * w
    return {c: inside.get(c, 0) / double - resolution * (k / double) ** 2 for c, k in degree.items()}


def test_planted_groups_are_found(spark):
    draw = np.random.default_rng(7)
    group = {i: i % 4 for i in range(80)}
    edges = [(int(a), int(b), 1.0) for a in range(80) for b in range(a) if draw.random() < (0.5 if group[a] == group[b] else 0.02)] + [(3, 3, 2.0)]
    bad = [(None, 1, 1.0), (1, 2, None), (5, 6, -1.0), (5, 6, float("nan")), (5, 6, 0.0)]
    adjacent = graphs.adjacency(spark.createDataFrame(edges + bad, "a long, b long, w double"), "a", "b", "w")
    found = graphs.communities(adjacent)
    got = {r["node"]: r["community"] for r in found.collect()}
    assert got == {i: i % 4 for i in range(80)}  # by the least node
    parts = {r["community"]: r["modularity"] for r in graphs.division(adjacent, found, "node", "community", 0.7).collect()}
    want = modularity(edges, got, 0.7)
    assert parts.keys() == want.keys() and all(abs(parts[c] - want[c]) < 1e-12 for c in want)


def test_small_graphs(spark):
    make = lambda rows: graphs.adjacency(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    assert graphs.communities(make([])).count() == 0
    assert [tuple(r) for r in graphs.communities(make([("x", "x")])).collect()] == [("x", "x")]
    two = {r["node"]: r["community"] for r in graphs.communities(make([("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "r"), ("r", "p"), ("c", "p")])).collect()}
    assert two == dict.fromkeys("abc", "a") | dict.fromkeys("pqr", "p")
    # A high resolution leaves every node alone.
    alone = graphs.communities(make([("a", "b"), ("b", "c")]), resolution=50.0)
    assert alone.filter(F.col("node") != F.col("community")).count() == 0
