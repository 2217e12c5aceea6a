"""Neighbour graphs of vectors, communities in weighted graphs, and how well a division fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import written

BLOCK = 512
#: Rounds without a better division that end a level, and what counts as better.
PATIENCE, BETTER = 2, 1e-5


def _directions(seed: int, turn: int, dims: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, turn, dims]).standard_normal((dims, bits + 1))


def _near(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of each row of one block; equal distances by id."""
    rows = rows.sort_values("src", kind="stable")
    ids, x = rows["src"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float)
    squares = (x * x).sum(1)
    apart = squares[:, None] + squares - 2 * (x @ x.T)
    np.fill_diagonal(apart, np.inf)
    k = min(k, len(x) - 1)
    found = np.argsort(apart, axis=1, kind="stable")[:, :k]
    a = np.repeat(np.arange(len(x)), k)
    b = found.ravel()
    distance = np.sqrt(((x[a] - x[b]) ** 2).sum(1))  # the same in every block
    return pd.DataFrame({"src": ids[a], "dst": ids[b], "distance": distance})


def neighbours(points: DataFrame, key: str, vector: str, k: int = 15, passes: int = 8, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(src, dst, distance): for each vector the ``k`` nearest that some pass has brought into one block with it.

    A pass orders all vectors by the sides of random planes through the mean that they lie on, then by a random projection, and
    compares blocks of that order; more planes are taken as the table grows, so a pass costs ``block`` distances a vector at
    every size. No group is gathered: copies of one vector, however many, are cut into blocks like all else. The
    neighbours are approximate; ``passes`` and ``block`` are the parameters to be chosen by the recall on a set of queries.
    Ids are unique. Rows without an id, and vectors that are null, empty or hold null or non-finite numbers, have no neighbours; only
    vectors of one length are compared.
    """
    if k < 1 or passes < 1 or block < 2:
        raise ValueError("k and passes are at least 1, a block holds at least 2")
    number = F.col("v").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = points.select(F.col(key).alias("src"), F.col(vector).alias("v")).withColumn("v", number)
    own = written(own.filter(F.col("src").isNotNull() & (F.size("v") > 0) & sound), "points")
    n = own.count()
    bits = min(24, max(0, math.ceil(math.log2(max(1, n / block)))))
    means: dict[int, np.ndarray] = {}
    lengths = own.groupBy(F.size("v").alias("dims"), F.lit(0).alias("one")).agg(F.count("*").alias("n")).collect()
    if len(lengths) > 100:
        raise ValueError("the vectors have more than 100 lengths")
    for row in lengths:
        dims = row["dims"]
        placed = own.filter(F.size("v") == dims).select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"))
        means[dims] = np.array([r["m"] for r in placed.orderBy("at").collect()])

    def order(turn: int):
        @F.pandas_udf("struct<cell: long, along: double>")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            planes = {dims: _directions(seed, turn, dims, bits) for dims in means}
            for vectors in batches:
                out = np.zeros((len(vectors), 2))
                sizes = vectors.map(len).to_numpy()
                for dims in set(sizes.tolist()):
                    at = np.flatnonzero(sizes == dims)
                    sides = (np.stack(vectors.iloc[at].to_numpy()) - means[dims]) @ planes[dims]
                    out[at, 0] = (sides[:, :bits] > 0) @ (2.0 ** np.arange(bits))
                    out[at, 1] = sides[:, bits]
                yield pd.DataFrame({"cell": out[:, 0].astype(np.int64), "along": out[:, 1]})

        return of

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, dims = pd.DataFrame(), 0
        for batch in batches:
            for size, part in batch.groupby("dims", sort=True):
                if size != dims:
                    if len(held) > 1:
                        yield _near(held, k)
                    held, dims = part, size
                else:
                    held = pd.concat([held, part])
                while len(held) >= 2 * block:  # the last block takes what is left over
                    yield _near(held.iloc[:block], k)
                    held = held.iloc[block:]
        if len(held) > 1:
            yield _near(held, k)

    schema = f"src {own.schema['src'].dataType.simpleString()}, dst {own.schema['src'].dataType.simpleString()}, distance double"
    found = None
    for turn in range(passes):
        placed = own.withColumn("at", order(turn)("v")).select("src", "v", F.size("v").alias("dims"), "at.cell", "at.along")
        sorted_ = placed.repartitionByRange("dims", "cell", "along", "src").sortWithinPartitions("dims", "cell", "along", "src")
        met = sorted_.select("src", "v", "dims").mapInPandas(compared, schema)
        found = met if found is None else found.unionByName(met)
    # At most passes * k rows a vector come together.
    nearest = found.groupBy("src").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "dst"))), 1, k).alias("near"))
    return nearest.select("src", F.explode("near").alias("near")).select("src", "near.dst", "near.distance")


def adjacency(edges: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """(u, v, a): an undirected graph in both directions, equal edges added up, a loop counted twice.

    Edges with a null end, and weights that are null, NaN or not above 0, are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"), w.alias("a")).filter("u IS NOT NULL AND v IS NOT NULL AND a > 0 AND NOT isnan(a)")
    return own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v"), "a")).groupBy("u", "v").agg(F.sum("a").alias("a"))


def division(adjacent: DataFrame, members: DataFrame, node: str, community: str, resolution: float = 1.0) -> DataFrame:
    """(community, inside, share, modularity): the share of all weight inside each community, that of its nodes, and what it adds to the modularity."""
    of = members.select(F.col(node).alias("u"), F.col(community).alias("c"))
    pairs = adjacent.join(of, "u").join(of.select(F.col("u").alias("v"), F.col("c").alias("d")), "v")
    sums = pairs.groupBy("c").agg(F.sum(F.when(F.col("c") == F.col("d"), F.col("a")).otherwise(0.0)).alias("inside"), F.sum("a").alias("share"))
    total = pairs.agg(F.sum("a").alias("_all"))
    shares = sums.crossJoin(F.broadcast(total)).select(F.col("c").alias(community), (F.col("inside") / F.col("_all")).alias("inside"), (F.col("share") / F.col("_all")).alias("share"))
    return shares.withColumn("modularity", F.col("inside") - resolution * F.col("share") * F.col("share"))


def _moved(adjacent: DataFrame, resolution: float, rounds: int, seed: int) -> tuple[DataFrame, float]:
    """((u, k, c), modularity) after rounds in which a half of the nodes, drawn by hash, may each move to the community that gains most."""
    nodes = written(adjacent.groupBy("u").agg(F.sum("a").alias("k")), "nodes")
    double, loops = nodes.agg(F.sum("k")).first()[0], adjacent.filter("u = v").agg(F.sum("a")).first()[0] or 0.0
    state = nodes.withColumn("c", F.col("u"))
    kept, best, failed = state, -math.inf, 0
    for turn in range(rounds + 1):
        reached = adjacent.filter("u != v").join(state.select(F.col("u").alias("v"), "c"), "v").select("u", "c", "a")
        links = reached.unionByName(state.select("u", "c", F.lit(0.0).alias("a"))).groupBy("u", "c").agg(F.sum("a").alias("link"))
        totals = state.groupBy("c").agg(F.sum("k").alias("total"))
        seen = written(links.join(totals, "c").join(state.select("u", "k", F.col("c").alias("own")), "u"), "round")
        inside, squares = seen.filter("c = own").agg(F.sum("link"), F.sum(F.col("k") * F.col("total"))).first()
        fit = (inside + loops) / double - resolution * squares / double / double
        failed = 0 if fit > best + BETTER else failed + 1
        if not failed:
            best, kept = fit, state
        if failed == PATIENCE or turn == rounds:
            break
        others = F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("link") - resolution * F.col("k") * others / double, 9)
        choice = seen.groupBy("u", "k", "own").agg(F.max_by("c", F.struct(gain, F.col("c") == F.col("own"), F.col("c"))).alias("c"))
        turns = F.pmod(F.xxhash64("u", F.lit(seed), F.lit(turn)), F.lit(2)) == 0
        state = choice.select("u", "k", F.when(turns, F.col("c")).otherwise(F.col("own")).alias("c"))
    return kept, best


def communities(adjacent: DataFrame, resolution: float = 1.0, rounds: int = 10, levels: int = 5, seed: int = 1) -> DataFrame:
    """(node, community) of every node of ``adjacency``'s result: a division of high modularity, each community by its least node.

    Nodes move in rounds; what a level has found becomes the nodes of the next. A round that doesn't better the modularity is not
    taken over, so the division never gets worse. Rounds and levels are tables in the shared folder: nothing but a few sums
    reaches the driver. An empty graph has no rows.
    """
    adjacent = written(adjacent, "adjacent")
    members = adjacent.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct()
    if adjacent.isEmpty():
        return members
    best = -math.inf
    for level in range(levels):
        state, fit = _moved(adjacent, resolution, rounds, seed + level)
        if fit <= best + BETTER:
            break
        best = fit
        members = written(members.join(state.select(F.col("u").alias("community"), "c"), "community").select("node", F.col("c").alias("community")), "members")
        of = state.select("u", "c")
        joined = adjacent.join(of, "u").join(of.select(F.col("u").alias("v"), F.col("c").alias("d")), "v")
        adjacent = written(joined.groupBy(F.col("c").alias("u"), F.col("d").alias("v")).agg(F.sum("a").alias("a")), "contracted")
    named = members.groupBy("community").agg(F.min("node").alias("_least"))
    return members.join(named, "community").select("node", F.col("_least").alias("community"))
