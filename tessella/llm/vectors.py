"""Embedding near-dedup by sorted projection passes.

Exact copies are one class first. In each pass every class gets the signs of ``HASHES`` random projections, read
as one number; classes of one length are ordered by it and by id, and each is compared with a window of those after it.
The order is made by range partitions, counted, and cut into blocks of ``ROWS`` ranks or two windows, each with the first
ranks of the next, so blocks are even and no window ends at a border. ``plan`` is told how many classes of the whole table
stand between two vectors of cosine ``THRESHOLD``, and takes the window and as many passes as leave an expected ``MISS`` of
such pairs in the densest tenth. A few passes are made at a time, each group a table of links, so the shuffled vectors of
all passes never lie on disk together. Pairs with a cosine of at least ``THRESHOLD`` in double precision are united, first
within a block and then over all passes.

What passes miss is found exactly: ``missed_links`` compares all classes that aren't yet in one component, so no link
depends on hashes, windows or the plan, which only settle how much is left for it. Its work is quadratic in the classes.
Inside a component, all classes are then compared, ``BLOCK`` x ``BLOCK`` at a time, so the window caps no count of links;
only counts leave those blocks, never pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; components may
be as large or small as doubles are; vectors of different length don't link; rows that share a vec_id count as one
vector, with the smallest of their arrays; rows with a null vec_id become one row without links, component or place
among the kept; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tessella.llm.components import components
from tessella.llm.shared import staged, with_groups

THRESHOLD = 0.9
#: Share of pairs at the threshold that passes may be expected to leave to ``missed_links``.
MISS = 0.01
#: Passes whose shuffled vectors lie on disk together.
PASSES_AT_ONCE = 4
HASHES = 32
WINDOWS = (64, 256, 1024, 4096)
#: A window holds at most so many numbers.
WINDOW_NUMBERS = 1 << 20
ROWS = 2048
BLOCK = 1024
#: Classes around which the whole table is counted, numbers in all of them and orders tried when passes are planned.
PROBES, PROBE_NUMBERS, TRIALS = 400, 1 << 22, 64
#: Classes and bytes in a part of those that are compared whole, and parts that classes alone ask for; tasks are pairs of parts.
PART_ROWS, PART_BYTES, PARTS = 8192, 1 << 26, 256
#: Microseconds to deal a row once and to compare it with one other.
DEAL, COMPARE = 30.0, 0.005
SEED = 5


def _unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; squares neither overflow nor vanish."""
    m = np.array(vectors.tolist() if isinstance(vectors, pd.Series) else vectors, dtype=np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def window_pairs(unit: np.ndarray, own: int, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of rows with i < own and i < j <= i + window."""
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    for at in range(0, own, 512):
        stop = min(at + 512, own)
        i, j = np.nonzero(unit[at:stop] @ unit[at : stop + window].T >= least)
        near = (j > i) & (j - i <= window)
        found.append((i[near] + at, j[near] + at))
    i, j = (np.concatenate(x) for x in zip(*found))
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs (i, j) lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _keys(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each row and each HASHES planes the signs of its projections as one number."""
    power = 1 << np.arange(HASHES, dtype=np.int64)[::-1]
    return (unit @ planes > 0).reshape(len(unit), -1, HASHES) @ power


def partners(probe: np.ndarray, least: float) -> np.ndarray:
    """For each row of ``probe`` a vector of cosine ``least``."""
    aside = np.random.default_rng([SEED, probe.shape[1], 1]).normal(size=probe.shape)
    aside -= (aside * probe).sum(axis=1, keepdims=True) * probe
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    return least * probe + np.sqrt(1 - least * least) * aside


def between(unit: np.ndarray, probe: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """For each probe and trial the rows of ``unit`` that stand from the probe to its partner."""
    apart = np.empty((len(probe), TRIALS), dtype=np.int64)
    for t in range(TRIALS):
        planes = np.random.default_rng([SEED, unit.shape[1], 2, t]).normal(size=(unit.shape[1], HASHES))
        order = np.sort(_keys(unit, planes)[:, 0])
        mine, other = _keys(probe, planes)[:, 0], _keys(partner, planes)[:, 0]
        # The partner stands outside the keys from its own side; equal keys are ordered by id, so all of them may lie between.
        apart[:, t] = np.searchsorted(order, np.maximum(mine, other), "right") - np.searchsorted(order, np.minimum(mine, other), "left")
    return apart


def chances(apart: np.ndarray, windows: list[int]) -> np.ndarray:
    """For each window the chance that one pass finds a pair in the densest tenth of the probes, with ``apart`` rows
    between them by trial. Half of the trials tell what is dense, the others count."""
    dense = np.argsort(-np.log(apart[:, ::2] + 1).mean(axis=1), kind="stable")[: max(1, len(apart) // 10)]
    tried = apart[dense, 1::2]
    # One more trial that found nothing: a chance is never taken for more than was seen.
    return np.array([(tried <= w).sum() / (tried.size + 1) for w in windows])


def plan(apart: np.ndarray, n: int, widest: int) -> tuple[int, int]:
    """(passes, window) for n rows, ``apart`` of them between probes and partners, beside vectors of up to ``widest`` numbers."""
    fitting = [w for w in WINDOWS if w * widest <= WINDOW_NUMBERS] or [WINDOWS[0]]
    # No window needs to be more than one step beyond the number of rows.
    windows = fitting[: 1 + sum(w < n for w in fitting)]
    if windows[-1] >= n and n <= WINDOWS[0]:
        return 1, windows[-1]
    found = []
    for window, chance in zip(windows, chances(apart, windows)):
        if chance > 0 or window == windows[-1]:
            # Pairs differ in their chances, and their mean flatters: a quarter of MISS is planned for.
            passes = max(1, int(np.ceil(np.log(MISS / 4) / np.log1p(-max(chance, 1 / (PROBES * TRIALS))))))
            found.append((passes * (1.5 * DEAL + COMPARE * min(window, n / 2)), passes, window))
    return min(found)[1:]


def planned(unit: np.ndarray, n: int, least: float = THRESHOLD) -> tuple[int, int]:
    """(passes, window) for n rows, all of them in ``unit``."""
    probe = unit[np.random.default_rng([SEED, n, 1]).choice(len(unit), min(PROBES, len(unit)), replace=False)]
    return plan(between(unit, probe, partners(probe, least)), n, unit.shape[1])


def plans(classes: DataFrame, least: float = THRESHOLD) -> list[tuple[int, int]]:
    """The ``plan`` of each length of vectors that has probes; what stands between them is counted over all ``classes``."""
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    widest = max(sizes, default=1)
    some = max(1, min(PROBES, PROBE_NUMBERS // widest))
    by_dim: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(some).select("vector").collect():
        by_dim.setdefault(len(r["vector"]), []).append(r["vector"])
    probes = {dim: _unit(pd.Series(v, dtype=object)) for dim, v in by_dim.items() if sizes[dim] > WINDOWS[0]}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if dim in probes:
                    sums[dim] = sums.get(dim, 0) + between(_unit(part["vector"]), probes[dim], partners(probes[dim], least))
        for dim, apart in sums.items():
            yield pd.DataFrame({"dim": dim, "at": np.arange(apart.size), "n": apart.ravel()})

    apart = {dim: np.zeros(len(probe) * TRIALS, dtype=np.int64) for dim, probe in probes.items()}
    if probes:  # PROBES x TRIALS numbers in all
        for dim, part in classes.select("vector", "dim").mapInPandas(counted, "dim int, at int, n long").groupBy("dim", "at").agg(F.sum("n").alias("n")).toPandas().groupby("dim"):
            apart[dim][part["at"]] = part["n"]
    small = [(1, WINDOWS[0])] if len(probes) < len(by_dim) else []
    return small + [plan(counts.reshape(-1, TRIALS), sizes[dim], widest) for dim, counts in sorted(apart.items())]


def found_links(classes: DataFrame) -> DataFrame:
    """Spanning links (a, b) between ids of ``classes`` (id, vector, dim), found by as many passes as ``plans`` ask for."""
    passes, window = (max(x) for x in zip(*plans(classes) or [(1, WINDOWS[0])]))
    found = None
    for first in range(0, passes, PASSES_AT_ONCE):
        some = staged(links(classes, range(first, min(first + PASSES_AT_ONCE, passes)), window), "found")
        found = some if found is None else found.unionByName(some)
    return found


def links(classes: DataFrame, passes: range, window: int, least: float = THRESHOLD) -> DataFrame:
    """Spanning links (a, b) between ids of ``classes`` (id, vector, dim) found linked in any of ``passes``."""
    block_rows = max(ROWS, 2 * window)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if dim not in planes:
                    if sum(map(np.size, planes.values())) > WINDOW_NUMBERS:
                        planes.clear()
                    planes[dim] = np.hstack([np.random.default_rng([SEED, dim, p]).normal(size=(dim, HASHES)) for p in passes])
                keys = _keys(_unit(part["vector"]), planes[dim])
                yield pd.DataFrame(
                    {"pass": np.tile(np.array(passes), len(part)), "dim": np.repeat(part["dim"].to_numpy(), len(passes)), "key": keys.ravel(), "id": np.repeat(part["id"].to_numpy(), len(passes))}
                )

    narrow = classes.select("id", "vector", "dim").mapInPandas(keyed, "pass int, dim int, key long, id long")
    ordered = staged(narrow.repartitionByRange("pass", "dim", "key", "id").withColumn("part", F.spark_partition_id()), "passes")
    sizes = sorted((r["pass"], r["part"], r["n"]) for r in ordered.groupBy("pass", "part").agg(F.count("*").alias("n")).collect())
    before, offsets = {}, []
    for p, part, n in sizes:  # as many rows as passes and range partitions: it follows the cluster, not the data
        offsets.append((p, part, before.get(p, 0)))
        before[p] = before.get(p, 0) + n
    table = classes.sparkSession.createDataFrame(offsets, "pass int, part int, offset long")
    inside = Window.partitionBy("pass", "part").orderBy("dim", "key", "id")
    ranked = ordered.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(table), ["pass", "part"])
    rank = F.col("place") + F.col("offset")
    block = F.floor(rank / block_rows)
    shared = (rank % block_rows < window) & (block > 0)
    dealt = ranked.select("pass", "id", rank.alias("rank"), F.explode(F.when(shared, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        ids, own = pdf["id"].to_numpy(), int((pdf["rank"] // block_rows == pdf["block"]).sum())
        rows = [np.zeros((2, 0), dtype=np.int64)]
        starts = np.flatnonzero(np.diff(pdf["dim"].to_numpy(), prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            if a < own and b - a > 1:
                rows.append(np.stack(window_pairs(_unit(pdf["vector"].iloc[a:b]), min(b, own) - a, window, least)) + a)
        root = roots(len(ids), *np.concatenate(rows, axis=1))
        tied = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[tied], "b": ids[root[tied]]})

    return dealt.join(classes.select("id", "vector", "dim"), "id").groupBy("pass", "block").applyInPandas(compared, "a long, b long")


def unlike_pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (i, j) of the unit vectors a and b that aren't of one component. Single precision rules out, double decides."""
    if of_a.min() == of_a.max() == of_b.min() == of_b.max():
        return (np.zeros(0, dtype=np.int64),) * 2
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    # Rounding of both vectors, of products and sums, twice over.
    sure = least - (a.shape[1] + 4) * 2.0**-23
    quick_a, quick_b = a.astype(np.float32), b.astype(np.float32).T
    for at in range(0, len(a), 512):
        cosines = quick_a[at : at + 512] @ quick_b
        rows = np.flatnonzero(cosines.max(axis=1) >= sure) + at
        if len(rows):
            i, j = np.nonzero((cosines[rows - at] >= sure) & (of_a[rows, None] != of_b))
            some = max(1, WINDOW_NUMBERS // a.shape[1])
            for cut in range(0, len(i), some):
                x, y = rows[i[cut : cut + some]], j[cut : cut + some]
                near = np.einsum("ij,ij->i", a[x], b[y]) >= least
                found.append((x[near], y[near]))
    i, j = (np.concatenate(x) for x in zip(*found))
    return i, j


def missed_links(classes: DataFrame, joined: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """Spanning links (a, b) between the components of ``joined`` (component, id), a class without one being its own, from
    all pairs of ``classes`` (id, vector, dim).

    Classes are packed into blocks, and pairs of parts of that table are its tasks: it is read, not shuffled, and a block of
    any density is one of many. Only links between components leave a task.
    """
    n, numbers = classes.agg(F.count("*"), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    parts = max(1, min(math.ceil(n / PART_ROWS), PARTS), math.ceil(8 * numbers / PART_BYTES))
    kind = np.float32 if isinstance(classes.schema["vector"].dataType.elementType, FloatType) else np.float64

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                rows = max(1, min(ROWS, WINDOW_NUMBERS // dim))
                for at in range(0, len(part), rows):
                    block = part.iloc[at : at + rows]
                    yield pd.DataFrame({"dim": [dim], "components": [block["component"].to_numpy(np.int64).tobytes()], "numbers": [np.array(block["vector"].tolist(), dtype=kind).tobytes()]})

    named = classes.join(joined, "id", "left").select("id", "vector", "dim", F.coalesce("component", "id").alias("component"))
    order = ["dim", "component", "id"]
    # Fewer parts than ranges, where the cluster asks for more ranges: blocks are filled.
    ranged = named.repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order)
    blocks = staged(ranged.mapInPandas(packed, "dim int, components binary, numbers binary").withColumn("block", F.monotonically_increasing_id()), "blocks")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, *sides in zip(pdf["dim"], pdf["components"], pdf["other_components"], pdf["numbers"], pdf["other_numbers"]):
                of_a, of_b = (np.frombuffer(x, dtype=np.int64) for x in sides[:2])
                a, b = (_unit(np.frombuffer(x, dtype=kind).reshape(-1, dim)) for x in sides[2:])
                i, j = unlike_pairs(a, b, of_a, of_b, least)
                if len(i):
                    ids, at = np.unique(np.concatenate([of_a[i], of_b[j]]), return_inverse=True)
                    root = roots(len(ids), at[: len(i)], at[len(i) :])
                    tied = np.flatnonzero(root != np.arange(len(ids)))
                    yield pd.DataFrame({"a": ids[tied], "b": ids[root[tied]]})

    others = blocks.select(F.col("dim").alias("other_dim"), F.col("block").alias("other_block"), F.col("components").alias("other_components"), F.col("numbers").alias("other_numbers"))
    pairs = blocks.hint("shuffle_replicate_nl").join(others, (F.col("dim") == F.col("other_dim")) & (F.col("block") <= F.col("other_block")))
    return pairs.select("dim", "components", "other_components", "numbers", "other_numbers").mapInPandas(compared, "a long, b long")


def linked_counts(members: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(id, n_linked): for each class of ``members`` (component, id, vector, copies) the copies of those it links with."""
    sizes = staged(members.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces")), "sizes")
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    dealt = (
        with_groups(members, sizes, "component", F.xxhash64("id"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("component", "id", "vector", "copies", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .repartition("component", "p", "q")  # else rows could stay dealt by component alone
    )

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, copies = _unit(pdf["vector"]), pdf["copies"].to_numpy(np.float64)
        first = (pdf["own"] == pdf["p"]).to_numpy()
        if pdf["p"].iat[0] == pdf["q"].iat[0]:
            near = unit @ unit.T >= least
            np.fill_diagonal(near, False)
            n = near @ copies
        else:
            near = unit[first] @ unit[~first].T >= least
            n = np.zeros(len(pdf))
            n[first], n[~first] = near @ copies[~first], copies[first] @ near
        return pd.DataFrame({"id": pdf["id"], "n": n.astype(np.int64)})

    return dealt.groupBy("component", "p", "q").applyInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_linked"))


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    rows = embeddings.groupBy("vec_id").agg(F.min("embedding").alias("vector"))
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = staged(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    good = rows.filter("sound").select("vec_id", "vector")
    classes = staged(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")), "classes")
    found = found_links(classes)
    joined = staged(components(found, "a", "b").withColumnRenamed("node", "id"), "joined")
    missed = staged(missed_links(classes, joined), "missed")
    if not missed.isEmpty():
        joined = staged(components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(missed), "a", "b").withColumnRenamed("node", "id"), "joined")
    members = joined.join(classes, "id").select("component", "id", "vector", "copies")
    counts = joined.join(linked_counts(members), "id")
    linked = F.col("copies") - 1 + F.coalesce("n_linked", F.lit(0))
    by_class = classes.join(counts, "id", "left").select("vector", F.col("copies").alias("n"), linked.alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # A vector of which a large share of all rows are copies fills no task.
    spread = F.array(F.xxhash64("vec_id").cast(rows.schema["vector"].dataType.elementType))
    judged = with_groups(good, staged(by_class, "judged"), "vector", spread).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
