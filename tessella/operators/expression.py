"""Differential expression with moderated t, and enrichment of gene sets in a ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.models_fit import welch
from tessella.operators.stats import adjusted_p, mann_whitney_z, running
from tessella.session import written

#: Ranges of mean log count in which the trend of the spread is averaged.
TREND = 30


def digamma(x: float, order: int = 0) -> float:
    """The digamma function, or with ``order`` 1 the trigamma function, by recurrence and their asymptotic series."""
    out = 0.0
    while x < 12:
        out += -1 / x if order == 0 else 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    if order == 0:
        return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def prior_of(mean: float, spread: float, degrees: float) -> tuple[float, float]:
    """(degrees, variance) of the prior of gene variances, from mean and variance of their logs; endless degrees if they don't vary beyond chance."""
    centre = mean - digamma(degrees / 2) + math.log(degrees / 2)
    rest = spread - digamma(degrees / 2, 1)
    if rest <= 0:
        return math.inf, math.exp(centre)
    low, high = 1e-6, 1e8  # trigamma falls: halve the interval in which it meets the rest
    for _ in range(200):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if digamma(middle, 1) > rest else (low, middle)
    return 2 * low, math.exp(centre + digamma(low) - math.log(low))


def t_p(t: np.ndarray, degrees: float) -> np.ndarray:
    """Two-sided p of Student's t: the incomplete beta function by its continued fraction; the normal one for endless degrees."""
    t = np.abs(np.asarray(t, dtype=float))
    if math.isinf(degrees):
        return np.array([math.erfc(x / math.sqrt(2)) for x in t])
    a, b = degrees / 2, 0.5
    x = degrees / (degrees + t * t)

    def tail(a: float, b: float, x: np.ndarray) -> np.ndarray:
        c, d = np.ones_like(x), 1 / np.maximum(1 - (a + b) * x / (a + 1), 1e-300)
        h = d.copy()
        for m in range(1, 400):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + step * d)
                c = 1 + step / c
                h = h * d * c
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16)))
        return front * h / a

    direct = x < (a + 1) / (a + b + 2)
    return np.where(t == 0, 1.0, np.where(direct, tail(a, b, np.where(direct, x, 0.5)), 1 - tail(b, a, np.where(direct, 0.5, 1 - x))))


def t_test(df: DataFrame, value: str, first_group: Column) -> dict[str, float]:
    """Welch's t, its degrees of freedom and the two-sided p."""
    t, degrees = welch(df, value, first_group).first()
    return {"t": t, "degrees": degrees, "p": None if t is None or degrees is None else float(t_p(np.array([t]), degrees)[0])}


def rank_test(df: DataFrame, value: str, first_group: Column) -> dict[str, float]:
    """Mann-Whitney's U of the first group, its z with ties and a continuity of a half accounted for, and the two-sided p."""
    row = mann_whitney_z(df, value, first_group).first()
    return {"u": row["u"], "z": row["z"], "p": None if row["z"] is None else math.erfc(abs(row["z"]) / math.sqrt(2))}


def log_counts(counts: DataFrame, gene: str, sample: str, count: str) -> DataFrame:
    """``counts`` with log_count: log2 of counts in a million, half a count added to each, one to each sample's total."""
    totals = counts.groupBy(sample).agg((F.sum(count) + 1).alias("_total"))
    return counts.join(totals, sample).withColumn("log_count", F.log2((F.col(count) + 0.5) / F.col("_total") * 1e6))


def moderated_t(counts: DataFrame, gene: str, sample: str, count: str, treated: Column) -> DataFrame:
    """(gene, log_fold, mean, t, p, adjusted): two groups of samples compared gene by gene; every gene has a row for each sample.

    Observations are weighted by the trend of the spread over the mean log count, fitted as averages over ranges and
    interpolated; each gene's weighted squares are one aggregate; variances are shrunk towards a prior estimated from all genes,
    of which the driver sees two moments.
    """
    rows = written(log_counts(counts, gene, sample, count).withColumn("_g", treated.cast("int")), "log-counts")
    n, level = rows.select(sample, "_total").distinct().agg(F.count("*"), F.avg(F.log2("_total"))).first()
    of = lambda side, weight, value: F.sum(F.when(F.col("_g") == side, weight * value))

    def fitted(rows: DataFrame, weight: Column) -> DataFrame:
        """Weighted means of both groups, what is left of the squares, and the weights of both groups."""
        y = F.col("log_count")
        sums = rows.groupBy(gene).agg(*(of(s, weight, v).alias(f"{k}{s}") for s in (0, 1) for k, v in (("w", F.lit(1.0)), ("y", y), ("q", y * y))), F.avg(y).alias("mean"))
        left = sum(F.col(f"q{s}") - F.col(f"y{s}") * F.col(f"y{s}") / F.col(f"w{s}") for s in (0, 1))
        return sums.select(gene, "mean", "w0", "w1", (F.col("y0") / F.col("w0")).alias("m0"), (F.col("y1") / F.col("w1")).alias("m1"), (F.greatest(left, F.lit(0.0)) / (n - 2)).alias("variance"))

    first = written(fitted(rows, F.lit(1.0)).withColumn("size", F.col("mean") + F.lit(level) - math.log2(1e6)), "first-fit")
    borders = sorted(set(first.approxQuantile("size", [i / TREND for i in range(1, TREND)], 0.001)))
    part = F.greatest(F.lit(0), F.lit(0), *(F.when(F.col("size") > b, i + 1) for i, b in enumerate(borders)))
    trend = sorted((r["x"], r["y"]) for r in first.groupBy(part.alias("part")).agg(F.avg("size").alias("x"), F.avg(F.pow("variance", F.lit(0.25))).alias("y")).collect())

    def interpolated(at: Column) -> Column:
        out = F.lit(trend[-1][1])
        for (x0, y0), (x1, y1) in reversed(list(zip(trend, trend[1:]))):
            out = F.when(at <= x1, y0 + (at - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
        return F.when(at <= trend[0][0], trend[0][1]).otherwise(out)

    means = first.select(gene, F.col("m0").alias("_m0"), F.col("m1").alias("_m1"))
    expected = F.when(F.col("_g") == 0, F.col("_m0")).otherwise(F.col("_m1")) + F.log2("_total") - math.log2(1e6)
    weighted = rows.join(means, gene).withColumn("_w", F.pow(F.greatest(interpolated(expected), F.lit(1e-4)), F.lit(-4.0)))
    fit = written(fitted(weighted, F.col("_w")), "fit")
    mean, spread = fit.filter("variance > 0").agg(F.avg(F.ln("variance")), F.var_samp(F.ln("variance"))).first()
    before, usual = prior_of(mean, spread or 0.0, n - 2)
    shrunk = F.lit(usual) if math.isinf(before) else (before * F.lit(usual) + (n - 2) * F.col("variance")) / (before + n - 2)
    tested = fit.withColumn("t", (F.col("m1") - F.col("m0")) / F.sqrt(shrunk * (1 / F.col("w0") + 1 / F.col("w1"))))

    def tails(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(t_p(t.to_numpy(), before + n - 2))

    out = tested.select(gene, (F.col("m1") - F.col("m0")).alias("log_fold"), "mean", "t", F.pandas_udf(tails, "double")("t").alias("p"))
    return adjusted_p(written(out, "tested"), "p", "adjusted")


def ranked(genes: DataFrame, gene: str, score: str) -> DataFrame:
    """(gene, score, rank) from the highest score down, equal ones by name; counts run over one row for each distinct score."""
    own = genes.filter(F.col(score).isNotNull() & F.col(gene).isNotNull()).select(gene, score)
    counts = written(own.groupBy(score).agg(F.count("*").alias("_n")), "scores")
    above = running(counts, score, {"_above": ("sum", F.col("_n"))}, descending=True, strict=True).select(score, F.coalesce("_above", F.lit(0)).alias("_above"))
    inside = F.row_number().over(Window.partitionBy(score).orderBy(gene))
    return own.join(above, score).withColumn("rank", (F.col("_above") + inside).cast("long")).select(gene, score, "rank")


def _deviation(hits: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, size, enrichment) of hits (keys, rank, weight): the running sum is furthest from zero at a hit, or just before one."""
    order = Window.partitionBy(*keys).orderBy("rank")
    everything = Window.partitionBy(*keys)
    upto = hits.withColumn("hit", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(everything))
    upto = upto.withColumn("own", F.col("weight") / F.sum("weight").over(everything)).withColumn("place", F.row_number().over(order)).withColumn("size", F.count("*").over(everything))
    missed = (F.col("rank") - F.col("place")) / (F.lit(n) - F.col("size"))
    sides = upto.groupBy(*keys, "size").agg(F.max(F.col("hit") - missed).alias("up"), F.min(F.col("hit") - F.col("own") - missed).alias("down"))
    return sides.select(*keys, "size", F.when(F.col("up") >= -F.col("down"), F.col("up")).otherwise(F.col("down")).alias("enrichment"))


def enrichment(genes: DataFrame, sets: DataFrame, gene: str, score: str, name: str, draws: int = 0, seed: int = 1) -> DataFrame:
    """(name, size, enrichment) of each gene set in the ranking of ``genes``, and with ``draws`` also p.

    A hit adds its share of the absolute scores of its set, a miss its share of all other genes; only hits are walked, so the
    work grows with the sets. p: among sets of as many genes drawn by hash that lean the same way, the share of those that
    are as far off. Sets that hold no ranked gene, or all of them, have no row.
    """
    order = written(ranked(genes, gene, score), "ranking")
    n = order.count()
    members = sets.select(name, gene).distinct().join(order, gene)
    hits = members.select(name, "rank", F.abs(score).cast("double").alias("weight"))
    sized = hits.groupBy(name).agg(F.count("*").alias("_size"), F.sum("weight").alias("_all")).filter((F.col("_size") < n) & (F.col("_all") > 0))
    hits = written(hits.join(sized.select(name), name), "hits")
    found = _deviation(hits, [name], n)
    if not draws:
        return found
    each = hits.select(name, F.col("rank").alias("_member"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    # A draw moves each rank by hash; the few that meet are counted once, as a smaller set.
    drawn = each.select(name, "_draw", (F.pmod(F.xxhash64(name, "_draw", "_member", F.lit(seed)), F.lit(n)) + 1).alias("rank")).distinct()
    chance = _deviation(drawn.join(order.select("rank", F.abs(score).cast("double").alias("weight")), "rank"), [name, "_draw"], n)
    both = found.join(chance.select(name, F.col("enrichment").alias("_chance")), name)
    same = F.signum("_chance") == F.signum("enrichment")
    p = (F.count(F.when(same & (F.abs("_chance") >= F.abs("enrichment")), 1)) + 1) / (F.count(F.when(same, 1)) + 1)
    return both.groupBy(name, "size", "enrichment").agg(p.alias("p"))
