"""Survival by group: curves with their errors, medians, survival at given times, and the log-rank test.

All of it runs over one row for each distinct time of a group, dealt by ranges of time; groups are few.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.stats import range_bounds, running
from tessella.session import written

#: 97.5 % quantile of the normal distribution.
Z = 1.959963984540054


def chi_square_p(x: float, degrees: int) -> float:
    """P(X >= x) of a chi-square variable: the upper incomplete gamma function by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    a, y = degrees / 2, x / 2
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - front * total)
    # Lentz's evaluation of the continued fraction.
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        b += 2
        step = -i * (i - a)
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def risk_sets(df: DataFrame, entry: str, stop: str) -> DataFrame:
    """(t, at_risk) at each stop: those who entered before and stop then or later, as a running difference of two counts.

    Who enters at the stop or after it is never at risk.
    """
    stops = df.groupBy(F.col(stop).alias("t")).agg(F.count(F.when(F.col(entry) < F.col(stop), 1)).alias("m"), F.lit(True).alias("is_stop"))
    entries = df.filter(F.col(entry) < F.col(stop)).groupBy(F.col(entry).alias("t")).agg((-F.count("*")).alias("m"), F.lit(False).alias("is_stop"))
    both = written(stops.unionByName(entries).groupBy("t").agg(F.sum("m").alias("m"), F.max("is_stop").alias("is_stop")).filter("t is not null"), "risk-times")
    counted = running(both, "t", {"at_risk": ("sum", F.col("m"))}, descending=True)
    return counted.filter("is_stop and at_risk > 0").select("t", "at_risk")


def curve(df: DataFrame, time: str, event: str, by: str, entry: str | None = None) -> DataFrame:
    """(by, time, at_risk, events, survival, std_error, lower, upper) at each time with an event.

    Greenwood's error, and a 95 % interval on the log-minus-log scale; both bounds are null where survival is 0. With
    ``entry``, only those who entered before are at risk; who enters at its own time or after it never is.
    """
    own = df.filter(F.col(by).isNotNull() & F.col(time).isNotNull())
    if entry is not None:
        own = own.filter(F.col(entry) < F.col(time))
    times = own.groupBy(by, F.col(time).alias("t")).agg(F.count("*").alias("m"), F.sum(F.col(event).cast("long")).alias("d"))
    if entry is not None:
        entered = own.groupBy(by, F.col(entry).alias("t")).agg((-F.count("*")).alias("m"), F.lit(0).cast("long").alias("d"))
        times = times.unionByName(entered).groupBy(by, "t").agg(F.sum("m").alias("m"), F.sum("d").alias("d"))
    times = written(times, "times")
    bounds = range_bounds(times, "t")
    # Those who leave at a time or later, without those who enter then or later.
    steps = running(times, "t", {"n": ("sum", F.col("m"))}, descending=True, by=by, bounds=bounds).filter("d > 0 and n > 0").withColumn("f", 1 - F.col("d") / F.col("n"))
    wanted = {"lowest": ("min", F.col("f")), "logs": ("sum", F.when(F.col("f") > 0, F.ln("f"))), "spread": ("sum", F.when(F.col("n") > F.col("d"), F.col("d") / (F.col("n") * (F.col("n") - F.col("d")))))}
    steps = running(steps, "t", wanted, by=by, bounds=bounds)
    alive = steps.withColumn("s", F.when(F.col("lowest") > 0, F.exp("logs")).otherwise(0.0))
    width = Z * F.sqrt("spread") / F.col("logs")
    bound = lambda side: F.when(F.col("s") > 0, F.pow("s", F.exp(side * width)))
    return alive.select(
        by, F.col("t").alias("time"), F.col("n").alias("at_risk"), F.col("d").alias("events"), F.col("s").alias("survival"),
        F.when(F.col("s") > 0, F.col("s") * F.sqrt("spread")).otherwise(0.0).alias("std_error"), bound(-1).alias("lower"), bound(1).alias("upper"),
    )


def summary(df: DataFrame, time: str, event: str, by: str, at: list[float], entry: str | None = None) -> DataFrame:
    """One row a group: n, events, median (null if survival stays above a half), and survival at each of the given times.

    Survival at a time is that of the last event up to it, and 1 before the first.
    """
    steps = curve(df, time, event, by, entry)
    shown = [F.coalesce(F.max_by("survival", F.when(F.col("time") <= t, F.col("time"))), F.lit(1.0)).alias(f"at_{t:g}") for t in at]
    found = steps.groupBy(by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"), *shown)
    sizes = df.filter(F.col(time).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    names = [f"at_{t:g}" for t in at]
    return sizes.filter(F.col(by).isNotNull()).join(found, by, "left").select(by, "n", "events", "median", *(F.coalesce(n, F.lit(1.0)).alias(n) for n in names))


def log_rank(df: DataFrame, time: str, event: str, by: str) -> tuple[DataFrame, dict]:
    """(by, observed, expected) of each group, and the statistic with its degrees of freedom and p.

    ``by`` has few values: they are columns of one row a time, over which the numbers at risk run.
    """
    own = df.filter(F.col(by).isNotNull() & F.col(time).isNotNull())
    groups = sorted(r[0] for r in own.select(by).distinct().collect())
    is_of = [F.col(by) == g for g in groups]
    e = F.col(event).cast("long")
    times = own.groupBy(F.col(time).alias("t")).agg(
        F.sum(e).alias("d"), *(F.count(F.when(c, 1)).alias(f"m{i}") for i, c in enumerate(is_of)), *(F.sum(F.when(c, e).otherwise(0)).alias(f"d{i}") for i, c in enumerate(is_of)),
    )
    k = range(len(groups))
    risks = running(written(times, "times"), "t", {f"n{i}": ("sum", F.col(f"m{i}")) for i in k}, descending=True).filter("d > 0")
    n = sum((F.col(f"n{i}") for i in k), F.lit(0))
    share = [F.col(f"n{i}") / n for i in k]
    spread = F.when(n > 1, F.col("d") * (n - F.col("d")) / (n - 1)).otherwise(0.0)
    pairs = [(i, j) for i in k for j in k if i <= j]
    row = risks.agg(
        *(F.sum(f"d{i}").alias(f"o{i}") for i in k), *(F.sum(F.col("d") * share[i]).alias(f"e{i}") for i in k),
        *(F.sum(spread * (share[i] - share[i] * share[j] if i == j else -share[i] * share[j])).alias(f"v{i}_{j}") for i, j in pairs),
    ).first()
    observed, expected = [row[f"o{i}"] or 0 for i in k], [row[f"e{i}"] or 0.0 for i in k]
    v = np.zeros((len(groups), len(groups)))
    for i, j in pairs:
        v[i, j] = v[j, i] = row[f"v{i}_{j}"] or 0.0
    apart = np.array(observed[:-1], dtype=float) - np.array(expected[:-1])
    statistic = float(apart @ np.linalg.pinv(v[:-1, :-1]) @ apart) if len(groups) > 1 else 0.0
    kind = df.schema[by].dataType.simpleString()
    table = df.sparkSession.createDataFrame(list(zip(groups, observed, expected)), f"`{by}` {kind}, observed long, expected double")
    return table, {"statistic": statistic, "degrees": len(groups) - 1, "p": chi_square_p(statistic, len(groups) - 1) if len(groups) > 1 else 1.0}
