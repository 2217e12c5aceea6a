"""Fitted models: t test, Fisher's exact test, logistic and Cox regression, and the cell matrix recipes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.stats import crosstab_statistic, range_bounds, running
from tessella.operators.survival import chi_square_p
from tessella.session import written


def welch(df: DataFrame, value: str, first_group: Column) -> DataFrame:
    """Welch's t and its degrees of freedom."""
    g = lambda f, own: f(F.when(first_group if own else ~first_group, F.col(value)))
    s = df.agg(*(g(f, own).cast("double").alias(f"{n}{i}") for i, own in ((1, True), (2, False)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return s.select(((F.col("m1") - F.col("m2")) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("degrees"))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a two-by-two table: all tables with its margins that are no likelier."""
    n, r, k = a + b + c + d, a + b, a + c
    log = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(n - r + 1) - math.lgamma(k - x + 1) - math.lgamma(n - r - k + x + 1) - (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    )
    own = log(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, k - (n - r)), min(r, k) + 1) if (p := log(x)) <= own + 1e-7))


def fisher(df: DataFrame, exposed: Column, outcome: Column) -> float:
    of = lambda e, o: F.count(F.when((exposed if e else ~exposed) & (outcome if o else ~outcome), 1))
    return fisher_p(*df.agg(of(1, 1), of(1, 0), of(0, 1), of(0, 0)).first())


def association(df: DataFrame, a: str, b: str) -> dict:
    """How two columns hang together: Fisher's exact test if a two-by-two table has a cell under 5, else Pearson's chi-square.

    ``method``, ``p``, and for chi-square ``statistic`` and ``degrees``; p is None where a table has one row or column. Rows with a null in either column don't count.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).limit(5).collect()
    rows, columns = sorted({r[a] for r in cells}), sorted({r[b] for r in cells})
    if len(rows) == len(columns) == 2:
        n = {(r[a], r[b]): r["n"] for r in cells}
        four = [n.get((x, y), 0) for x in rows for y in columns]
        if min(four) < 5:
            return {"method": "fisher", "p": fisher_p(*four)}
    statistic, degrees = crosstab_statistic(df, a, b).first()
    return {"method": "chi-square", "statistic": statistic, "degrees": degrees, "p": chi_square_p(statistic, degrees) if degrees else None}


def logistic(df: DataFrame, label: str, covariates: list[str]) -> dict[str, float]:
    """Coefficients of an unpenalised logistic regression."""
    rows = VectorAssembler(inputCols=covariates, outputCol="_x", handleInvalid="skip").transform(df).select("_x", F.col(label).cast("double").alias("_y"))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=100, tol=1e-9, standardization=True).fit(rows)
    return {"intercept": float(fit.intercept)} | dict(zip(covariates, map(float, fit.coefficients)))


def cox(
    df: DataFrame, time: str, event: str, covariates: list[str], rounds: int = 12, tolerance: float = 1e-8, entry: str | None = None, efron: bool = False
) -> dict[str, tuple[float, float]]:
    """(coefficient, standard error) of each covariate by Newton's method, with Breslow's or Efron's ties.

    With ``entry``, a subject is at risk from after its entry to its time: what entered later is taken off the running sums of
    what left later. Each round is one aggregation to a row a time, and running sums over those; subjects never leave the
    executors.
    """
    if entry is not None:
        df = df.filter(F.col(entry) < F.col(time))  # others are never at risk
    p = len(covariates)
    x = [F.col(c).cast("double") for c in covariates]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    names = ["s0", *(f"s1_{i}" for i in range(p)), *(f"s2_{i}_{j}" for i, j in pairs)]
    every = df.select(F.col(time).alias("t")) if entry is None else df.select(F.explode(F.array(F.col(time), F.col(entry))).alias("t"))
    beta, bounds = np.zeros(p), range_bounds(every.distinct(), "t")
    for _ in range(rounds):
        risk = F.exp(sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0)))
        e = F.col(event).cast("double")
        terms = dict(zip(names, [risk, *(risk * c for c in x), *(risk * x[i] * x[j] for i, j in pairs)]))
        sums = df.groupBy(F.col(time).alias("t")).agg(
            F.sum(e).alias("d"), *(F.sum(v).alias(n) for n, v in terms.items()), *(F.sum(e * v).alias(f"dead_{n}") for n, v in terms.items()), *(F.sum(e * c).alias(f"o_{i}") for i, c in enumerate(x)),
        )
        if entry is not None:
            late = df.groupBy(F.col(entry).alias("t")).agg(*(F.sum(-v).alias(n) for n, v in terms.items()))
            both = sums.unionByName(late, allowMissingColumns=True).groupBy("t")
            sums = both.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums.columns if c != "t"))
        later = running(written(sums, "risks"), "t", {f"r_{n}": ("sum", F.col(n)) for n in names}, descending=True, bounds=bounds).filter("d > 0")
        # Of d subjects that die together, Efron takes the shares 0, 1/d, ... of their own risk off; Breslow none.
        before = F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)) if efron else F.lit(0)
        each = later.withColumn("before", before).withColumn("gone", F.col("before") / F.col("d")).select(
            F.when(F.col("gone") == 0, 1).otherwise(0).alias("first"), (F.lit(1.0) if efron else F.col("d")).alias("times"), *(f"o_{i}" for i in range(p)),
            *((F.col(f"r_{n}") - F.col("gone") * F.col(f"dead_{n}")).alias(n) for n in names),
        )
        mean = [F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
        row = each.agg(
            *(F.sum(F.col("first") * F.col(f"o_{i}") - F.col("times") * mean[i]) for i in range(p)), *(F.sum(F.col("times") * (F.col(f"s2_{i}_{j}") / F.col("s0") - mean[i] * mean[j])) for i, j in pairs)
        ).first()
        slope, curve = np.array(row[:p], dtype=float), np.zeros((p, p))
        for (i, j), v in zip(pairs, row[p:]):
            curve[i, j] = curve[j, i] = v
        step = np.linalg.solve(curve, slope)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    errors = np.sqrt(np.diag(np.linalg.inv(curve)))
    return {c: (float(b), float(s)) for c, b, s in zip(covariates, beta, errors)}


def ranked_genes(df: DataFrame, name: str, score: str) -> DataFrame:
    """One score for each name, the best, without missing ones, in order."""
    return df.filter(F.col(score).isNotNull() & F.col(name).isNotNull()).groupBy(name).agg(F.max(score).alias(score)).orderBy(F.desc(score), name)


def principal_components(df: DataFrame, cell: str, counts: str, k: int, genes: int = 2000, scale: float = 10_000.0) -> DataFrame:
    """(cell, components): counts scaled to one total, log1p, the most variable genes, and their first ``k`` principal components.

    Variances are one aggregate over (gene, value) pairs of non-zero counts; the covariance is as large as the genes kept.
    """
    total = F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)
    logs = df.filter(total > 0).select(cell, F.transform(counts, lambda v: F.log1p(v * scale / total)).alias("_logs"))
    n = logs.count()
    sums = logs.select(F.posexplode("_logs").alias("gene", "v")).filter("v <> 0").groupBy("gene").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    kept = sorted(r["gene"] for r in sums.orderBy(F.desc(F.col("q") - F.col("s") * F.col("s") / max(n, 1)), "gene").limit(genes).collect())
    rows = logs.select(cell, array_to_vector(F.array(*(F.get("_logs", F.lit(g)) for g in kept))).alias("_x"))
    fit = PCA(k=min(k, len(kept)), inputCol="_x", outputCol="_y").fit(rows)
    return fit.transform(rows).select(cell, vector_to_array("_y").alias("components"))


def cell_quality(df: DataFrame, cell: str, counts: str, genes: list[int], least: int, most_share: float) -> DataFrame:
    """Cells with at least ``least`` genes seen and at most a share of counts in ``genes``."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)
    marked = F.aggregate(F.array(*(F.get(counts, g) for g in genes)), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    seen = F.size(F.filter(counts, lambda v: v > 0))
    return df.select(cell, seen.alias("n_genes"), (marked / F.nullif(total, F.lit(0.0))).alias("share")).filter((F.col("n_genes") >= least) & (F.coalesce("share", F.lit(0.0)) <= most_share))
