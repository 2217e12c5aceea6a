"""Derived variables of a cohort: measures, composites, flags, one value out of many rows, and what looks wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.stats import five_numbers

#: A share of missing values beyond which a column is flagged.
MOST_MISSING = 0.3


def body_mass_index(weight_kg: Column, height_m: Column) -> Column:
    """Weight by squared height; null where either is missing or the height is not positive."""
    return F.when(height_m > 0, weight_kg / (height_m * height_m))


def selected(df: DataFrame, keys: list[str], value: str, at: str, *ties: str, until: Column | None = None, name: str | None = None) -> DataFrame:
    """The latest value of each key, of rows up to an event if ``until`` says which those are (ECOG, weight).

    Rows without a value are passed over; ``ties`` order rows of one time. A pre-aggregated maximum, no sort.
    """
    counted = F.col(value).isNotNull() & (F.lit(True) if until is None else F.coalesce(until, F.lit(False)))
    return df.groupBy(*keys).agg(F.max_by(F.when(counted, F.col(value)), F.when(counted, F.struct(at, *ties))).alias(name or value))


def all_negative(df: DataFrame, keys: list[str], test: str, positive: Column, tests: list[str], name: str) -> DataFrame:
    """Whether every one of ``tests`` was made and none was positive (triple negative); null while none is positive and one is missing."""
    seen = [F.max(F.when(F.col(test) == t, positive.cast("int"))) for t in tests]
    any_positive = F.greatest(*(F.coalesce(s, F.lit(0)) for s in seen)) == 1
    made = sum((s.isNotNull().cast("int") for s in seen), F.lit(0))
    return df.groupBy(*keys).agg(F.when(any_positive, False).when(made == len(tests), True).alias(name))


def reaches(value: Column, cutoff: float) -> Column:
    """Whether a measured level reaches its cut-off (PD-L1, TMB); unmeasured stays null."""
    return value >= cutoff


def class_flags(df: DataFrame, keys: list[str], column: str, classes: dict[str, list[str]]) -> DataFrame:
    """One flag for each class: whether any row of the key is of one of its members (any immunotherapy, any platinum)."""
    return df.groupBy(*keys).agg(*(F.coalesce(F.bool_or(F.col(column).isin(*members)), F.lit(False)).alias(flag) for flag, members in classes.items()))


def reduced(df: DataFrame, keys: list[str], value: str, order: list[str], ranks: dict[str, int] | None = None, positive: Column | None = None) -> DataFrame:
    """first, most_recent, n_values, distinct_values (joined), worst (by ``ranks``) and any_positive of each key's rows.

    ``order`` leaves no ties. Values without a rank are never the worst. Only the list of distinct values grows with a
    group, by as many values as the column has.
    """
    place = F.struct(*order)
    out = [F.min_by(value, place).alias("first"), F.max_by(value, place).alias("most_recent"), F.count(value).alias("n_values"), F.array_join(F.array_sort(F.collect_set(value)), "; ").alias("distinct_values")]
    if ranks:
        rank = F.try_element_at(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair)), F.col(value))
        out.append(F.max_by(value, rank).alias("worst"))
    if positive is not None:
        out.append(F.coalesce(F.bool_or(positive), F.lit(False)).alias("any_positive"))
    return df.groupBy(*keys).agg(*out)


def quality_flags(df: DataFrame, columns: list[str], times: list[str] = (), most_missing: float = MOST_MISSING) -> DataFrame:
    """(column_name, missing_share, often_missing, n_negative): gaps of columns, negative values of times; one pass."""
    wide = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(columns)), *(F.count(F.when(F.col(f"`{c}`") < 0, 1)).alias(f"m{i}") for i, c in enumerate(columns) if c in times))
    part = lambda i, c: F.struct(F.lit(c).alias("column_name"), (1 - F.col(f"v{i}") / F.nullif(F.col("n"), F.lit(0))).alias("missing_share"), (F.col(f"m{i}") if c in times else F.lit(0).cast("long")).alias("n_negative"))
    rows = wide.select(F.inline(F.array(*(part(i, c) for i, c in enumerate(columns)))))
    return rows.select("column_name", "missing_share", (F.col("missing_share") > most_missing).alias("often_missing"), "n_negative")


def column_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column_name, standing): shared, only in the first, only in the second; names compared in any case."""
    left, right = {c.lower() for c in a.columns}, {c.lower() for c in b.columns}
    rows = [(c, "shared" if c in left and c in right else "first" if c in left else "second") for c in sorted(left | right)]
    return a.sparkSession.createDataFrame(rows, "column_name string, standing string")


def value_counts(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(column_name, value, n, pct): the most frequent values of each column, null among them, equal ones in order of the value."""
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("v")
    counts = df.select(named).select("v.*").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    top = counts.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    return top.withColumn("pct", 100 * F.col("n") / F.lit(max(1, df.count())))


def column_report(df: DataFrame, numbers: list[str], others: list[str]) -> DataFrame:
    """(column_name, n_missing, missing_pct, least, q1, median, q3, largest), one row a column; quartiles are exact, of numbers only."""
    every = [*numbers, *others]
    missing = df.agg(F.count("*").alias("_all"), *((F.count("*") - F.count(F.col(f"`{c}`"))).alias(c) for c in every)).unpivot(["_all"], every, "column_name", "n_missing")
    spread = five_numbers(df, numbers).select("column_name", "least", "q1", "median", "q3", "largest")
    return missing.join(spread, "column_name", "left").select("column_name", "n_missing", (100 * F.col("n_missing") / F.col("_all")).alias("missing_pct"), "least", "q1", "median", "q3", "largest")
