"""Which record wins, and what follows what: windows over explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCK = 0.9


def last_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last record of each key; ``order`` goes from last to first and leaves no ties."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")


def most_confident(df: DataFrame, keys: list[str], confidence: str, passed: str) -> DataFrame:
    """The highest confidence of each key; of equals the earliest pass. A pre-aggregated maximum, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(confidence, F.lit(0.0)), -F.col(passed))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def locked_merge(df: DataFrame, keys: list[str], confidence: str, passed: str, lock: float = LOCK) -> DataFrame:
    """The first pass sure enough to lock the field, else the most confident one, the earlier of equals."""
    rest = [c for c in df.columns if c not in keys]
    sure = F.coalesce(confidence, F.lit(0.0))
    locks = sure >= lock
    rank = F.struct(locks, F.when(locks, -F.col(passed)), F.when(~locks, sure), -F.col(passed))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_best")).select(*keys, "_best.*")


def lines_of_therapy(df: DataFrame, key: str, start: str, order: str, gap_seconds: int, end: str | None = None, name: str = "line") -> DataFrame:
    """``df`` with a number that grows by one wherever more than the gap lies between a record and the one before."""
    ordered = Window.partitionBy(key).orderBy(start, order)
    before = F.lag(end or start).over(ordered)
    opens = F.when(before.isNull() | (F.timestamp_diff("SECOND", before, F.col(start)) > gap_seconds), 1).otherwise(0)
    flagged = df.withColumn("_opens", opens)
    return flagged.withColumn(name, F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def instances(df: DataFrame, keys: list[str], *order: Column, name: str = "instance") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, order: str, name: str) -> DataFrame:
    """``left`` with the value of the latest earlier record of ``right``.

    Both sides are one stream ordered by time; the value is carried forward. A record at the same time isn't earlier.
    """
    marks = right.select(F.col(key), F.col(at), F.struct(value).alias("_carried"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema[order].dataType).alias(order))
    rows = left.withColumn("_carried", F.lit(None).cast(marks.schema["_carried"].dataType)).withColumn("_side", F.lit(0))
    stream = rows.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy(at, "_side", order).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("_carried", ignorenulls=True).over(before)
    return stream.withColumn(name, carried[value]).filter("_side = 0").drop("_side", "_carried")


def concatenated_notes(notes: DataFrame, patient: str, order: list[str], header: Column, text: str, least: int = 10) -> DataFrame:
    """(patient, text): notes of at least ``least`` characters in order, each under its header, a blank line between."""
    long = notes.filter(F.length(text) >= least)
    part = F.struct(*order, F.concat(header, F.lit("\n"), F.col(text)).alias("_t"))
    return long.groupBy(patient).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["_t"]), "\n\n").alias("text"), F.count("*").alias("n_notes"))


def chunked(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters that overlap, as array<string>; size 0 or less: one piece."""
    if size <= 0:
        return F.array(text)
    step = max(1, size - overlap)
    n = F.when(F.length(text) <= size, 1).otherwise(F.ceil((F.length(text) - size) / step).cast("int") + 1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * step + 1, F.lit(size))))


def open_fields(wanted: DataFrame, results: DataFrame, keys: list[str], confidence: str, lock: float = LOCK) -> DataFrame:
    """The wanted fields that are to be asked again: absent, or nowhere sure enough."""
    return wanted.join(results.filter(F.coalesce(confidence, F.lit(0.0)) >= lock).select(*keys).distinct(), keys, "left_anti")
