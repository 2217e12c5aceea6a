"""What may leave through the privacy gate: suppression, guards and the audit record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import small_masked

# Names of count and rate columns.
COUNT_NAMES = ("count", "cnt", "n", "total", "freq", "frequency")
COUNT_STARTS, COUNT_ENDS = ("n_", "num_", "count_", "cnt_"), ("_count", "_cnt", "_total", "_n", "_freq")
NOT_COUNTS = ("n_stage", "m_stage", "t_stage", "total_dose", "total_fractions", "n_category")
RATE_PARTS = ("pct", "percent", "rate", "prevalence", "proportion", "ci_lower", "ci_upper", "survival", "median_os")
MIN_CELL, MAX_ROWS, MOST_SHARE = 10, 500, 0.5


def count_columns(columns: list[str], given: list[str] | None = None) -> list[str]:
    """Given names, matched in any case, or those that look like counts."""
    if given:
        wanted = {g.strip().lower() for g in given}
        return [c for c in columns if c.lower() in wanted]
    looks = lambda c: c not in NOT_COUNTS and (c in COUNT_NAMES or c.startswith(COUNT_STARTS) or c.endswith(COUNT_ENDS))
    return [c for c in columns if looks(c.strip().lower())]


def is_rate(name: str) -> bool:
    return any(part in name.lower() for part in RATE_PARTS)


def suppressed(
    df: DataFrame, least: int = MIN_CELL, counts: list[str] | None = None, forbidden: tuple[str, ...] = ("record_id",), also: tuple[str, ...] = (),
    group: str | None = None, grouped_by: tuple[str, ...] = (),
) -> DataFrame:
    """Small counts as ``<k``; on such rows rate columns, and those of ``also``, read ``suppressed``.

    ``group``: a column with the rows behind each row, which leaves. Where it is small, whatever is neither a count nor
    in ``grouped_by`` becomes null; without any count to show, the row itself goes. Every column that could be masked is
    text in the result, so its type doesn't depend on the data.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in forbidden])
    shown_columns = [c for c in df.columns if c != group]
    masked = count_columns(shown_columns, counts)
    few = F.coalesce(F.col(f"`{group}`") < least, F.lit(False)) if group else F.lit(False)
    if not masked:
        return df.filter(~few).select(*(F.col(f"`{c}`") for c in shown_columns)) if group else df
    small = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"`{c}`") < least, F.lit(False)) for c in masked))

    def shown(c: str) -> Column:
        if c in masked:
            return small_masked(F.col(f"`{c}`"), least).alias(c)
        if is_rate(c) or c in also:
            return F.when(small | few, "suppressed").otherwise(F.col(f"`{c}`").cast("string")).alias(c)
        if group and c not in grouped_by:
            return F.when(~few, F.col(f"`{c}`")).alias(c)
        return F.col(f"`{c}`")

    return df.select(*(shown(c) for c in shown_columns))


def row_capped(df: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """The rows of ``df``, computed once; more than ``most`` raise an error. At most ``most`` + 1 of them reach the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise PermissionError(f"the result has more than {most} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


def size_guarded(df: DataFrame, cohort: int, share: float = MOST_SHARE) -> DataFrame:
    """Refuses results with more rows than a share of the cohort."""
    most = int(cohort * share)
    if cohort and df.limit(most + 1).count() > most:
        raise PermissionError(f"the result has more rows than {share:.0%} of the cohort")
    return df


def audit_record(df: DataFrame, sql: str) -> dict:
    """Statement, row count and a digest of the rows that doesn't depend on their order."""
    row = df.select(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    digest = df.sparkSession.range(1).select(F.sha2(F.lit(f"{row['n']}:{row['s'] or 0}"), 256)).first()[0]
    return {"sql": sql, "n_rows": row["n"], "digest": digest}
