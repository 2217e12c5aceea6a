"""Cohort building: ids, fills, filters, and what may leave the building."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import value_map
from tessella.functions.values import TRANSFORMS

# Column names that hold personal data.
PII_SUBSTRINGS = ("mrn", "ssn", "phone", "email", "address", "zip_code", "postal")
PII_NAMES = (
    "last_nm", "first_nm", "middle_nm", "last_name", "first_name", "middle_name", "patient_name", "full_name", "dob", "date_of_birth",
    "street", "city", "state", "zip", "county", "phone_number", "email_address", "fax", "insurance_id", "policy_number",
)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and a != b})


def harmonised(df: DataFrame, key: str, mappings: list[dict]) -> dict[str, DataFrame]:
    """One table for each category: the key, ``source``, and a column for each mapping whose own column exists.

    A mapping is {category, column, field, values?, transform?}; values are recoded before the transform. Of two mappings to
    one field the later counts; categories without any column are left out; an unknown transform changes nothing.
    """
    by_category: dict[str, dict[str, Column]] = {}
    for m in mappings:
        if m["column"] in df.columns:
            recoded = value_map(F.col(f"`{m['column']}`").cast("string"), m["values"]) if m.get("values") else F.col(f"`{m['column']}`")
            by_category.setdefault(m["category"], {})[m["field"]] = TRANSFORMS.get(m.get("transform"), lambda c: c)(recoded).alias(m["field"])
    return {category: df.select(key, F.lit("structured").alias("source"), *fields.values()) for category, fields in by_category.items()}


def with_record_id(df: DataFrame, candidates: list[str], name: str = "record_id") -> DataFrame:
    """The first candidate that the table has, in the given order, becomes the id."""
    own = next((c for c in candidates if c in df.columns), None)
    return df if own is None or own == name else df.withColumnRenamed(own, name)


def without_pii(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    gone = [c for c in df.columns if c.lower() in PII_NAMES or any(s in c.lower() for s in PII_SUBSTRINGS) or c in also]
    return df.drop(*gone)


def filled_columns(df: DataFrame, least: int = 10) -> list[str]:
    """Columns with at least ``least`` values, found in one pass."""
    if not df.columns:
        return []
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if counts[c] >= least]


def nonnull_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_values), one row a column, from one pass."""
    wide = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    return wide.unpivot([], list(df.columns), "column_name", "n_values")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order, which must leave no ties."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")


def fill_join(left: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """Left joins of sources that have a key once: new columns are added, gaps filled; earlier values win."""

    def one(base: DataFrame, source: DataFrame) -> DataFrame:
        shared = [c for c in source.columns if c in base.columns and c != key]
        more = [c for c in source.columns if c not in base.columns]
        fill = source.withColumnsRenamed({c: f"_fill_{c}" for c in shared})
        joined = base.join(fill, key, "left")
        return joined.select(key, *(F.coalesce(c, f"_fill_{c}").alias(c) if c in shared else F.col(c) for c in base.columns if c != key), *more)

    return reduce(one, sources, left)


def matching(df: DataFrame, column: str, codes: list[str], prefix: bool = False) -> DataFrame:
    """Rows in whose column any code is found anywhere, or at the start; NULL never matches."""
    return df.filter(F.coalesce(F.col(column).rlike("|".join(f"^(?:{c})" if prefix else c for c in codes)), F.lit(False)))


def surrogate_ids(df: DataFrame, key: str, prefix: str = "patient", name: str = "cohort_id") -> DataFrame:
    """(key, id): dense numbers in the order of the ids as text.

    The order is global but no task sees all ids: range partitions are numbered inside, and offset by the counts of the
    partitions before, of which there are as many as shuffle partitions.
    """
    ids = df.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_text", F.col(key).cast("string"))
    return numbered(ids, "_text").select(key, F.format_string(f"{prefix}_%06d", F.col("_rank")).alias(name))


def range_number(value: Column, bounds: list) -> Column:
    """How many of the ordered ``bounds`` lie below a value: the number of its range."""
    return F.greatest(F.lit(0), F.lit(0), *(F.when(F.lit(b) < value, i + 1) for i, b in enumerate(bounds)))


def range_count(df: DataFrame, most: int) -> int:
    """As many ranges as the session shuffles into, up to ``most``."""
    return max(1, min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


#: Ranges that a global numbering is dealt into at most.
RANGES = 256


def numbered(df: DataFrame, order: str, start: int = 1, name: str = "_rank") -> DataFrame:
    """``df`` with dense global numbers by a text column without ties.

    Borders between ranges are texts of the column itself, those with the least hashes; rows are counted by range, numbered
    inside, and offset by the ranges before. Nothing is kept in memory, and a retry deals the rows alike.
    """
    ranges = range_count(df, RANGES)
    texts = sorted(r[0] for r in df.select(order).orderBy(F.xxhash64(order)).limit(64 * ranges).collect())
    bounds = sorted({texts[i * len(texts) // ranges] for i in range(1, ranges)}) if texts else []
    parts = df.withColumn("_part", range_number(F.col(order), bounds))
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], start
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.join(F.broadcast(table), "_part").withColumn(name, inside + F.col("_offset") - 1).drop("_part", "_offset")


def extended_manifest(manifest: DataFrame, ids: DataFrame, key: str, number: str = "number") -> DataFrame:
    """Known ids keep their numbers; new ones continue after the largest, in order of the ids as text."""
    largest = manifest.agg(F.max(number)).first()[0] or 0
    fresh = ids.select(key).distinct().join(manifest, key, "left_anti").withColumn("_text", F.col(key).cast("string"))
    return manifest.select(key, number).unionByName(numbered(fresh, "_text", largest + 1, number).select(key, F.col(number).cast("long")))


def mapped_ids(df: DataFrame, id_map: DataFrame, key: str, mapped: str) -> DataFrame:
    """A left join on the id as text; rows without a mapping stay, with NULL."""
    return df.join(id_map.select(F.col(key).cast("string").alias("_key"), mapped), F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def aligned(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name, with NULL for missing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
