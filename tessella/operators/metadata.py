"""What a database holds, with small cells masked."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.values import small_masked
from tessella.operators.detect import shown_columns
from tessella.operators.privacy import MIN_CELL
from tessella.operators.stats import five_numbers

TOP = 15


def categorical_summary(df: DataFrame, columns: list[str], least: int = MIN_CELL, top: int = TOP) -> DataFrame:
    """(column_name, value, n_rows): the most frequent values of each column, all in one pass; small counts masked."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "column_name", "value").filter("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    kept = counts.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= top)
    return kept.select("column_name", "value", small_masked(F.col("n"), least).alias("n_rows"))


def numeric_summary(df: DataFrame, columns: list[str], least: int = MIN_CELL) -> DataFrame:
    """Count, mean and quartiles of each column; all masked where fewer than ``least`` values are known."""
    plain = five_numbers(df, columns)
    shown = lambda c: F.when(F.col("n_values") >= least, F.col(c)).alias(c)
    return plain.select("column_name", small_masked(F.col("n_values"), least).alias("n_values"), *map(shown, ("mean", "q1", "median", "q3")))


def table_metadata(df: DataFrame, least: int = MIN_CELL) -> dict:
    """Rows, columns, and summaries of the columns that may be shown."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    shown = shown_columns(df.columns)
    numbers = [c for c in shown if kinds[c] in ("integer", "long", "double", "float", "short", "byte") or kinds[c].startswith("decimal")]
    words = [c for c in shown if kinds[c] in ("string", "boolean")]
    out = {"n_rows": df.count(), "columns": kinds, "categorical": {}, "numeric": {}}
    for r in categorical_summary(df, words, least).collect() if words else []:
        out["categorical"].setdefault(r["column_name"], []).append([r["value"], r["n_rows"]])
    for r in numeric_summary(df, numbers, least).collect() if numbers else []:
        out["numeric"][r["column_name"]] = {k: v for k, v in r.asDict().items() if k != "column_name"}
    return out


def write_metadata(frames: dict[str, DataFrame], folder: str, least: int = MIN_CELL) -> None:
    """summary_stats.json and schema.md, through Spark's text writer, so the folder may be anywhere."""
    spark = next(iter(frames.values())).sparkSession
    stats = {name: table_metadata(df, least) for name, df in frames.items()}
    lines = [x for name, s in stats.items() for x in (f"## {name}", f"{s['n_rows']} rows", *(f"- {c}: {k}" for c, k in s["columns"].items()), "")]
    for name, text in (("summary_stats.json", json.dumps(stats, default=str)), ("schema.md", "\n".join(lines))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
