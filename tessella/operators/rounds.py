"""Extraction in rounds over a patient's chunks, with a checkpoint after each round, and resuming.

Round r reads the r-th group of each patient's chunks on top of what round r - 1 knows. Every round is a table in a folder that
all tasks share. A patient is asked in a round only if it has chunks there, the round before is done and this one isn't:
an anti-join against the checkpoints tells. So a run that stops anywhere, or patients whose calls fail, go on where they
were when it is started again, and nothing is asked twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.models import Client, asked, merged
from tessella.sources.extractions import json_object

STATE = "map<string, struct<value: string, confidence: double, step: int>>"


def checkpoints(spark: SparkSession, folder: str, patient: str, kind: str) -> DataFrame:
    """(patient, round, state) of all rounds done; a patient's round counts once."""
    schema = f"`{patient}` {kind}, state string, round int"
    try:
        rows = spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.groupBy(patient, "round").agg(F.min("state").alias("state"))


def numbered_rounds(chunks: DataFrame, patient: str, order: str, text: str, a_round: int) -> DataFrame:
    """(patient, round, chunks): a patient's chunks in order, ``a_round`` of them together."""
    place = F.row_number().over(Window.partitionBy(patient).orderBy(order)) - 1
    rows = chunks.filter(F.col(patient).isNotNull()).select(patient, place.alias("step"), F.col(text).alias("t"))
    parts = rows.groupBy(patient, F.floor(F.col("step") / a_round).cast("int").alias("round")).agg(F.array_sort(F.collect_list(F.struct("step", "t"))).alias("chunks"))
    return parts


def extract(chunks: DataFrame, patient: str, order: str, text: str, client: Client, folder: str, a_round: int = 5, lock: float = 0.9, most: int | None = None) -> DataFrame:
    """The checkpoints after the rounds that are open (at most up to round ``most``) have run.

    ``folder`` is shared by driver and executors. A patient whose calls fail or bring nothing readable has no checkpoint of that round.
    """
    spark, kind = chunks.sparkSession, chunks.schema[patient].dataType.simpleString()
    parts = numbered_rounds(chunks, patient, order, text, a_round)
    last = parts.agg(F.max("round")).first()[0]

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for who, before, given in zip(pdf[patient], pdf["state"], pdf["chunks"]):
                state = {k: tuple(v) for k, v in json.loads(before or "{}").items()}
                for chunk in given:
                    locked = {f for f, (_, c, _) in state.items() if c >= lock}
                    found, trouble = asked(client, f"known: {sorted(locked)}\n{chunk['t']}", json_object)
                    if trouble:
                        break
                    merged(state, found, int(chunk["step"]), locked)
                else:
                    out.append((who, json.dumps(dict(sorted(state.items())))))
            yield pd.DataFrame(out, columns=[patient, "state"])

    for r in range(0 if last is None else (last if most is None else min(last, most)) + 1):
        done = checkpoints(spark, folder, patient, kind)
        open_ = parts.filter(F.col("round") == r).join(done.filter(F.col("round") == r), patient, "left_anti")
        if r:
            open_ = open_.join(done.filter(F.col("round") == r - 1).select(patient, "state"), patient)
        else:
            open_ = open_.withColumn("state", F.lit(None).cast("string"))
        asking = open_.select(patient, "state", "chunks").mapInPandas(calls, f"`{patient}` {kind}, state string")
        asking.write.mode("append").parquet(f"{folder}/round={r}")
    return checkpoints(spark, folder, patient, kind)


def final_rows(done: DataFrame, patient: str) -> DataFrame:
    """(patient, rounds, field, value, confidence, step): what each patient's last round knows, one row a field."""
    latest = done.groupBy(patient).agg((F.max("round") + 1).alias("rounds"), F.max_by("state", "round").alias("state"))
    fields = F.from_json("state", "map<string, array<string>>")
    rows = latest.select(patient, "rounds", F.explode(fields).alias("field", "v"))
    return rows.select(patient, "rounds", "field", F.col("v")[0].alias("value"), F.col("v")[1].cast("double").alias("confidence"), F.col("v")[2].cast("int").alias("step"))
