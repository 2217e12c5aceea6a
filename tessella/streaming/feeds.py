"""Structured Streaming counterparts of the batch rules; each is exact on a bounded replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(stream: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """Update mode: the last record of each key."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, order)).alias("last")).select(*keys, "last.*")


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Records no further apart than the gap, as one row, once the watermark has passed."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(key, F.session_window(at, gap).alias("session")).agg(F.count("*").alias("n_events")).select(
        key, F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "n_events"
    )


def windowed_counts(stream: DataFrame, at: str, by: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    frame = F.window(at, width, slide) if slide else F.window(at, width)
    return marked.groupBy(frame.alias("frame"), by).agg(F.count("*").alias("n_events")).select(F.col("frame.start").alias("started"), by, "n_events")


def running_state(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Update mode: for each key, records folded so far and the running total, kept as state."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n_events": [n], "total": [total]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n_events long, total double", "n long, total double", "update", "NoTimeout")


def append_audit(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Audit records appended as JSON lines, each once."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
