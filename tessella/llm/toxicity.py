"""Toxicity: a logistic character n-gram classifier on features scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram (3 to 6 characters, word ends included) anywhere in the
whole text. Each is scaled by the log ratio of its smoothed document shares among toxic and other texts; an L2
regularised logistic regression with balanced classes is fitted on the scaled features. The score 0.7 is then
placed at the cut of cross-fitted margins that costs least over all labelled rows that the sample stands for.

Defined cases: null and empty texts have no feature and get the score of the intercept; rows without a label, or
with a null doc_id, teach nothing; if either class is missing among the labels, every score is 0; of several
labels for a doc_id the highest counts; extra columns pass through, columns named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.chargrams import gram_slots, letter_codes
from tessella.llm.shared import held_out, share_by_hash, staged

BITS = 18
ORDERS = (3, 4, 5, 6)
#: About so many labelled documents of each class are gathered for a fit.
ROWS_PER_CLASS = 2000
#: Bytes of their features that the driver takes, about; of longer texts fewer are gathered.
FEATURE_BYTES = 200_000_000
THRESHOLD = 0.7
#: Features in fewer texts, or with a smaller absolute log-count ratio, are left out of the fit.
LEAST_TEXTS, LEAST_RATIO = 3, 0.3
PENALTY = 0.05
#: When the score 0.7 is placed, a clean text accused counts as so many toxic ones missed.
ACCUSED = 5
ROUNDS = 150


def slots(text: str | None) -> np.ndarray:
    return gram_slots(letter_codes(text), ORDERS, BITS, True)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float
    empty: bool = False

    def margin(self, text: str | None) -> float:
        found = slots(text)
        found = np.unique(found[self.weights[found] != 0])
        return float(self.weights[found].sum(dtype=np.float64)) + self.intercept

    def score(self, text: str | None) -> float:
        return 0.0 if self.empty else float(1 / (1 + np.exp(-np.clip(self.margin(text), -30, 30))))


def fit_rows(features: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by slot, already scaled by the log-count ratios, and the intercept; accelerated gradient descent."""
    size, n = 1 << BITS, len(features)
    index = np.concatenate(features)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in features])
    bad = np.bincount(index[toxic[row] == 1], minlength=size)
    good = np.bincount(index, minlength=size) - bad
    ratio = np.log((bad + 1) / (toxic.sum() + 2)) - np.log((good + 1) / ((1 - toxic).sum() + 2))
    used = (bad + good >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)
    keep = used[index]
    slot_of = np.cumsum(used) - 1
    column, row, m = slot_of[index[keep]], row[keep], int(used.sum())
    value = ratio[index[keep]]
    share = np.where(toxic == 1, n / (2 * toxic.sum()), n / (2 * (1 - toxic).sum()))
    u, step = np.ones(m), 1.0
    for _ in range(12):
        u = np.bincount(column, value * (np.bincount(row, value * u[column], n) * share / 4)[row], m)
        step = float(np.linalg.norm(u)) or 1.0
        u /= step
    step = 1.1 * step + PENALTY
    w = ahead = np.zeros(m)
    b = b_ahead = 0.0
    pace = 1.0
    for _ in range(ROUNDS):
        error = share * (1 / (1 + np.exp(-np.clip(np.bincount(row, value * ahead[column], n) + b_ahead, -30, 30))) - toxic)
        w_new = ahead - (np.bincount(column, value * error[row], m) + PENALTY * ahead) / step
        b_new = b_ahead - 4 * error.sum() / n
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, b_ahead = w_new + (pace - 1) / faster * (w_new - w), b_new + (pace - 1) / faster * (b_new - b)
        w, b, pace = w_new, b_new, faster
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = w * ratio[used]
    return weights, float(b)


def cheapest_cut(margins: np.ndarray, toxic: np.ndarray, stands_for: np.ndarray) -> float:
    """The margin from which texts are accused at the least cost, each row counting as often as it stands for."""
    order = np.argsort(margins, kind="stable")
    bad, times = toxic[order] == 1, stands_for[order]
    # A cut below position k misses the toxic ones before it and accuses the clean ones from it on.
    cost = np.concatenate([[0], np.cumsum(bad * times)]) + ACCUSED * np.concatenate([np.cumsum((~bad * times)[::-1])[::-1], [0]])
    k = int(np.argmin(cost[1:-1])) + 1
    return float((margins[order[k - 1]] + margins[order[k]]) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, feature_bytes: int = FEATURE_BYTES) -> ToxicityModel:
    """Fit on whole texts of a sample by hash of the labelled rows that aren't held out, bounded by the parameters."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), 0.0, True)
    share = F.when(F.col("toxic") == 1, min(1.0, rows_per_class / counts[1])).otherwise(min(1.0, rows_per_class / counts[0]))
    drawn = known.filter(share_by_hash("doc_id", 8, share))

    @F.pandas_udf("binary")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(slots(t)).astype(np.uint32).tobytes() for t in texts], dtype=object)

    # About 2 * rows_per_class ids, whatever the input: small by construction.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", present("text").alias("x"))
    rows = staged(rows, "features")
    held = rows.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    if held > feature_bytes:
        rows = rows.filter(share_by_hash("doc_id", 9, feature_bytes / held))
    got = sorted(((r["doc_id"], r["toxic"], bytes(r["x"])) for r in rows.toLocalIterator()), key=lambda r: r[0])
    features = [np.frombuffer(r[2], dtype=np.uint32) for r in got]
    toxic = np.array([r[1] for r in got], dtype=np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), 0.0, True)
    weights, intercept = fit_rows(features, toxic)
    fold = np.arange(len(got)) % 2
    margins = np.full(len(got), np.nan)
    for k in (0, 1):
        learn = np.flatnonzero(fold != k)
        if 0 < toxic[learn].sum() < len(learn):
            w, b = fit_rows([features[i] for i in learn], toxic[learn])
            for i in np.flatnonzero(fold == k):
                margins[i] = w[features[i]].sum(dtype=np.float64) + b
    if not np.isnan(margins).any():
        # A drawn row stands for as many labelled rows as its class had for each one drawn.
        stands_for = np.where(toxic == 1, counts[1] / toxic.sum(), counts[0] / (1 - toxic).sum())
        intercept += np.log(THRESHOLD / (1 - THRESHOLD)) - cheapest_cut(margins, toxic, stands_for)
    return ToxicityModel(weights, float(intercept))


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score and predicted (1 from 0.7), from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one array of 2**BITS floats, whatever the input

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(t) for t in batch], dtype=float)

    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    marked = docs.select(*(F.col(f"`{c}`") for c in kept), F.pandas_udf(scored, "double").asNondeterministic()("text").alias("score"))
    return marked.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit, then score every row; held_out marks rows that taught nothing."""
    return predict(docs.drop("held_out"), fit(docs, labels)).withColumn("held_out", held_out())
