"""Language identification: the family first, then duels of linear SVMs between the languages of the family.

Features are square roots of the shares of hashed character 1- to 3-grams of the whole text (unit length).
A one-versus-rest linear SVM picks the language family; one linear SVM for each pair of languages inside that
family then votes. Text and labels are the only inputs of learning, text the only input of a prediction.

Defined cases: a null text, or one without a letter (Unicode category L: digits, emoji and lone marks are none), is
``und`` with score 0; without any labelled row every text is ``und``; beyond ``LANGUAGES`` labels, rarer ones aren't learned; ties go to the language that sorts first; a null
doc_id teaches nothing and isn't held out, its text is judged like any other; rows that share a doc_id are each judged by
their own text, and each teaches if the id isn't held out; extra columns pass through, and a column of the input named
like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.chargrams import gram_slots, has_letter, letter_codes
from tessella.llm.shared import held_out, share_by_hash

# Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
}
BITS = 12
ORDERS = (1, 2, 3)
#: Rows that a fit gathers: at most about this many a language, and in all.
ROWS_PER_LANGUAGE, ROWS_IN_ALL = 500, 4000
#: Languages that are learned at most, the most frequent ones; a label column may hold anything.
LANGUAGES = 200
SLOPE = 3.0


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs.split()), lang)


def features(text: str | None) -> np.ndarray | None:
    codes = letter_codes(text)
    if not has_letter(codes):
        return None
    counts = np.bincount(gram_slots(codes, ORDERS, BITS, False), minlength=1 << BITS)
    return np.sqrt(counts / counts.sum())


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 15) -> np.ndarray:
    """Dual coordinate descent for the squared hinge loss, classes weighted to balance; the bias is the last weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    lazy = 1 / (2 * cost * share)
    norm = (x * x).sum(axis=1) + lazy
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + lazy[i] * alpha[i]) / norm[i])
            w += (step - alpha[i]) * y[i] * x[i]
            alpha[i] = step
    return w


@dataclass
class LanguageModel:
    """Languages by family, one SVM for each family against the rest, one for each pair within a family."""

    langs: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None
    duels: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.langs:
            return "und", 0.0
        families = sorted(self.langs)
        margins = self.family_w[:, :-1] @ x + self.family_w[:, -1] if len(families) > 1 else np.zeros(1)
        best = int(np.argmax(margins))
        odds = np.exp(SLOPE * (margins - margins.max()))
        within = self.langs[families[best]]
        votes, sure = dict.fromkeys(within, 0), {a: [] for a in within}
        for (a, b), w in self.duels.items():
            if a in votes:
                p = 1 / (1 + np.exp(-SLOPE * (w[:-1] @ x + w[-1])))
                votes[a if p >= 0.5 else b] += 1
                sure[a].append(p)
                sure[b].append(1 - p)
        lang = min(within, key=lambda a: (-votes[a], -sum(sure[a]), a))
        return lang, float(odds[best] / odds.sum() * (np.mean(sure[lang]) if sure[lang] else 1.0))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, rows_in_all: int = ROWS_IN_ALL, languages: int = LANGUAGES) -> LanguageModel:
    """Fit on whole texts of a sample by hash, bounded by the three parameters, of the labelled rows that aren't held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
    every = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in every.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return LanguageModel()
    most = min(rows_per_language, max(1, rows_in_all // len(counts)))
    shares = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, most / n))))

    @F.pandas_udf("binary")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (x := features(t)) is None else x.astype(np.float32).tobytes() for t in texts], dtype=object)

    drawn = labelled.filter(F.col("lang").isin(*counts)).filter(share_by_hash("doc_id", 2, shares[F.col("lang")])).select("lang", counted("text").alias("x"), "doc_id")
    rows = sorted((r["lang"], r["doc_id"], bytes(r["x"])) for r in drawn.filter("x is not null").toLocalIterator())
    if not rows:
        return LanguageModel()
    lang = np.array([r[0] for r in rows])
    x = np.array([np.frombuffer(r[2], dtype=np.float32) for r in rows], dtype=np.float64)
    model = LanguageModel()
    for a in sorted(set(lang)):
        model.langs.setdefault(family_of(a), []).append(str(a))
    families = sorted(model.langs)
    if len(families) > 1:
        model.family_w = np.array([linear_svm(x, np.where(np.isin(lang, model.langs[f]), 1.0, -1.0)) for f in families])
    for within in model.langs.values():
        for i, a in enumerate(within):
            for b in within[i + 1 :]:
                pair = (lang == a) | (lang == b)
                model.duels[a, b] = linear_svm(x[pair], np.where(lang[pair] == a, 1.0, -1.0))
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text alone."""

    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"])

    # Not deterministic to the optimizer: a filter on the prediction then doesn't evaluate it twice.
    verdict = F.pandas_udf(judged, "lang_pred string, score double").asNondeterministic()
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "_verdict")]
    return docs.select(*(F.col(f"`{c}`") for c in kept), verdict("text").alias("_verdict")).select(
        *(F.col(f"`{c}`") for c in kept), F.col("_verdict.lang_pred").alias("lang_pred"), F.col("_verdict.score").alias("score")
    )


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict every row; held_out marks rows that taught nothing."""
    kept = docs.drop("held_out")
    return predict(kept, fit(docs)).withColumn("held_out", held_out())
