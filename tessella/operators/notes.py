"""Notes and extraction state: boundaries, batches, answers by question, perturbed drug names, assembled tables."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARACTERS_A_TOKEN = 4
PATIENT_FIELDS_LEVEL = -1


def pieces_at_boundaries(text: str, size: int, overlap: int = 0, marker: str = "\n--- ", reach: int = 2000) -> list[str]:
    """Pieces of at most ``size`` characters; an end moves back to the last marker within reach; neighbours overlap."""
    if not text:
        return []
    if size <= 0:
        return [text]
    # Ends are looked up among all places of the marker, found once.
    marks = [m.start() for m in re.finditer(f"(?={re.escape(marker)})", text)]

    def end_of(start: int) -> int:
        hard = start + size
        if hard >= len(text):
            return len(text)
        k = bisect.bisect_right(marks, hard - len(marker)) - 1
        return marks[k] if k >= 0 and marks[k] > start and marks[k] >= hard - reach else hard

    ends = [(0, end_of(0))]
    while ends[-1][1] < len(text):
        begin = max(ends[-1][0] + 1, ends[-1][1] - overlap)
        ends.append((begin, end_of(begin)))
    return [text[a:b] for a, b in ends]


def chunked_notes(notes: DataFrame, text: str, size: int, overlap: int, by_tokens: bool = False, marker: str = "\n--- ", reach: int = 2000) -> DataFrame:
    """``notes`` with chunk (from 0) and piece; sizes in characters, or in tokens of about four characters.

    Where an end falls depends on the end before, which no column expression says; one Arrow pass does.
    """
    factor = CHARACTERS_A_TOKEN if by_tokens else 1

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pieces_at_boundaries(t or "", size * factor, overlap * factor, marker, reach) for t in texts], dtype=object)

    return notes.select("*", F.posexplode(F.pandas_udf(cut, "array<string>")(text)).alias("chunk", "piece"))


def batches(df: DataFrame, place: str, size: int, name: str = "batch") -> DataFrame:
    """Rows at places from 0 in batches of ``size``; size 0 or less: one batch."""
    return df.withColumn(name, F.floor(F.col(place) / size).cast("int") if size > 0 else F.lit(0))


def answers_by_question(answers: DataFrame, questions: DataFrame, key: str = "key", question: str = "question") -> DataFrame:
    """``answers`` (key, ...) with the question each key means: the same text, else in any case, else one inside the other.

    Questions are a form's: a short list, checked to be one before it is broadcast.
    """
    if questions.limit(2001).count() > 2000:
        raise ValueError("more than 2000 questions")
    k, q = F.lower(key), F.lower("_q")
    tier = F.when(F.col(key) == F.col("_q"), 0).when(k == q, 1).when(F.contains(k, q) | F.contains(q, k), 2)
    asked = questions.select(F.col(question).alias("_q"), F.col("place").alias("_place") if "place" in questions.columns else F.lit(0).alias("_place"))
    pairs = answers.filter(~F.col(key).startswith("_")).join(F.broadcast(asked), F.contains(k, q) | F.contains(q, k))
    best = F.min_by("_q", F.struct(tier, "_place", "_q"))
    rest = [c for c in answers.columns if c != key]
    return pairs.groupBy(key, *rest).agg(best.alias(question))


def without_reasoning(c: Column, marker: str = "</think>") -> Column:
    """What follows the last reasoning mark; of that, the last fenced block if there is one."""
    after = F.trim(F.substring_index(c, marker, -1))
    fenced = F.regexp_extract_all(after, F.lit(r"(?s)```(?:[a-z]*)\n(.*?)\n?```"), F.lit(1))
    return F.when(F.size(fenced) > 0, F.element_at(fenced, -1)).otherwise(after)


def perturbed_drugs(docs: DataFrame, key: str, text: str, alternatives: dict[str, list[str]], share: float = 0.3, seed: int = 0) -> DataFrame:
    """In about ``share`` of the documents, each drug name becomes one of its alternatives, chosen by the hash of the document and place."""
    names = sorted((n for n, a in alternatives.items() if a), key=lambda n: (-len(n), n))
    pattern = re.compile(rf"\b({'|'.join(map(re.escape, names))})\b", re.I) if names else None
    by_name = {n.lower(): a for n, a in alternatives.items()}

    def change(batches_: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hashes in batches_:
            yield pd.Series([pattern.sub(lambda m, h=h: by_name[m[0].lower()][(h + m.start()) % len(by_name[m[0].lower()])], t) if t else t for t, h in zip(texts, hashes)], dtype=object)

    if not names:
        return docs
    drawn = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    changed = F.pandas_udf(change, "string")(text, F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(1 << 31)))
    return docs.withColumn(text, F.when(drawn, changed).otherwise(F.col(text)))


def registry_values(results: DataFrame, patient: str = "patient_id", field: str = "field", tumor: str = "tumor_index") -> DataFrame:
    """One value for each patient and field: tumor 0, else the lowest tumor, else the patient level."""
    rank = F.when(F.col(tumor) == PATIENT_FIELDS_LEVEL, 1 << 30).otherwise(F.col(tumor))
    return results.groupBy(patient, field).agg(F.min_by("value", rank).alias("value"))


def state_rows(states: DataFrame, patient: str = "patient_id", state: str = "state") -> DataFrame:
    """Long rows of final states: a map of field to values, several of them joined."""
    return states.select(patient, F.explode(state).alias("field", "values")).select(patient, "field", F.array_join("values", "; ").alias("value"))


def assembled(documents: DataFrame, tables: str, name: str, schema: list[str]) -> DataFrame:
    """The rows of one synthetic table from per-patient documents whose ``tables`` is a map of name to JSON rows; schema columns, then extras as JSON."""
    rows = documents.select("patient_id", F.explode(F.try_element_at(F.col(tables), F.lit(name))).alias("row"))
    return rows.select("patient_id", *(F.get_json_object("row", f"$.{c}").alias(c) for c in schema if c != "patient_id"), F.col("row").alias("extras"))


def instance_rows(a: DataFrame, b: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Codes of ``b`` beside rows of ``a``: by index where both have it, rows of either side kept."""
    return a.join(b, [*keys, index], "full")


def merged_codes(plain: DataFrame, coded: DataFrame, key: str, index: str, place: str, codes: list[str]) -> DataFrame:
    """``plain`` with the codes of ``coded``: matched by index within a key, and where no index fits by place."""
    by_index = coded.filter(F.col(index).isNotNull()).select(key, index, F.struct(*codes).alias("_i"))
    by_place = coded.select(key, F.col(place).alias("_p"), F.struct(*codes).alias("_q"))
    joined = plain.join(by_index, [key, index], "left").join(by_place.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col(place) == F.col("_p")), "left")
    found = F.coalesce("_i", "_q")
    return joined.select(*plain.columns, *(found[c].alias(c) for c in codes))


def snippets(docs: DataFrame, key: str, text: str, pattern: str, around: int = 60) -> DataFrame:
    """(key, snippet): the first match in each document that has one, with its surroundings."""
    return docs.filter(F.col(text).rlike(pattern)).select(key, F.regexp_extract(text, rf"(?s)(.{{0,{around}}}(?:{pattern}).{{0,{around}}})", 1).alias("snippet"))


def contradictions(answers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n_answers, n_different, answers): where answers to one question differ, blanks and case aside."""
    said = F.lower(F.trim(F.col(value).cast("string")))
    counts = answers.filter(said != "").groupBy(*keys, said.alias("_said")).agg(F.count("*").alias("_n"))
    groups = counts.groupBy(*keys).agg(F.sum("_n").alias("n_answers"), F.count("*").alias("n_different"), F.array_join(F.array_sort(F.collect_list("_said")), "; ").alias("answers"))
    return groups.filter("n_different > 1")
