"""Model calls row by row: a client is any object with ``generate(prompt) -> str``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tessella.sources.extractions import json_array, json_object


class Client(Protocol):
    def generate(self, prompt: str) -> str: ...


@dataclass
class FakeClient:
    """Answers by rule; ``fail_on`` makes prompts that hold it fail."""

    answer: str = "Summary: {n} characters"
    fail_on: str | None = None
    calls: list[str] = field(default_factory=list)

    def generate(self, prompt: str) -> str:
        self.calls.append(prompt)
        if self.fail_on and self.fail_on in prompt:
            raise RuntimeError("no answer")
        return self.answer.replace("{n}", str(len(prompt)))


def asked(client: Client, prompt: str, read: Callable[[str], object], tries: int = 3) -> tuple[object, str | None]:
    """What ``read`` makes of the first answer that it can read, and the last trouble if there is none."""
    trouble = "no readable answer"
    for _ in range(max(1, tries)):
        try:
            if got := read(client.generate(prompt)):
                return got, None
        except Exception as e:  # whatever a client raises belongs to this call
            trouble = f"{type(e).__name__}: {e}"
    return None, trouble


def compressed(notes: DataFrame, text: str, client: Client) -> DataFrame:
    """``notes`` with summary and error; each note is its own call, blank ones none; an error stays with its row."""
    columns = notes.columns

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for t in pdf[text]:
                if t is None or not t.strip():
                    done.append((None, "empty_text"))
                    continue
                try:
                    done.append((client.generate(t), None))
                except Exception as e:  # whatever a client raises belongs to this row
                    done.append((None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(summary=pd.Series([a for a, _ in done], index=pdf.index, dtype=object), error=pd.Series([b for _, b in done], index=pdf.index, dtype=object))[[*columns, "summary", "error"]]

    schema = StructType([*notes.schema.fields, StructField("summary", StringType()), StructField("error", StringType())])
    return notes.mapInPandas(calls, schema)


def merged(state: dict[str, tuple[str, float, int]], found: dict, step: int, locked: set[str]) -> None:
    """Adds an answer's fields to ``state`` (value, confidence, step): the surer one wins, the earlier of equals; locked ones stay."""
    for name, got in found.items():
        value, sure = (got.get("value"), got.get("confidence")) if isinstance(got, dict) else (got, 0.0)
        try:
            sure = float(sure or 0)
        except (TypeError, ValueError):
            sure = 0.0
        if name not in locked and (name not in state or sure > state[name][1]):
            state[name] = (str(value), sure, step)


def folded(chunks: DataFrame, patient: str, order: str, text: str, client: Client, lock: float = 0.9) -> DataFrame:
    """(patient, field, value, confidence, pass): chunks of a patient in order; a field that is sure enough is not asked again.

    One patient's chunks are folded in one task; patients are independent. A chunk whose calls fail, or bring nothing readable, adds
    nothing.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict[str, tuple[str, float, int]] = {}
        for step, t in enumerate(pdf.sort_values(order)[text]):
            locked = {f for f, (_, c, _) in state.items() if c >= lock}
            found, _ = asked(client, f"known: {sorted(locked)}\n{t}", json_object)
            merged(state, found or {}, step, locked)
        rows = [(pdf[patient].iat[0], f, v, c, s) for f, (v, c, s) in sorted(state.items())]
        return pd.DataFrame(rows, columns=[patient, "field", "value", "confidence", "pass"])

    kind = chunks.schema[patient].dataType.simpleString()
    return chunks.groupBy(patient).applyInPandas(fold, f"`{patient}` {kind}, field string, value string, confidence double, pass int")


#: A shorter record names no diagnosis.
LEAST_RECORD = 20
DIAGNOSIS_COLUMNS = ("diagnosis", "site", "histology", "how")


def discovered(patients: DataFrame, patient: str, text: str, client: Client, reference: Callable[[str], str] = lambda _: "", tries: int = 5) -> DataFrame:
    """(patient, tumor_index, diagnosis, site, histology, how): the diagnoses of each record, in two steps.

    The first call names them in plain words; the second gives all of them codes, beside the lines that ``reference``
    holds for each. ``how``: coded; plain, where no codes came back; unknown, where the first step found nothing.
    """
    kind = patients.schema[patient].dataType.simpleString()

    def of(record: str | None) -> list[tuple]:
        plain = None
        if record and len(record.strip()) >= LEAST_RECORD:
            plain, _ = asked(client, f"Name every distinct diagnosis as a JSON array of texts.\n{record}", json_array, tries)
        names = [d.get("diagnosis", "") if isinstance(d, dict) else d for d in plain or []]
        names = [str(d).strip() for d in names if d and str(d).strip()]
        if not names:
            return [("unknown", None, None, "unknown")]
        lines = "\n".join(f"{i}. {d}\n{reference(d)}".rstrip() for i, d in enumerate(names))
        coded, _ = asked(client, f"Give each diagnosis a site and a histology code, as a JSON array of objects in this order.\n{lines}", json_array, tries)
        if not coded or len(coded) != len(names) or not all(isinstance(c, dict) for c in coded):
            return [(d, None, None, "plain") for d in names]
        text_of = lambda v: None if v is None else str(v)
        return [(d, text_of(c.get("site")), text_of(c.get("histology")), "coded") for d, c in zip(names, coded)]

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(who, i, *row) for who, record in zip(pdf[patient], pdf[text]) for i, row in enumerate(of(record))]
            yield pd.DataFrame(rows, columns=[patient, "tumor_index", *DIAGNOSIS_COLUMNS])

    return patients.select(patient, text).mapInPandas(calls, f"`{patient}` {kind}, tumor_index int, diagnosis string, site string, histology string, how string")


def extracted(requests: DataFrame, keys: list[str], prompt: str, client: Client, tries: int = 3) -> DataFrame:
    """(keys, field, value, confidence, error): one call for each request, a tumor and an ontology; an error is a row of its own."""

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own, question in zip(pdf[keys].itertuples(index=False, name=None), pdf[prompt]):
                got, trouble = asked(client, question or "", json_object, tries)
                if trouble:
                    rows.append((*own, None, None, None, trouble))
                for name, v in (got or {}).items():
                    value, sure = (v.get("value"), v.get("confidence")) if isinstance(v, dict) else (v, None)
                    rows.append((*own, name, None if value is None else str(value), None if sure is None else float(sure), None))
            yield pd.DataFrame(rows, columns=[*keys, "field", "value", "confidence", "error"])

    kinds = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys)
    return requests.select(*keys, prompt).mapInPandas(calls, f"{kinds}, field string, value string, confidence double, error string")


def answered(chunks: DataFrame, patient: str, order: str, text: str, questions: list[str], client: Client, batch: int = 10, tries: int = 3) -> DataFrame:
    """(patient, question, answer, n_failed): questions in batches over a patient's chunks in order, with the answers so far.

    A later chunk may correct an answer; one that brings nothing, or fails, leaves it. One patient's chunks are folded in
    one task; patients are independent.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        known, failed = dict.fromkeys(questions), 0
        for t in pdf.sort_values(order)[text]:
            for at in range(0, len(questions), batch):
                some = questions[at : at + batch]
                before = "\n".join(f"{q}: {known[q]}" for q in some if known[q] is not None)
                got, trouble = asked(client, f"Known so far:\n{before}\nQuestions:\n" + "\n".join(some) + f"\nRecord:\n{t}", json_object, tries)
                failed += trouble is not None
                by_key = {str(k).strip().lower(): v for k, v in (got or {}).items()}
                for q in some:
                    v = by_key.get(q.strip().lower())
                    if v is not None and str(v).strip():
                        known[q] = str(v)
        return pd.DataFrame([(pdf[patient].iat[0], q, a, failed) for q, a in known.items()], columns=[patient, "question", "answer", "n_failed"])

    kind = chunks.schema[patient].dataType.simpleString()
    return chunks.groupBy(patient).applyInPandas(fold, f"`{patient}` {kind}, question string, answer string, n_failed int")


def summarised(chunks: DataFrame, patient: str, order: str, text: str, client: Client, tries: int = 3) -> DataFrame:
    """(patient, summary, n_failed): one running summary over a patient's chunks in order; a failed call keeps the one before."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        summary, failed = None, 0
        for t in pdf.sort_values(order)[text]:
            prompt = f"Write a clinical summary of this record.\n{t}" if summary is None else f"Bring the summary up to date.\nSummary:\n{summary}\nNext part:\n{t}"
            got, trouble = asked(client, prompt, str.strip, tries)
            failed += trouble is not None
            summary = got or summary
        return pd.DataFrame([(pdf[patient].iat[0], summary, failed)], columns=[patient, "summary", "n_failed"])

    kind = chunks.schema[patient].dataType.simpleString()
    return chunks.groupBy(patient).applyInPandas(fold, f"`{patient}` {kind}, summary string, n_failed int")
