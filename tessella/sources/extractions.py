"""Extraction results as JSON in several layouts, consolidated to long rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names under which a category may stand.
ALIASES = {
    "patient": ("patient", "patient_level", "patient_level_data", "patient_data", "patient_records"),
    "cancer_diagnosis": ("cancer_diagnosis", "cancer_diagnoses", "cancer_diagnosis_records", "diagnosis", "diagnoses"),
    "regimen": ("regimen", "regimens", "regimen_records", "treatment_regimens", "treatment_regimen"),
    "medical_oncologist_assessment": ("medical_oncologist_assessment", "medical_oncologist_assessments", "medical_oncologist_assessment_records"),
}
SCHEMA = "patient_id string, ontology string, category string, tumor_index int, instance int, field string, value string"


def category_of(name: str) -> str | None:
    return next((c for c, names in ALIASES.items() if name in names), None)


def _bare(value):
    """A value without its wrapper; lists joined, other objects as JSON."""
    if isinstance(value, dict) and "value" in value:
        value = value["value"]
    if isinstance(value, list):
        return "; ".join(str(_bare(v)) for v in value)
    return value if value is None or isinstance(value, str) else json.dumps(value)


def consolidated_rows(text: str, stem: str, category_by_field: dict[str, str]) -> Iterator[tuple]:
    """Long rows of one document; a broken document has none."""
    try:
        data = json.loads(text, strict=False)
    except ValueError:
        return
    if not isinstance(data, dict):
        return
    who, ontology = str(data.get("patient_id", stem)), str(data.get("ontology", data.get("ontology_id", "unknown")))
    if isinstance(data.get("categories"), dict):
        found = list(data["categories"].items())
    elif isinstance(data.get("records"), dict):
        found = [(category_of(k) or k, v) for k, v in data["records"].items()]
    elif isinstance(data.get("results"), dict):
        by: dict[str, dict] = {}
        for name, value in data["results"].items():
            by.setdefault(category_by_field.get(name, "other"), {})[name] = value
        found = list(by.items())
    else:
        found = [(c, v) for k, v in data.items() if (c := category_of(k))]
    for category, content in found:
        # A list stays a list of diagnoses or instances even if it holds one: its index is kept.
        many = content if isinstance(content, list) else [content]
        for i, item in enumerate(many):
            if isinstance(item, dict):
                tumor = item.get("tumor_index", i if isinstance(content, list) else -1)
                for name, value in item.items():
                    if name != "tumor_index":
                        yield who, ontology, category, _index(tumor), i, name, _bare(value)


def _index(tumor) -> int:
    """A tumour's number; -1 where it is missing or no whole number."""
    try:
        return int(tumor)
    except (TypeError, ValueError, OverflowError):
        return -1


def consolidate(documents: DataFrame, category_by_field: dict[str, str] | None = None) -> DataFrame:
    """Long rows of documents (path, text); the layouts differ in shape, which no one schema reads."""
    by_field = category_by_field or {}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [r for path, text in zip(pdf["path"], pdf["text"]) for r in consolidated_rows(text or "", str(path).rsplit("/", 1)[-1].rsplit(".", 1)[0], by_field)]
            yield pd.DataFrame(out, columns=["patient_id", "ontology", "category", "tumor_index", "instance", "field", "value"])

    return documents.select("path", "text").mapInPandas(rows, SCHEMA)


def category_table(long: DataFrame, category: str, fields: list[str]) -> DataFrame:
    """One category as a wide table; fields without any value are left out by the caller's list."""
    keys = ["patient_id", "ontology", "tumor_index", "instance"]
    return long.filter(F.col("category") == category).groupBy(*keys).pivot("field", fields).agg(F.first("value"))


def json_object(text: str) -> dict | None:
    """The object in a model's answer: code fences and one-element lists are seen through."""
    for piece in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            got = json.loads(piece.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip(), strict=False)
        except ValueError:
            continue
        if isinstance(got, list) and len(got) == 1:
            got = got[0]
        if isinstance(got, dict):
            return got
    return None


def json_array(text: str) -> list:
    for a, b in (("[", "]"), ("{", "}")):
        try:
            got = json.loads(text[text.find(a) : text.rfind(b) + 1], strict=False)
        except ValueError:
            continue
        if isinstance(got, list):
            return got
        if isinstance(got, dict):
            inner = [v for v in got.values() if isinstance(v, list)]
            return inner[0] if len(got) == 1 and inner else [got]
    return []
