"""De-identification: column classes, stable identities, shifted dates, redacted text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.functions import text
from tessella.functions.values import capped_age, coerced_date, shifted_date, stable_index, stable_shift
from tessella.operators.cohort import extended_manifest

# Column names, and words in them, by what they hold.
PATIENT_IDS = (
    "patient_id", "patientid", "pat_id", "record_id", "subject_id", "subjectid", "person_id", "personid", "empi", "enterprise_id", "study_id", "participant_id", "case_id",
)
MRN_NAMES = ("mrn", "medical_record_number", "medicalrecordnumber", "medrecnum", "med_rec")
BIRTH_NAMES = ("dob", "date_of_birth", "birth_date", "birthdate", "patient_dob")
AGE_NAMES = ("age", "patient_age", "age_at_visit", "age_at_diagnosis")
FIRST_WORDS, LAST_WORDS, MIDDLE_WORDS = ("first", "given", "fname"), ("last", "family", "surname", "lname"), ("middle", "mname")
PERSON_NAMES = (
    "name", "patient_name", "full_name", "person_name", "first_name", "first_nm", "last_name", "last_nm", "middle_name", "middle_nm", "fname", "lname", "mname",
)
PERSON_WORDS = ("name", "patient", "person", "member", "subject")
NOT_PERSONS = (
    "biomarker", "cancer", "diagnosis", "disease", "drug", "facility", "gene", "histology", "hospital", "institution", "lab", "med", "medication", "procedure", "provider",
    "regimen", "test", "therapy", "tumor", "doctor", "physician",
)
IDENTIFIERS = (
    "phone", "mobile", "email", "ssn", "social_security", "address", "street", "city", "zip", "zipcode", "zip_code", "postal", "county", "fax", "insurance", "policy", "account",
    "acct", "accession",
)
STATE_NAMES = ("state", "patient_state", "address_state", "mailing_state")
TEXT_WORDS = (
    "text", "note", "notes", "comment", "comments", "evidence", "blurb", "summary", "narrative", "finding", "findings", "impression", "description", "reason",
)
#: Words of our own: network addresses, and times beside dates.
MORE_IDENTIFIERS = ("ip", "url")
DATE_WORDS = ("date", "dt", "datetime", "timestamp")
#: From so many characters on average, with spaces in half the values, a column of mostly different values is free text.
TEXT_LENGTH = 25
DATES = re.compile(r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
FIRST_NAMES = {"f": "Alda Brisa Celia Dagny Edda Flora Greta Hilde".split(), "m": "Anders Boris Casper Dario Emil Falk Gustav Henrik".split(), "": "Ari Blair Casey Devon Eden Finley Gray Harper".split()}
LAST_NAMES = "Abel Birk Corder Dahl Elster Farrow Gale Holm Ivers Jarl Keller Lund".split()


def classified(df: DataFrame, hints: dict[str, str] | None = None) -> dict[str, str]:
    """Each column's class: patient_id, mrn, name, birth_date, date, age, text, drop or keep.

    A name that says what a column holds decides; the values of all other columns are measured by one aggregate over
    all rows. ``hints``: classes by column, which go before all rules.
    """
    hints = {k.lower(): v for k, v in (hints or {}).items()}
    found = {c: hints.get(c.lower()) or class_by_name(c) for c in df.columns}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found |= {c: "date" for c, k in found.items() if k is None and kinds[c] in ("date", "timestamp", "timestamp_ntz")}
    return found | class_by_values(df, [c for c, k in found.items() if k is None])


def class_by_name(column: str) -> str | None:
    """The class that a column's name tells, if it does."""
    norm = re.sub("[^a-z0-9]+", "_", column.strip().lower()).strip("_")
    words = set(norm.split("_"))
    person = not words & set(NOT_PERSONS) and ("name" in words or words & {*FIRST_WORDS, *LAST_WORDS, *MIDDLE_WORDS} and words & set(PERSON_WORDS))
    rules = (
        ("patient_id", norm in PATIENT_IDS or {"patient", "id"} <= words),
        ("mrn", norm in MRN_NAMES or "mrn" in words),
        ("birth_date", norm in BIRTH_NAMES),
        ("age", norm in AGE_NAMES or norm.startswith("age_") or norm.endswith("_age")),
        ("name", norm in PERSON_NAMES or person),
        ("drop", norm in STATE_NAMES or norm in IDENTIFIERS or words & {*IDENTIFIERS, *MORE_IDENTIFIERS}),
        ("date", words & set(DATE_WORDS)),
        ("text", words & set(TEXT_WORDS)),
    )
    return next((kind for kind, fits in rules if fits), None)


def class_by_values(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """date, text, drop or keep, from shares of all non-blank values; one pass over the table."""
    if not columns:
        return {}
    measures = []
    for i, c in enumerate(columns):
        v = text.clean_scalar(F.col(f"`{c}`").cast("string"))
        measures += [
            F.count(v).alias(f"n{i}"), F.avg(F.length(v)).alias(f"length{i}"), F.avg(v.contains(" ").cast("int")).alias(f"spaced{i}"), F.approx_count_distinct(v).alias(f"distinct{i}"),
            F.avg(v.rlike(r"^(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})(?:[ T].*)?$").cast("int")).alias(f"dates{i}"),
            F.avg((v.rlike(text.EMAIL) | v.rlike(text.PHONE) | v.rlike(text.SSN)).cast("int")).alias(f"contacts{i}"),
        ]
    row = df.agg(*measures).first()

    def judged(i: int) -> str:
        n = row[f"n{i}"]
        if not n:
            return "keep"
        if row[f"dates{i}"] >= 0.8:
            return "date"
        # Different from one another: half of them, or fifty different ones in a long table.
        varied = row[f"distinct{i}"] >= 0.5 * min(n, 100)
        if row[f"length{i}"] >= TEXT_LENGTH and row[f"spaced{i}"] >= 0.5 and varied or row[f"length{i}"] > 60:
            return "text"
        return "drop" if row[f"contacts{i}"] >= 0.2 else "keep"

    return {c: judged(i) for i, c in enumerate(columns)}


def name_part(column: str) -> str:
    """first, last, middle or full: which part of a name a column holds."""
    words = set(re.sub("[^a-z0-9]+", "_", column.lower()).strip("_").split("_"))
    return next((part for part, marks in (("first", FIRST_WORDS), ("last", LAST_WORDS), ("middle", MIDDLE_WORDS)) if words & set(marks)), "full")


def identity_key(patient_id: Column | None, mrn: Column | None, *names: Column) -> Column:
    """The id, else ``mrn:`` and the MRN, else ``name:`` and the names, else one key for the file."""
    parts = []
    if patient_id is not None:
        parts.append(text.clean_scalar(patient_id.cast("string")))
    if mrn is not None:
        parts.append(F.concat(F.lit("mrn:"), text.clean_scalar(mrn.cast("string"))))
    if names:
        joined = F.concat_ws("|", *(text.clean_scalar(n) for n in names))
        parts.append(F.when(joined != "", F.concat(F.lit("name:"), joined)))
    return F.coalesce(*parts, F.lit("__file__"))


def identities(keys: DataFrame, salt: str, days: int, manifest: DataFrame | None = None) -> DataFrame:
    """(identity, number, patient_id, first_name, last_name, middle_name, shift) for keys (identity, sex); known numbers stay."""
    spark = keys.sparkSession
    known = manifest.select("identity", "number") if manifest is not None else spark.createDataFrame([], "identity string, number long")
    given = F.lower(F.trim("sex"))
    sex = keys.groupBy("identity").agg(F.min(F.when(given.isin("f", "female", "woman", "w"), "f").when(given.isin("m", "male", "man"), "m")).alias("sex"))
    numbered = extended_manifest(known, keys, "identity").join(sex, "identity", "left")
    pick = lambda pool, tag: F.get(F.array(*map(F.lit, pool)), stable_index(len(pool), F.lit(salt), F.col("identity"), F.lit(tag)))
    first = F.when(F.col("sex") == "f", pick(FIRST_NAMES["f"], "first")).when(F.col("sex") == "m", pick(FIRST_NAMES["m"], "first")).otherwise(pick(FIRST_NAMES[""], "first"))
    return numbered.select(
        "identity", "number", F.format_string("P%06d", F.col("number")).alias("patient_id"), first.alias("first_name"), pick(LAST_NAMES, "last").alias("last_name"),
        F.char(F.lit(65) + stable_index(26, F.lit(salt), F.col("identity"), F.lit("middle"))).alias("middle_name"),
        stable_shift(days, F.lit(salt), F.col("identity")).alias("shift"),
    )


def moved_date(found: str, days: int) -> str | None:
    """A date in ISO or US form, moved; None if it is none."""
    for form in ("%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%m/%d/%y", "%m-%d-%y"):
        try:
            return (datetime.strptime(found, form) + timedelta(days=days)).strftime("%Y-%m-%d")
        except (ValueError, OverflowError):
            continue
    return None


@F.pandas_udf(StringType())
def dates_moved(texts: pd.Series, days: pd.Series) -> pd.Series:
    """Dates inside texts, each by its row's days; a callback for each match has no column form."""
    return pd.Series([None if t is None else DATES.sub(lambda m, d=d: moved_date(m[0], int(d)) or m[0], t) for t, d in zip(texts, days)], dtype=object)


def literals_replaced(c: Column, literals: Column, by: Column | str) -> Column:
    """Each literal of an array, the longest first, as whole words in any case."""
    usable = F.array_sort(F.filter(literals, lambda x: F.length(x) >= 2), lambda a, b: F.length(b) - F.length(a))
    pattern = lambda x: F.concat(F.lit(r"(?i)(?<!\w)\Q"), x, F.lit(r"\E(?!\w)"))
    return F.aggregate(usable, c, lambda done, x: F.regexp_replace(done, pattern(x), F.lit(by) if isinstance(by, str) else by))


def deidentified(df: DataFrame, classes: dict[str, str], known: DataFrame, sex: str | None = None) -> DataFrame:
    """``df`` with each column treated by its class, through one join with the identities; and needs_review."""
    of = lambda kind: [c for c in df.columns if classes.get(c) == kind]
    ids, mrns, names, texts = of("patient_id"), of("mrn"), of("name"), of("text")
    key = identity_key(F.col(ids[0]) if ids else None, F.col(mrns[0]) if mrns else None, *(F.col(n) for n in names))
    joined = df.withColumn("_identity", key).join(known.withColumnsRenamed({c: f"_k_{c}" for c in known.columns}), F.col("_identity") == F.col("_k_identity"), "left")
    secrets = F.array_compact(F.array(*(F.col(c).cast("string") for c in ids + mrns + names))) if ids + mrns + names else None

    def clean(c: str) -> Column:
        out = text.redact_contacts(F.col(c))
        if secrets is not None:
            out = literals_replaced(out, secrets, F.col("_k_patient_id"))
        return text.cap_age_mentions(dates_moved(text.redact_mrns(out), F.coalesce("_k_shift", F.lit(0))))

    out = []
    for c in df.columns:
        kind = classes.get(c, "keep")
        if kind == "patient_id":
            out.append(F.col("_k_patient_id").alias(c))
        elif kind == "mrn":
            out.append(F.format_string("MRN%06d", F.col("_k_number")).alias(c))
        elif kind == "name":
            shown = {"first": F.col("_k_first_name"), "last": F.col("_k_last_name"), "middle": F.col("_k_middle_name")}
            out.append(shown.get(name_part(c), F.concat_ws(" ", "_k_first_name", "_k_last_name")).alias(c))
        elif kind == "date":
            out.append(shifted_date(F.col(c).cast("string"), F.col("_k_shift")).alias(c))
        elif kind == "age":
            out.append(capped_age(F.col(c).cast("string")).alias(c))
        elif kind == "text":
            out.append(clean(c).alias(c))
        elif kind == "keep":
            out.append(F.col(c))
    shown = joined.select(*out)
    review = [text.needs_review(F.col(c)) for c in texts]
    return shown.withColumn("needs_review", F.greatest(*review, F.lit(False)) if review else F.lit(False))


def years_since_birth(df: DataFrame, birth: str, dates: list[str]) -> DataFrame:
    """Each date as whole-day years since birth and a calendar year; dates and birth go."""
    out = df
    for c in dates:
        day = coerced_date(F.col(c).cast("string"))
        out = out.withColumn(f"{c}_years_since_birth", F.datediff(day, coerced_date(F.col(birth).cast("string"))) / 365.25).withColumn(f"{c}_year", F.year(day))
    return out.drop(birth, *dates)


def rewritten(df: DataFrame, column: str, flag: str, client: Callable[[str], str]) -> DataFrame:
    """Only flagged cells go through the client."""

    def calls(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, flags in batches:
            yield pd.Series([client(t) if f and t is not None else t for t, f in zip(texts, flags)], dtype=object)

    return df.withColumn(column, F.pandas_udf(calls, "string").asNondeterministic()(column, flag))


#: Characters of a value that a reviewer sees.
PREVIEW = 200


def review_queue(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column_name, preview): each value that still looks like it holds contact data, a record number or a name, for a human to read."""
    long = df.select(key, *(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).unpivot([key], columns, "column_name", "value")
    return long.filter(text.needs_review(F.col("value"))).select(key, "column_name", F.substring("value", 1, PREVIEW).alias("preview"))


def local_endpoint(url: str, allow_remote: bool = False) -> str:
    """Refuses model endpoints on other machines unless they are asked for."""
    if not allow_remote and urlparse(url).hostname not in ("localhost", "127.0.0.1", "::1"):
        raise PermissionError("a remote model endpoint needs an explicit opt-in")
    return url
