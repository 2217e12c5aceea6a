"""Text functions as column expressions; each stays inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers in clinical text, in the order in which they are redacted.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
ADDRESS = (
    r"(?i)\b\d{1,6}\s+[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+){0,5}\s+"
    r"(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|court|ct)\b"
)
MRN = r"(?i)\b(?:MRN|medical record(?: number)?|med rec)(?:\s*[:#]\s*|\s+)(?!MRN\d{6}\b)[A-Za-z0-9-]{4,}\b"
HONORIFIC = r"\b(?:Mr|Ms|Mrs|Miss)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"
AGES = (
    (r"(?i)\b(?:9[0-9]|1[0-9]{2})[- ]year[- ]old\b", "90+ year-old"),
    (r"(?i)\b(?:9[0-9]|1[0-9]{2})\s*(?:years?\s*old|yo|y/o)\b", "90+ years old"),
    (r"(?i)\bage\s+(?:9[0-9]|1[0-9]{2})\b", "age 90+"),
)
NULL_WORDS = ("", "nan", "none", "nat")
TUMOR_WORDS = r"(?i)\b(cancer|carcinoma|tumor|tumour|neoplasm|malignancy|malignant)\b"


def clean_scalar(c: Column) -> Column:
    """Trimmed; words that mean nothing become NULL."""
    trimmed = F.trim(c)
    return F.when(~F.lower(trimmed).isin(*NULL_WORDS), trimmed)


def value_map(c: Column, values: dict[str, str]) -> Column:
    """Recode with fall-through."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c) if pairs else c


def table_name(category: Column) -> Column:
    """A category as a table name."""
    name = F.regexp_replace(F.lower(F.trim(category)), "^cancer_", "")
    name = F.regexp_replace(name, "_therapy_regimen|_therapy", "")
    name = F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")
    name = F.when(name.rlike(r"^\p{N}"), F.concat(F.lit("t_"), name)).otherwise(name)
    return F.when(name == "", "unknown").otherwise(name)


def column_name(name: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def redact_contacts(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), ((EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (SSN, "[SSN]"), (ADDRESS, "[ADDRESS]")), c)


def redact_mrns(c: Column) -> Column:
    return F.regexp_replace(c, MRN, "[MRN]")


def cap_age_mentions(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], F.lit(p[1])), AGES, c)


def needs_review(c: Column, patterns=(EMAIL, PHONE, SSN, ADDRESS, MRN, HONORIFIC)) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns)), F.lit(False))


def first_keyword(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """The label of the first pattern that matches, in the given order."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(pairs):
        out = F.when(c.rlike(pattern), label).otherwise(out)
    return out


def keywords_found(c: Column, words: list[str]) -> Column:
    """The listed words that stand in the text as words, case-insensitively, in list order."""
    found = F.array(*(F.when(c.rlike(rf"(?i)\b{word}\b"), word) for word in words))
    return F.array_compact(found)


def accessions(c: Column) -> Column:
    """Distinct GEO series accessions, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(GSE\d{4,8})"), 1))


# What ids of data repositories look like; of two forms, those of the first come first.
REPOSITORIES = {
    "gse": (r"(GSE\d{4,8})",),
    "zenodo": (r"zenodo\.org/record[s]?/(\d+)", r"10\.5281/zenodo\.(\d+)"),
    "figshare": (r"figshare\.com/articles?/[^/]+/(\d+)", r"10\.\d+/m9\.figshare\.(\d+)"),
    "dryad": (r"(10\.5061/dryad\.\w+)",),
}


def repository_ids(c: Column) -> Column:
    """A struct of arrays: the distinct ids of each data repository that a text names, form by form in order of appearance."""
    of = lambda forms: F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(form), 1) for form in forms)))
    return F.struct(*(of(forms).alias(name) for name, forms in REPOSITORIES.items()))


def names_data(ids: Column, supplements: Column | None = None) -> Column:
    """Whether a paper shows any sign of data: an id of a repository, or a supplement."""
    found = sum((F.size(ids[name]) for name in REPOSITORIES), F.lit(0)) > 0
    return found if supplements is None else found | (F.size(supplements) > 0)


def summary(c: Column) -> Column:
    """A model's answer without code fences and without a leading ``Summary:``."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"(?s)\A```[^\n]*\n|\n```\s*\z", ""))
    return F.trim(F.regexp_replace(bare, r"(?i)\A(?:clinical summary|summary):", ""))


def tumor_text(c: Column) -> Column:
    """A plain-language diagnosis without the words that every diagnosis has."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), TUMOR_WORDS, ""), r"\s+", " "))


def middle_cut(c: Column, size: int, marker: str = " ... ") -> Column:
    """Both ends of a text longer than ``size``."""
    half = size // 2
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, half), F.lit(marker), F.substr(c, F.length(c) - half + 1, F.lit(half)))).otherwise(c)


def padded(c: Column, size: int) -> Column:
    """Left-aligned in ``size`` characters, cut if longer."""
    return F.rpad(F.coalesce(c, F.lit("")), size, " ")


def event_tags(c: Column) -> Column:
    """``<type>text`` up to the next ``<``, as array<struct<type, text>>."""
    kinds = F.regexp_extract_all(c, F.lit(r"<([A-Za-z_]+)>([^<]*)"), F.lit(1))
    texts = F.regexp_extract_all(c, F.lit(r"<([A-Za-z_]+)>([^<]*)"), F.lit(2))
    return F.transform(F.arrays_zip(kinds.alias("type"), texts.alias("text")), lambda e: F.struct(e["type"].alias("type"), F.trim(e["text"], F.lit(" \t\r\n")).alias("text")))
