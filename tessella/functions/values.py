"""Dates, numbers, hashes and confidences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text

#: Formats of registry dates, tried in this order.
DATE_FORMATS = (("yyyyMMdd", r"^\d{8}$"), ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("yyyy", r"^\d{4}$"))


def coerced_date(c: Column) -> Column:
    """Bad values become NULL, whatever the ANSI mode."""
    return F.try_to_timestamp(c).cast("date")


def mixed_date(c: Column) -> Column:
    value = F.trim(c)
    return F.coalesce(*(F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(form))) for form, shape in DATE_FORMATS)).cast("date")


def years_fractional(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400e6 * 365.25)


def years_whole_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later.cast("date"), earlier.cast("date")) / F.lit(365.25)


def stable_index(size: int, *parts: Column) -> Column:
    """SHA-256 of the parts, joined by double bars: its first 16 hex digits modulo ``size``."""
    digest = F.sha2(F.concat_ws("||", *parts), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(size)).cast("int")


def stable_shift(days: int, seed: Column, key: Column) -> Column:
    """A number of days from -days to days that depends on seed and key alone."""
    if days < 0:
        raise ValueError("the range of a date shift cannot be negative")
    return stable_index(2 * days + 1, seed, key, F.lit("date_shift")) - F.lit(days) if days else F.lit(0)


def shifted_date(c: Column, days: Column) -> Column:
    """yyyy-MM-dd moved by days; what is no date stays as it is."""
    return F.coalesce(F.date_format(F.date_add(coerced_date(c), days), "yyyy-MM-dd"), c)


def capped_age(c: Column, bound: int = 89) -> Column:
    """Over the bound as ``90+``; whole numbers without a decimal point; other text with its age mentions capped."""
    number = c.try_cast("double")
    shown = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    return F.when(number > bound, f"{bound + 1}+").when(number.isNotNull(), shown).otherwise(text.cap_age_mentions(c.cast("string")))


def numeric(c: Column) -> Column:
    return c.try_cast("double")


def small_masked(c: Column, least: int) -> Column:
    """Counts below ``least`` as text; NULL stays."""
    return F.when(c < least, f"<{least}").otherwise(c.cast("string"))


def combined_confidence(model: Column, resolution: Column) -> Column:
    return F.round(F.when(resolution > 0, F.least(model, resolution)).otherwise(model * 0.5), 4)


def triage(field: Column, confidence: Column, critical: list[str], required: list[str]) -> Column:
    """CRITICAL, HIGH, LOW, or NULL where no review is needed; no confidence counts as none at all."""
    sure = F.coalesce(confidence, F.lit(0.0))
    return F.when(field.isin(*critical) & (sure < 0.9), "CRITICAL").when(field.isin(*required) & (sure < 0.7), "HIGH").when(sure < 0.5, "LOW")


def unwrapped(json: Column, name: str) -> Column:
    """A field of a JSON object, or its ``value`` if the field is an object."""
    return F.coalesce(F.get_json_object(json, f"$.{name}.value"), F.get_json_object(json, f"$.{name}"))


TRANSFORMS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "strip": F.trim,
    "to_string": lambda c: c.cast("string"),
    "to_date": lambda c: F.date_format(coerced_date(c), "yyyy-MM-dd"),
    "to_numeric": numeric,
}
