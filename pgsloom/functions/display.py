"""Column functions of units, labels and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit conversions as (factor, offset): value * factor + offset.
CONVERSIONS = {
    ("kg", "lbs"): (2.20462, 0.0), ("kg", "st"): (0.157473, 0.0), ("lbs", "kg"): (1 / 2.20462, 0.0), ("lbs", "st"): (1 / 14, 0.0),
    ("cm", "in"): (1 / 2.54, 0.0), ("cm", "ft"): (1 / 30.48, 0.0), ("in", "cm"): (2.54, 0.0), ("in", "ft"): (1 / 12, 0.0),
    ("mg/dL", "mmol/L"): (1 / 18.0182, 0.0), ("mmol/L", "mg/dL"): (18.0182, 0.0), ("°C", "°F"): (9 / 5, 32.0), ("°F", "°C"): (5 / 9, -160 / 9),
}
#: Units that a locale prefers.
LOCALES = {"en-US": {"weight": "lbs", "height": "in", "cholesterol": "mg/dL", "temperature": "°F"}, "en-GB": {"weight": "st", "height": "cm", "cholesterol": "mmol/L", "temperature": "°C"}, "default": {"weight": "kg", "height": "cm", "cholesterol": "mmol/L", "temperature": "°C"}}
KINDS = {"kg": "weight", "lbs": "weight", "st": "weight", "cm": "height", "in": "height", "ft": "height", "mg/dL": "cholesterol", "mmol/L": "cholesterol", "°C": "temperature", "°F": "temperature"}


#: Units of measured traits.
TRAIT_UNITS = {
    "EFO_0007777": "kcal/day", "EFO_0006335": "mmHg", "EFO_0004465": "mmHg", "EFO_0004612": "mg/dL", "EFO_0004611": "mg/dL", "EFO_0004574": "mg/dL", "EFO_0004530": "mg/dL", "EFO_0004458": "mg/L", "EFO_0004541": "%",
    "EFO_0004340": "kg/m²", "EFO_0004338": "kg", "EFO_0004713": "%", "EFO_0004462": "ms", "EFO_0005278": "units", "EFO_0005106": "%", "EFO_0004703": "years", "OBA_1001005": "μmol/L", "EFO_0005035": "mm³", "EFO_0009395": "mm³", "OBA_2045237": "mm³",
}


#: How a unit is written and with how many decimals.
FORMATS = {
    "mg/dL": ("mg/dL", 1), "mg/L": ("mg/L", 2), "ng/mL": ("ng/mL", 2), "pg/mL": ("pg/mL", 1), "μmol/L": ("μmol/L", 1), "μg/dL": ("μg/dL", 1), "mEq/L": ("mEq/L", 1), "mIU/L": ("mIU/L", 2), "U/L": ("U/L", 0), "mmHg": ("mmHg", 0),
    "kg": ("kg", 1), "g/cm²": ("g/cm²", 3), "mm³": ("mm³", 0), "fL": ("fL", 1), "liters": ("L", 2), "mL/min/1.73m²": ("mL/min/1.73m²", 0), "picograms": ("pg", 1), "beats/min": ("bpm", 0), "milliseconds": ("ms", 0), "years": ("years", 1),
    "kcal/day": ("kcal/day", 0), "g/day": ("g/day", 1), "drinks/week": ("drinks/week", 1), "thousand/μL": ("×10³/μL", 2), "cells/μL": ("cells/μL", 0), "%": ("%", 1), "ratio": ("", 2), "BMI": ("kg/m²", 1), "cm or inches": ("cm", 1), "mm or %": ("mm", 1),
    "score": ("", 1), "pattern scale": ("", 1), "grade": ("", 1), "count": ("", 0),
}


def value_text(value: Column, unit: Column) -> Column:
    """A value as it is shown: decimals by unit, thousands set apart, the unit behind it; null for units that are not shown."""
    out = F.lit(None).cast("string")
    for name, (shown, digits) in FORMATS.items():
        behind = F.lit("" if not shown else shown if shown == "%" else f" {shown}")
        out = F.when(unit == name, F.concat(F.format_number(value, digits), behind)).otherwise(out)
    return out


def trait_unit(trait_id: Column) -> Column:
    units = F.create_map(*[F.lit(x) for kv in TRAIT_UNITS.items() for x in kv])
    return F.coalesce(F.element_at(units, trait_id), F.lit("units"))


def convert(value: Column, source: Column, target: Column) -> Column:
    """A value in another unit; as it is where there is no conversion."""
    out = value
    for (a, b), (factor, offset) in CONVERSIONS.items():
        out = F.when((source == a) & (target == b), value * factor + offset).otherwise(out)
    return out


def default_unit(unit: Column, locale: str = "en-US") -> Column:
    preferred, out = LOCALES.get(locale, LOCALES["default"]), unit
    for name, kind in KINDS.items():
        out = F.when(unit == name, preferred[kind]).otherwise(out)
    return out


def ordinal(n: Column) -> Column:
    """``21st percentile`` and the like."""
    suffix = F.when((n % 10 == 1) & (n != 11), "st").when((n % 10 == 2) & (n != 12), "nd").when((n % 10 == 3) & (n != 13), "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix, F.lit(" percentile"))


def signed(x: Column, digits: int) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f", x))


def z_text(z: Column) -> Column:
    return F.when(z.isNull(), "N/A").otherwise(F.concat(signed(z, 2), F.lit("σ")))


def score_text(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").when(F.abs(score) >= 10, signed(score, 2)).otherwise(signed(score, 3))


def bucket_label(low: Column, high: Column) -> Column:
    """Text of a weight bucket, with digits by its size."""
    most = F.greatest(F.abs(low), F.abs(high))
    text = lambda form: F.format_string(f"{form} to {form}", low, high)
    return F.when(most >= 1, text("%.2f")).when(most >= 0.01, text("%.3f")).otherwise(F.regexp_replace(text("%.1e"), r"e([+-])0*(\d)", "e$1$2"))


def categories(text: Column) -> Column:
    """A list from a JSON array or else from comma-separated text."""
    from_csv = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(from_csv)


def safe_name(name: Column) -> Column:
    return F.replace(name, F.lit(":"), F.lit("_"))


#: Forms of trait ids and their ontologies.
TRAIT_IDS = {"TRAIT": r"^TRAIT:[0-9]{7}$", "EFO": r"^EFO_[0-9]{7}$", "HP": r"^HP_[0-9]{7}$", "OBA_VT": r"^OBA_VT[0-9]{7}$", "OBA": r"^OBA_[0-9]{7}$", "PATO": r"^PATO_[0-9]{7}$"}
PGS_ID = r"^PGS[0-9]{6}$"


def trait_id_type(trait_id: Column) -> Column:
    """The ontology of a valid trait id, else null."""
    out = F.lit(None).cast("string")
    for kind, form in reversed(TRAIT_IDS.items()):
        out = F.when(trait_id.rlike(form), kind).otherwise(out)
    return out


def metadata_hash(*columns: str) -> Column:
    """SHA-256 of the JSON of the columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
