"""Typed facts out of VARIANT values, without any coercion; and the unit and rounding functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.model import FactDecl

CODES = "array<struct<code:string,system:string,daysAgo:int>>"
TYPES = {"number": "double", "enum": "string", "boolean": "boolean", "code": CODES}

#: Spellings of units that mean the same without any change of the number.
UNIT_ALIASES = {
    "mg/dl": "mg/dL", "MG/DL": "mg/dL", "Mg/Dl": "mg/dL", "milligrams per deciliter": "mg/dL", "mg / dL": "mg/dL",
    "mmol/l": "mmol/L", "MMOL/L": "mmol/L", "millimoles per liter": "mmol/L",
    "g/dl": "g/dL", "G/DL": "g/dL", "grams per deciliter": "g/dL",
    "pg/ml": "pg/mL", "PG/ML": "pg/mL", "picograms per milliliter": "pg/mL",
    "u/l": "U/L", "U/l": "U/L", "IU/L": "U/L",
    "mmHg": "mm[Hg]", "mm Hg": "mm[Hg]", "MMHG": "mm[Hg]",
    "percent": "%", "pct": "%", "%%": "%",
    "KG": "kg", "kgs": "kg", "kilograms": "kg", "CM": "cm", "centimeters": "cm",
    "kg/m^2": "kg/m2", "kg/m²": "kg/m2",
    "mL/min/1.73m2": "mL/min/{1.73_m2}", "mL/min/1.73 m2": "mL/min/{1.73_m2}", "ml/min/1.73m^2": "mL/min/{1.73_m2}", "mL/min per 1.73 m2": "mL/min/{1.73_m2}",
    "x10E3/uL": "10*3/uL", "10^3/uL": "10*3/uL", "K/uL": "10*3/uL", "thousand per microliter": "10*3/uL",
}


def finite(x: Column) -> Column:
    """NaN and infinities are unknown: Spark would hold NaN greater than any number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def from_variant(v: Column, name: str, decl: FactDecl) -> Column:
    """The fact of a VARIANT object as its declared type; NULL if absent or of another type."""
    x = F.try_variant_get(v, f"$.{name}", "variant")
    kind = F.schema_of_variant(x)
    t = TYPES[decl.type]
    got = F.try_variant_get(v, f"$.{name}", t)
    if decl.type == "number":
        return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)"), finite(got))
    if decl.type == "boolean":
        return F.when(kind == "BOOLEAN", got)
    if decl.type == "enum":
        return F.when(kind == "STRING", got)
    return F.when(kind.startswith("ARRAY"), got)


def alias_of(unit: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(UNIT_ALIASES.items())])
    return F.try_element_at(pairs, unit)


def units_equivalent(a: Column, b: Column) -> Column:
    """Equal, or one the alias of the other, or both of the same unit."""
    ua, ub = alias_of(a), alias_of(b)
    return (a == b) | F.coalesce(ua == b, F.lit(False)) | F.coalesce(ub == a, F.lit(False)) | F.coalesce(ua == ub, F.lit(False))


def round_half_up(x: Column, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, on the double as it is (1.005 gives 1.0)."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_|_$", "")


def completed_years(birth: Column, on: Column) -> Column:
    """Calendar years between two days, counted when the birthday has come."""
    early = F.date_format(on, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(on) - F.year(birth) - early.cast("int")


def whole_days(later: Column, earlier: Column) -> Column:
    return F.round((F.unix_millis(later) - F.unix_millis(earlier)) / 86_400_000.0).cast("int")


def patient_id(resource_id: Column) -> Column:
    return F.concat(F.lit("SYN-"), F.upper(F.substring(resource_id, 1, 8)))
