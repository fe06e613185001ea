"""Cleaning and value standardisers, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_clean(c: Column) -> Column:
    """Two single quotes, or one space, are a null."""
    return F.when(c.isin("''", " "), F.lit(None)).otherwise(c)


def strip_quotes(c: Column, strict: bool = False) -> Column:
    """Without the first and last character if either end is a single quote; strict: only if both are."""
    ends = (c.startswith("'") & c.endswith("'") & (F.length(c) > 1)) if strict else (c.startswith("'") | c.endswith("'"))
    return F.when(ends, F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def clean_table(df: DataFrame, strict_quotes: bool = False) -> DataFrame:
    """null_clean, then strip_quotes, on every cell and header."""
    out = []
    for name in df.columns:
        head = name[1:-1] if name.startswith("'") or name.endswith("'") else name
        out.append(strip_quotes(null_clean(F.col(f"`{name}`")), strict_quotes).alias(head or name))
    return df.select(*out)


def first_name(c: Column) -> Column:
    """The first word, capitalised."""
    return F.initcap(F.element_at(F.split(F.trim(c), r"\s+"), 1))


def person_name(c: Column) -> Column:
    """'last, first' turned round, initials and periods dropped, words capitalised."""
    low = F.regexp_replace(F.lower(F.trim(c)), r"\.", "")
    parts = F.split(low, ",")
    turned = F.when(F.contains(low, F.lit(",")), F.concat(F.trim(F.get(parts, 1)), F.lit(" "), F.trim(F.get(parts, 0)))).otherwise(low)
    bare = F.regexp_replace(turned, r"(?U)\b[a-zA-Z]\.?\b", "")
    return F.initcap(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def clock_time(c: Column) -> Column:
    """HH:MM:SS; an 'a' means morning, else a 'p' afternoon. Hours may exceed 23."""
    low = F.lower(F.trim(c))
    am, pm = F.contains(low, F.lit("a")), ~F.contains(low, F.lit("a")) & F.contains(low, F.lit("p"))
    digits = F.regexp_replace(low, r"[^0-9:]", "")
    parts = F.split(digits, ":")

    def part(i: int) -> Column:
        x = F.get(parts, i)
        x = F.coalesce(x, F.lit("00"))
        return F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)

    hour = part(0)
    number = F.coalesce(hour.try_cast("int"), F.lit(0))
    shifted = F.when(am & (number == 12), F.lit("00")).when(pm & (number != 12), (number + 12).cast("string")).otherwise(hour)
    shifted = F.when(F.length(shifted) < 2, F.lpad(shifted, 2, "0")).otherwise(shifted)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.concat_ws(":", shifted, part(1), part(2)))


def number_text(c: Column) -> Column:
    """Without thousands separators; a currency sign stays."""
    return F.translate(c, ",", "")


DATE_PATTERNS = ["M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"]


def date_text(c: Column) -> Column:
    """yyyy-MM-dd, month first where both orders fit, else 'Invalid Date'. Opt-in: dates otherwise pass unchanged."""
    tried = F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(p)) for p in DATE_PATTERNS))
    return F.coalesce(F.date_format(tried, "yyyy-MM-dd"), F.lit("Invalid Date"))


@dataclass(frozen=True)
class TemperaturePlan:
    """What one pass over a column finds: whether it is to be in Celsius, and whether a bare number is taken as Celsius."""

    celsius: bool
    bare_is_celsius: bool = True


def temperature_number(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def plan_temperature(df: DataFrame, column: str, order: str | None = None, cut: float = 50.0, assume_column_unit: bool = False) -> TemperaturePlan:
    """One aggregate: the first unit by ``order`` decides, else a mean below ``cut`` means Celsius."""
    c = F.upper(F.col(f"`{column}`"))
    unit = F.when(F.contains(c, F.lit("C")), F.lit("C")).when(F.contains(c, F.lit("F")), F.lit("F"))
    at = F.col(order) if order else F.monotonically_increasing_id()
    row = df.select(unit.alias("unit"), at.alias("at"), temperature_number(c).alias("v")).agg(
        F.min(F.when(F.col("unit").isNotNull(), F.struct("at", "unit"))).alias("first"), F.avg("v").alias("mean")
    ).first()
    if row["first"] is not None:
        return TemperaturePlan(row["first"]["unit"] == "C")
    celsius = row["mean"] is not None and row["mean"] < cut
    return TemperaturePlan(celsius, celsius or not assume_column_unit)


def one_decimal(v: Column) -> Column:
    """A number as text with one decimal, half to even on the exact binary value."""
    return F.call_function("format_number", v, F.lit("0.0"))


def temperature(c: Column, plan: TemperaturePlan) -> Column:
    """One decimal in the planned unit."""
    v = temperature_number(c)
    has_f = F.contains(F.upper(c), F.lit("F"))
    if plan.celsius:
        out = F.when(has_f, (v - 32) * 5 / 9).otherwise(v)
    else:
        out = F.when(has_f, v).otherwise(v * 9 / 5 + 32 if plan.bare_is_celsius else v)
    return F.when(c.isNull(), F.lit(None)).otherwise(one_decimal(out))


def identity(c: Column) -> Column:
    return c


# The categories and the sentence that is typical of each.
EXEMPLARS = {
    "name": "John A. Smith",
    "date": "date 5/12/2023 3/23/98 January 25,2024",
    "time": "time 10:30 AM",
    "temperature": "22.5 degrees Celsius",
    "address": "123 Main Street, Springfield, IL",
    "money": "the salary is $10 and $13.23 and 6.23",
    "etc": "miscellaneous data",
}

#: category -> (exemplar, standardiser). A temperature column is planned over the whole column, see plan_temperature.
REGISTRY: dict[str, tuple[str, Callable[[Column], Column]]] = {c: (e, identity) for c, e in EXEMPLARS.items()}
REGISTRY["name"] = (EXEMPLARS["name"], person_name)
REGISTRY["time"] = (EXEMPLARS["time"], clock_time)
REGISTRY["money"] = (EXEMPLARS["money"], number_text)


def register_standardizer(category: str, exemplar: str, fn: Callable[[Column], Column]) -> None:
    REGISTRY[category] = (exemplar, fn)


def standardizer(category: str) -> Callable[[Column], Column]:
    """The standardiser of a category; spaces and underscores are alike, an unknown category raises."""
    key = category.replace("_", " ").strip().lower()
    for name, (_, fn) in REGISTRY.items():
        if name.replace("_", " ") == key:
            return fn
    raise ValueError(f"unknown category: {category}")


# The kinds of fields that columns are stacked by.
FIELDS = ("name", "date", "time", "temperature", "status", "address", "id", "phone_number", "email", "price", "quantity", "age", "gender", "weight", "height")


def field_standardizer(category: str) -> Callable[[Column], Column]:
    """How a field is brought into form when tables are stacked: names become first names; an unknown kind raises."""
    key = category.strip().lower().replace(" ", "_")
    if key not in FIELDS:
        raise ValueError(f"unknown field: {category}")
    return first_name if key == "name" else identity


#: How each category is shown, as (prefix, suffix).
DISPLAY = {"temperature": ("", "°C"), "price": ("$", ""), "age": ("", " years"), "weight": ("", " kg"), "height": ("", " m")}


def display(label: str, c: Column, category: str) -> Column:
    prefix, suffix = DISPLAY.get(category, ("", ""))
    return F.concat(F.lit(f"{label}: {prefix}"), c, F.lit(suffix))
