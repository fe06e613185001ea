"""Formats of columns, recorded when cells are brought into standard form, and brought back afterwards.

A plan is found by one aggregate over a column: for every trait of a format, what most cells show. Standard forms
are those of ``standardize``; restoring writes them as the plan says, so that cells of another table, which came in
another format, are shown like the user's own. A cell that is not in standard form stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import standardize as st

DECIMALS = (0, 1, 2, 3, 4)
SIGNS = ("$", "€", "£", "¥")


@dataclass(frozen=True)
class DateFormat:
    pattern: str

    def standard(self, c: Column) -> Column:
        day = st.date_text(c)
        return F.when(day != "Invalid Date", day).otherwise(c)  # what is no date stays, so that it comes back

    def restore(self, c: Column) -> Column:
        return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), self.pattern), c)


@dataclass(frozen=True)
class TimeFormat:
    half_days: bool
    seconds: bool

    def standard(self, c: Column) -> Column:
        return st.clock_time(c)

    def restore(self, c: Column) -> Column:
        pattern = ("h:mm" if self.half_days else "HH:mm") + (":ss" if self.seconds else "") + (" a" if self.half_days else "")
        return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit("HH:mm:ss")), pattern), c)


@dataclass(frozen=True)
class MoneyFormat:
    sign: str
    commas: bool
    decimals: int

    def standard(self, c: Column) -> Column:
        return st.number_text(c)

    def restore(self, c: Column) -> Column:
        number = F.regexp_replace(c, r"^[^0-9.-]*", "").try_cast(f"decimal(38,{self.decimals})")
        text = F.format_number(number, self.decimals) if self.commas else number.cast("string")
        return F.coalesce(F.concat(F.lit(self.sign), text), c)


@dataclass(frozen=True)
class TemperatureFormat:
    """celsius: the unit of the standard form; unit, suffix: what the user's cells show."""

    plan: st.TemperaturePlan
    unit: str
    suffix: str
    decimals: int

    def standard(self, c: Column) -> Column:
        return st.temperature(c, self.plan)

    def restore(self, c: Column) -> Column:
        v = c.try_cast("double")
        if self.plan.celsius and self.unit == "F":
            v = v * 9 / 5 + 32
        elif not self.plan.celsius and self.unit == "C":
            v = (v - 32) * 5 / 9
        text = F.call_function("format_number", v, F.lit("0." + "0" * self.decimals if self.decimals else "0"))
        return F.coalesce(F.concat(text, F.lit(self.suffix)), c)


Format = DateFormat | TimeFormat | MoneyFormat | TemperatureFormat


def _counts(df: DataFrame, column: str, traits: dict[str, Column]) -> dict[str, int]:
    """How many cells show each trait; one aggregate."""
    row = df.select(F.trim(F.col(f"`{column}`").cast("string")).alias("c")).agg(F.count("c").alias("n"), *(F.count_if(t).alias(f"t{i}") for i, t in enumerate(traits.values()))).first()
    return {"n": row["n"]} | {k: row[f"t{i}"] for i, k in enumerate(traits)}


def plan_format(df: DataFrame, column: str, category: str, order: str | None = None) -> Format | None:
    """The format that most cells of a column are in, the first one on ties; None for a category without one. order: as for plan_temperature."""
    c = F.col("c")
    places = {d: c.rlike(r"\." + "[0-9]" * d + r"(?![0-9])") if d else ~c.rlike(r"\.[0-9]") for d in DECIMALS}
    if category == "date":
        seen = _counts(df, column, {p: F.date_format(F.try_to_timestamp(c, F.lit(p)), p) == c for p in st.DATE_PATTERNS})
        return DateFormat(max(st.DATE_PATTERNS, key=lambda p: seen[p]))
    if category == "time":
        seen = _counts(df, column, {"half": c.rlike("(?i)[ap]"), "seconds": c.rlike(":[0-9]+:")})
        return TimeFormat(2 * seen["half"] > seen["n"], 2 * seen["seconds"] > seen["n"])
    if category == "money":
        seen = _counts(df, column, {s: c.startswith(s) for s in SIGNS} | {"commas": c.contains(","), "large": c.rlike("[0-9],?[0-9]{3}(?![0-9])")} | {f"d{d}": t for d, t in places.items()})
        sign = max(SIGNS, key=lambda s: seen[s])
        return MoneyFormat(sign if 2 * seen[sign] > seen["n"] else "", 2 * seen["commas"] > seen["large"], max(DECIMALS, key=lambda d: seen[f"d{d}"]))
    if category == "temperature":
        plan = st.plan_temperature(df, column, order)
        up = F.upper(c)
        suffixes = ("C", "F", "°C", "°F", " C", " F", " °C", " °F")
        seen = _counts(df, column, {s: up.rlike("[0-9]" + s + "$") for s in suffixes} | {f"d{d}": t for d, t in places.items()})
        suffix = max(suffixes, key=lambda s: seen[s])
        bare = 2 * seen[suffix] <= seen["n"]
        unit = suffix[-1] if not bare else "C" if plan.celsius or plan.bare_is_celsius else "F"
        return TemperatureFormat(plan, unit, "" if bare else suffix, max(DECIMALS, key=lambda d: seen[f"d{d}"]))
    return None


def plan_formats(df: DataFrame, categories: dict[str, str], order: str | None = None) -> dict[str, Format]:
    """column -> format, for the columns whose category has one; an aggregate a column."""
    found = {c: plan_format(df, c, k, order) for c, k in categories.items()}
    return {c: f for c, f in found.items() if f is not None}


def standard_table(df: DataFrame, formats: dict[str, Format]) -> DataFrame:
    """df with the columns of formats in standard form."""
    return df.withColumns({c: f.standard(F.col(f"`{c}`")) for c, f in formats.items()}) if formats else df


def restore_table(df: DataFrame, formats: dict[str, Format]) -> DataFrame:
    """df with the columns of formats as their plans say; columns that df lacks are skipped."""
    own = {c: f.restore(F.col(f"`{c}`")) for c, f in formats.items() if c in df.columns}
    return df.withColumns(own) if own else df
