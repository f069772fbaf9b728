"""Column expressions: calendar, units, portable hash, names, conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- integer helpers -------------------------------------------------------


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division, truncated toward zero, exact for 64-bit operands."""
    return F.call_function("div", a.cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def portable_hash(x: Column, seed: int = 0) -> Column:
    """Repeatable value below 2**60 from an id and a seed: the stand-in for a random draw.

    The first 15 hex digits of an MD5, so a rerun, another engine or another cluster draws
    the same, neighbouring ids draw independently and so do different seeds.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), x.cast("bigint").cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


# --- units -----------------------------------------------------------------


def c_to_f(c: Column) -> Column:
    return c * 9 / 5 + 32


def f_to_c(f: Column) -> Column:
    return (f - 32) * 5 / 9


def km_to_miles(km: Column) -> Column:
    return km * 0.621371


# --- calendar --------------------------------------------------------------


def weekday_int(date: Column, dow_convention: str = "monday0") -> Column:
    """Day of week: Monday=0..Sunday=6, or Sunday=1..Saturday=7 ("spark")."""
    if dow_convention == "monday0":
        return F.weekday(date)
    if dow_convention == "spark":
        return F.dayofweek(date)
    raise ValueError(f"unknown dow_convention {dow_convention!r}")


def weekday_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


# Seasons from December on, three months each.
SEASONS = ("Winter", "Spring", "Summer", "Fall")


def season(date: Column) -> Column:
    """Meteorological season of a date: December to February is Winter, and so on."""
    names = F.array(*[F.lit(name) for name in SEASONS])
    return F.element_at(names, (idiv(F.month(date) % 12, 3) + 1).cast("int"))


# --- names -----------------------------------------------------------------


def normalize_name(name: Column) -> Column:
    """Trim all white space and put a capital after every non-letter."""
    trimmed = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    runs = F.regexp_extract_all(trimmed, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


# --- weather classes -------------------------------------------------------


def conditions(precipitation: Column, wind_speed: Column) -> Column:
    """Three classes, first match wins; unknown values fall through."""
    return (
        F.when(precipitation > 0.5, "Rainy").when(wind_speed > 15, "Windy").otherwise("Good Conditions")
    )


def weather_category(precipitation: Column, wind_speed: Column, temp_f: Column) -> Column:
    """Four classes, first match wins; temperatures in Fahrenheit."""
    return (
        F.when(precipitation > 0.5, "Rainy")
        .when(wind_speed > 15, "Windy")
        .when((temp_f < 45) | (temp_f > 95), "Extreme Weather")
        .otherwise("Good Conditions")
    )


def poor_conditions(precipitation: Column, wind_speed: Column, temp_f: Column) -> Column:
    return (temp_f < 65) & (precipitation > 15) & (wind_speed > 10)


def true_or_false(condition: Column) -> Column:
    """A comparison with an unknown value counts as false."""
    return F.coalesce(condition, F.lit(False))
