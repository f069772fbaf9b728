"""Score adjustment by weather and weekday.

All adjustments except the exploratory round-number rule depend on the day
only, so they are computed once per day on the weather table and joined by date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.operators.ranking import position_in_key
from clubspark.operators.reshape import convert_units

# Strokes added, first matching line of a group wins.
# Temperatures in Fahrenheit, wind in miles per hour, rain in millimetres.
STORED_RULES = {
    "avg_temp": [("<", 50, 4), (">", 95, 4), (">", 80, -1)],
    "wind_speed": [(">", 15, 4), (">", 10, 3), ("<", 3, -1)],
    "precipitation": [(">", 10, 5), (">", 0, 3), ("=", 0, -1)],
    "day_of_week_int": [("in", (5, 6), -1), ("in", (0, 1), 2)],
}
EXPLORATORY_RULES = {
    "avg_temp": [("<", 50, 3), (">", 95, 2), (">", 80, -1)],
    "wind_speed": [(">", 15, 3), (">", 10, 2), ("<", 3, -1)],
    "precipitation": [(">", 10, 3), (">", 0, 1), ("=", 0, -1)],
    "day_of_week_int": [("in", (5, 6), -1), ("in", (0, 1), 1)],
}
# The lines for more than 50 and 125 rounds stand behind the one for more than
# 10 and never apply; kept as the rule is stated.
EXPLORATORY_ROUND_RULE = [(">", 10, -1), (">", 50, -2), (">", 125, -3), ("=", 1, 1)]

_COMPARE = {
    "<": lambda c, v: c < v,
    "=": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    "in": lambda c, v: c.isin(*v),
}


def ladder(value: Column, steps: list[tuple]) -> Column:
    """Strokes of the first step that applies; 0 for none or an unknown value."""
    hits = [F.when(_COMPARE[op](value, bound), strokes) for op, bound, strokes in steps]
    return F.coalesce(*hits, F.lit(0))


def day_adjustment(weather: DataFrame, rules: dict = STORED_RULES) -> DataFrame:
    """(date, delta) from a weather table in Fahrenheit and miles per hour."""
    parts = [ladder(F.col(name), steps) for name, steps in rules.items()]
    return weather.select("date", sum(parts[1:], parts[0]).alias("delta"))


def _with_delta(rounds: DataFrame, weather: DataFrame, rules: dict, temp_unit: str, wind_unit: str) -> DataFrame:
    # One row per day of the calendar: bounded whatever the number of rounds.
    days = F.broadcast(day_adjustment(convert_units(weather, temp_unit, wind_unit), rules))
    joined = rounds.join(days, rounds["round_date"] == days["date"], "left").drop("date")
    return joined.withColumn("delta", F.coalesce(F.col("delta"), F.lit(0)))


def adjust_scores(rounds: DataFrame, weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph") -> DataFrame:
    """Adjust each score once by the weather and weekday of its date."""
    joined = _with_delta(rounds, weather, STORED_RULES, temp_unit, wind_unit)
    return joined.withColumn("score", (F.col("score") + F.col("delta")).cast("int")).drop("delta")


def adjust_scores_compounded(
    rounds: DataFrame, weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph"
) -> DataFrame:
    """Variant in which every later insert of a player adjusts the earlier rounds again.

    The i-th of a player's N rounds is adjusted N - i + 2 times.
    """
    joined = _with_delta(rounds, weather, STORED_RULES, temp_unit, wind_unit)
    ranked = position_in_key(joined, "player_id", [], "round_id", "_from_end", descending=True)
    times = F.col("_from_end") + 1
    return ranked.withColumn("score", (F.col("score") + F.col("delta") * times).cast("int")).drop("delta", "_from_end")


def adjust_scores_exploratory(
    numbered_rounds: DataFrame, weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph"
) -> DataFrame:
    """The milder exploratory rule, which also looks at the round number."""
    joined = _with_delta(numbered_rounds, weather, EXPLORATORY_RULES, temp_unit, wind_unit)
    loyalty = ladder(F.col("round_number"), EXPLORATORY_ROUND_RULE)
    return joined.withColumn("score", (F.col("score") + F.col("delta") + loyalty).cast("int")).drop("delta")
