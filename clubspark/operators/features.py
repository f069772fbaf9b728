"""Features of the score model: training frame, scaling, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.functions.columns import f_to_c, portable_hash, true_or_false
from clubspark.operators.ranking import round_numbers

# The model's input columns in order, and those that are scaled.
BASE_FEATURES = ["round_number", "handicap", "avg_temp", "precipitation", "wind_speed", "day_of_week_int"]
ENGINEERED = ["wind_precip", "wind_cold", "bad_weather_combo", "weekend"]
FEATURES = BASE_FEATURES + ENGINEERED
SCALED = ["round_number", "handicap", "avg_temp", "precipitation", "wind_speed"]


def training_set(rounds: DataFrame, handicaps: DataFrame, weather: DataFrame) -> DataFrame:
    """Rounds with round number, the player's handicap and the day's weather (left joins)."""
    numbered = round_numbers(rounds)
    days = F.broadcast(weather.select("date", "avg_temp", "precipitation", "wind_speed", "day_of_week_int"))
    return (
        numbered.join(handicaps.select("player_id", "handicap"), "player_id", "left")
        .join(days, F.col("round_date") == F.col("date"), "left")
        .select("round_id", "score", *BASE_FEATURES)
    )


def engineer_features(df: DataFrame, temp_unit: str = "C") -> DataFrame:
    """Add the four engineered columns; unknown values compare false."""
    rain, wind = F.col("precipitation"), F.col("wind_speed")
    temp = F.col("avg_temp") if temp_unit == "C" else f_to_c(F.col("avg_temp"))
    return df.withColumns(
        {
            "wind_precip": rain * wind,
            "wind_cold": wind * true_or_false(temp < 15).cast("int"),
            "bad_weather_combo": true_or_false((wind > 15) & (rain > 0.5) & (temp < 15)).cast("int"),
            "weekend": true_or_false(F.col("day_of_week_int") >= 5),
        }
    )


def split_target(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(features, target) when the frame has scores, else (features, None)."""
    if "score" in df.columns:
        return df.drop("score"), df.select("score")
    return df, None


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without unknown inputs: the estimators cannot use the others."""
    return df.dropna(subset=["score", *BASE_FEATURES])


def training_rejects(df: DataFrame) -> DataFrame:
    """How many rows :func:`complete_rows` drops, and the unknown cells per column, in one pass."""
    inputs = ["score", *BASE_FEATURES]
    unknown = [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in inputs]
    kept = F.count(F.when(F.array_contains(F.array(*[F.col(c).isNull() for c in inputs]), True), None).otherwise(1))
    return df.agg(F.count(F.lit(1)).alias("rows"), kept.alias("kept"), *unknown)


def training_features(rounds: DataFrame, handicaps: DataFrame, weather: DataFrame) -> DataFrame:
    return complete_rows(engineer_features(training_set(rounds, handicaps, weather)))


def scaler_stats(df: DataFrame) -> DataFrame:
    """One row: mean and population sd of the scaled columns, an sd of 0 read as 1."""
    stats = []
    for name in SCALED:
        sd = F.stddev_pop(name)
        stats += [F.avg(name).alias(f"{name}_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{name}_sd")]
    return df.agg(*stats)


def apply_scaler(df: DataFrame, stats: DataFrame | dict) -> DataFrame:
    """Standardise the scaled columns with one row of stats, as a table or as values."""
    if isinstance(stats, dict):
        values = F.struct(*[F.lit(v).alias(k) for k, v in stats.items()])
    else:
        values = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumns({c: (F.col(c) - values[f"{c}_mean"]) / values[f"{c}_sd"] for c in SCALED})


def split_flag(id_col: str = "round_id", seed: int = 42) -> Column:
    """"train" for four rows in five, "test" for the rest, the same on every run."""
    return F.when(portable_hash(F.col(id_col), seed) % 10 < 8, "train").otherwise("test")
