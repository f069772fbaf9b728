"""Declared schemas of the input files and the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCORECARDS = T.StructType(
    [
        T.StructField("Year", T.IntegerType()),
        T.StructField("Name", T.StringType()),
        T.StructField("Course", T.StringType()),
        T.StructField("Yards", T.IntegerType()),
        T.StructField("Par", T.IntegerType()),
        T.StructField("Open.Position", T.StringType()),
        T.StructField("Integer.Position", T.IntegerType()),
        T.StructField("Position.Grouping", T.StringType()),
        T.StructField("Open.R1", T.IntegerType()),
        T.StructField("Open.R2", T.IntegerType()),
        T.StructField("Open.R3", T.IntegerType()),
        T.StructField("Open.R4", T.IntegerType()),
    ]
)

WEATHER_RAW = T.StructType(
    [
        T.StructField("time", T.DateType()),
        T.StructField("tavg", T.DoubleType()),
        T.StructField("tmin", T.DoubleType()),
        T.StructField("tmax", T.DoubleType()),
        T.StructField("prcp", T.DoubleType()),
        T.StructField("wdir", T.DoubleType()),
        T.StructField("wspd", T.DoubleType()),
        T.StructField("pres", T.DoubleType()),
    ]
)

PLAYERS = T.StructType(
    [
        T.StructField("player_id", T.LongType(), False),
        T.StructField("player_name", T.StringType(), False),
        T.StructField("member_status", T.StringType()),
        T.StructField("handicap", T.DoubleType()),
        T.StructField("rounds_played", T.IntegerType()),
    ]
)

WEATHER = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("avg_temp", T.DoubleType()),
        T.StructField("precipitation", T.DoubleType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("day_of_week_int", T.IntegerType()),
    ]
)

ROUNDS = T.StructType(
    [
        T.StructField("round_id", T.LongType(), False),
        T.StructField("player_id", T.LongType()),
        T.StructField("player_name", T.StringType(), False),
        T.StructField("round_date", T.DateType()),
        T.StructField("score", T.IntegerType(), False),
        T.StructField("round_number", T.IntegerType()),
    ]
)

BOOKINGS = T.StructType(
    [
        T.StructField("booking_id", T.LongType(), False),
        T.StructField("player_id", T.LongType()),
        T.StructField("tee_time", T.TimestampNTZType(), False),
        T.StructField("price_paid", T.DoubleType(), False),
        T.StructField("booking_status", T.StringType()),
        T.StructField("round_date", T.DateType(), False),
        T.StructField("score_prediction", T.DoubleType()),
        T.StructField("booking_time", T.TimestampNTZType(), False),
    ]
)

# Mergeable per-player summaries (see operators.player_stats).
ROUND_COUNTS = T.StructType(
    [T.StructField("player_id", T.LongType()), T.StructField("rounds", T.LongType())]
)
LATEST_ROUNDS = T.StructType(
    [
        T.StructField("player_id", T.LongType()),
        T.StructField("round_date", T.DateType()),
        T.StructField("round_id", T.LongType()),
        T.StructField("score", T.IntegerType()),
    ]
)

TABLES = {
    "players": PLAYERS,
    "weather": WEATHER,
    "rounds": ROUNDS,
    "bookings": BOOKINGS,
    "round_counts": ROUND_COUNTS,
    "latest_rounds": LATEST_ROUNDS,
}

# Column defaults of the stored tables.
DEFAULTS = {
    "players": {"member_status": "guest", "rounds_played": 0},
    "bookings": {"price_paid": 75.0, "booking_status": "confirmed", "score_prediction": None},
}

# Declared text lengths.
LENGTHS = {
    "players": {"player_name": 100, "member_status": 20},
    "weather": {"day_of_week": 20},
    "rounds": {"player_name": 100},
    "bookings": {"booking_status": 20},
}

# Declared keys, and the references as column -> (table, column).
PRIMARY = {"players": "player_id", "weather": "date", "rounds": "round_id", "bookings": "booking_id"}
UNIQUE = {"players": ("player_name",)}
REFERENCES = {
    "rounds": {"player_id": ("players", "player_id"), "round_date": ("weather", "date")},
    "bookings": {"player_id": ("players", "player_id")},
}
