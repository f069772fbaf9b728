"""Tee-time bookings: validation, registration, pricing, booking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.functions import columns as C
from clubspark.operators.player_stats import round_counts
from clubspark.operators.ranking import dense_ids
from clubspark.operators.reshape import to_celsius
from clubspark.schemas import BOOKINGS

# Fixed values of the booking form and of the price list.
BOOKING_DATES = ("2013-03-01", "2023-02-28")
BOOKING_HOURS = (6, 20)
HANDICAPS = (0.0, 36.0)
BASE_PRICE = 75
WEEKEND_FEE = 20
CART_FEE = 20
AFTERNOON_DISCOUNT = 15
WEATHER_DISCOUNT = 5
LOW_HANDICAP_DISCOUNT = 5
HIGH_HANDICAP_FEE = 5
LOYALTY_DISCOUNT = 5


def _reasons(*rules: tuple[str, Column]) -> Column:
    """Comma-separated names of the rules that are hit; null when none is."""
    hits = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules]))
    return F.when(F.size(hits) > 0, F.array_join(hits, ","))


def validate_bookings(requests: DataFrame, handicap_col: str | None = None) -> DataFrame:
    """Requests with a ``reject_reason``, null for valid ones."""
    date, hour = F.col("booking_date"), F.col("hour")
    first, last = (F.lit(d).cast("date") for d in BOOKING_DATES)
    rules = [
        ("booking_id", F.col("booking_id").isNull()),
        ("date", date.isNull() | ~date.between(first, last)),
        ("hour", hour.isNull() | ~hour.between(*BOOKING_HOURS)),
    ]
    if handicap_col is not None:
        rules.append(("handicap", F.col(handicap_col).isNull() | ~F.col(handicap_col).between(*HANDICAPS)))
    return requests.withColumn("reject_reason", _reasons(*rules))


def register_players(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """New players with the handicap they state; the earliest request per name wins.

    Requests are reduced to one per name before the look-up; names already
    known are left alone.
    """
    named = requests.withColumn("player_name", C.normalize_name(F.col("player_name")))
    first = (
        named.where(F.col("player_name").isNotNull())
        .groupBy("player_name")
        .agg(F.min("booking_id").alias("first_seen"), F.min_by("handicap", "booking_id").alias("handicap"))
    )
    fresh = first.join(existing.select("player_name"), "player_name", "left_anti")
    start = existing.agg(F.coalesce(F.max("player_id"), F.lit(0).cast("bigint"))).scalar()
    return dense_ids(fresh, "first_seen", "player_id", start).select(
        "player_id",
        "player_name",
        F.lit("guest").alias("member_status"),
        "handicap",
        F.lit(0).alias("rounds_played"),
    )


def price(
    weekday: Column,
    cart: Column,
    hour: Column,
    rain: Column,
    wind: Column,
    temp_c: Column,
    handicap: Column,
    round_number: Column,
) -> Column:
    """Price of a tee time; temperature in Celsius.  Null where the inputs are."""

    def part(condition: Column, amount: int) -> Column:
        return F.when(condition, amount).otherwise(0)

    bad_weather = (rain > 0.5) | (wind > 15) | (temp_c < 15)
    return (
        F.lit(BASE_PRICE)
        + part(weekday >= 5, WEEKEND_FEE)
        + part(cart, CART_FEE)
        - part((hour > 13) & (weekday < 5), AFTERNOON_DISCOUNT)
        - part(bad_weather, WEATHER_DISCOUNT)
        - part(handicap < 3, LOW_HANDICAP_DISCOUNT)
        + part(handicap > 15, HIGH_HANDICAP_FEE)
        - part(round_number > 15, LOYALTY_DISCOUNT)
    ).cast("double")


def booking_features(
    requests: DataFrame, players: DataFrame, rounds: DataFrame, weather: DataFrame, temp_unit: str = "C"
) -> DataFrame:
    """Requests with player, handicap, round number, weekday and weather of the day.

    Rounds are reduced to counts per player first, unless they are (player_id, rounds) already.  Weather is one row per
    calendar day; its temperature comes out in Celsius.
    """
    who = players.select(
        F.col("player_name").alias("_name"), "player_id", "handicap"
    ).join(rounds if "rounds" in rounds.columns else round_counts(rounds), "player_id", "left")
    days = to_celsius(weather, temp_unit).select(
        F.col("date").alias("booking_date"),
        "avg_temp",
        "precipitation",
        "wind_speed",
        F.lit(True).alias("_has_weather"),
    )
    named = requests.withColumn("player_name", C.normalize_name(F.col("player_name")))
    return (
        named.join(who, F.col("player_name") == F.col("_name"), "left")
        .join(F.broadcast(days), "booking_date", "left")
        .withColumn("round_number", (F.coalesce("rounds", F.lit(0)) + 1).cast("int"))
        .withColumn("day_of_week_int", C.weekday_int(F.col("booking_date")))
        .drop("_name", "rounds")
    )


def price_bookings(features: DataFrame) -> DataFrame:
    """Features with ``price_paid`` and ``reject_reason``; nothing fails the job."""
    known = _reasons(
        ("player", F.col("player_id").isNull()),
        ("handicap", F.col("player_id").isNotNull() & F.col("handicap").isNull()),
        (
            "weather",
            F.col("avg_temp").isNull() | F.col("precipitation").isNull() | F.col("wind_speed").isNull(),
        ),
    )
    reason = known
    if "reject_reason" in features.columns:
        reason = F.when(
            F.col("reject_reason").isNotNull() | known.isNotNull(), F.concat_ws(",", "reject_reason", known)
        )
    amount = price(
        F.col("day_of_week_int"),
        F.col("cart"),
        F.col("hour"),
        F.col("precipitation"),
        F.col("wind_speed"),
        F.col("avg_temp"),
        F.col("handicap"),
        F.col("round_number"),
    )
    return features.withColumn("reject_reason", reason).withColumn(
        "price_paid", F.when(F.col("reject_reason").isNull(), amount)
    )


def rounded_prediction(prediction: Column) -> Column:
    """Whole strokes, halves to the even number."""
    return F.bround(prediction).cast("double")


def tee_time(date: Column, hour: Column) -> Column:
    return date.cast("timestamp_ntz") + F.make_dt_interval(hours=hour)


def book(
    requests: DataFrame,
    players: DataFrame,
    rounds: DataFrame,
    weather: DataFrame,
    temp_unit: str = "C",
    predict: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Price every valid request and mark the others rejected, with the reason.

    ``predict`` adds a ``prediction`` to the features, as a model bundle does; without it no score is predicted.
    Requests without a ``booking_time`` are booked now.
    """
    if "booking_time" not in requests.columns:
        requests = requests.withColumn("booking_time", F.current_timestamp().cast("timestamp_ntz"))
    priced = price_bookings(booking_features(validate_bookings(requests), players, rounds, weather, temp_unit))
    whole = F.lit(None).cast("double")
    if predict is not None:
        priced, whole = predict(priced), rounded_prediction(F.col("prediction"))
    return priced.select(
        "booking_id",
        "player_id",
        tee_time(F.col("booking_date"), F.col("hour")).alias("tee_time"),
        "price_paid",
        F.when(F.col("reject_reason").isNull(), "confirmed").otherwise("rejected").alias("booking_status"),
        F.col("booking_date").alias("round_date"),
        F.when(F.col("reject_reason").isNull(), whole).alias("score_prediction"),
        "round_number",
        "booking_time",
        "reject_reason",
    )


def book_with_newcomers(
    requests: DataFrame, players: DataFrame, rounds: DataFrame, weather: DataFrame, **options
) -> tuple[DataFrame, DataFrame]:
    """(bookings, new players): unknown names are registered with the handicap they state, then booked.

    A name is registered whether or not its booking is confirmed, if the stated handicap is one.
    """
    stated = requests.where(F.col("handicap").between(*HANDICAPS))
    fresh = register_players(stated, players)
    everyone = players.select("player_id", "player_name", "handicap").unionByName(
        fresh.select("player_id", "player_name", "handicap")
    )
    return book(requests.drop("handicap"), everyone, rounds, weather, **options), fresh


def booking_records(booked: DataFrame) -> DataFrame:
    """Confirmed bookings with the columns of the stored table."""
    return booked.where(F.col("booking_status") == "confirmed").select(*BOOKINGS.names)
