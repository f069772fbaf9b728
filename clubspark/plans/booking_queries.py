"""Bookings and model features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubspark.functions import columns as C
from clubspark.operators import bookings, features, player_stats
from clubspark.plans import domain as D
from clubspark.plans.registry import hash_sql, query, with_views
from clubspark.session import materialize, shared_folder
from clubspark.sources.tables import ParquetTables

BOOKED = """
, booked AS (
  SELECT r.*, p.player_id, h.handicap AS known_handicap, coalesce(c.n, 0) + 1 AS round_number,
    w.avg_temp, w.precipitation, w.wind_speed, isodow(booking_date) - 1 AS dow
  FROM requests r
  LEFT JOIN players p ON r.player_name = p.player_name
  LEFT JOIN handicaps h ON p.player_id = h.player_id
  LEFT JOIN (SELECT player_id, count(*) AS n FROM rounds GROUP BY 1) c ON p.player_id = c.player_id
  LEFT JOIN weather w ON booking_date = w.date
  WHERE event_type = 'purchase'
), judged AS (
  SELECT *, nullif(concat_ws(',',
      CASE WHEN NOT booking_date BETWEEN DATE '2013-03-01' AND DATE '2023-02-28' THEN 'date' END,
      CASE WHEN NOT hour BETWEEN 6 AND 20 THEN 'hour' END,
      CASE WHEN player_id IS NULL THEN 'player' END,
      CASE WHEN player_id IS NOT NULL AND known_handicap IS NULL THEN 'handicap' END,
      CASE WHEN avg_temp IS NULL OR precipitation IS NULL OR wind_speed IS NULL THEN 'weather' END), '') AS reject_reason,
    CAST(75 + CASE WHEN dow >= 5 THEN 20 ELSE 0 END + CASE WHEN cart THEN 20 ELSE 0 END
      - CASE WHEN hour > 13 AND dow < 5 THEN 15 ELSE 0 END
      - CASE WHEN precipitation > 0.5 OR wind_speed > 15 OR avg_temp < 15 THEN 5 ELSE 0 END
      - CASE WHEN known_handicap < 3 THEN 5 ELSE 0 END + CASE WHEN known_handicap > 15 THEN 5 ELSE 0 END
      - CASE WHEN round_number > 15 THEN 5 ELSE 0 END AS DOUBLE) AS amount
  FROM booked
)
"""


def _stats(
    spark: SparkSession, sf: str, weather: DataFrame, requests: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Players with their handicaps, and the stored rounds, written once; only of the players in ``requests``."""
    rounds = D.rounds(spark, sf, weather)
    if requests is not None:
        names = requests.select(C.normalize_name(F.col("player_name")).alias("player_name"))
        asking = D.players(spark, sf).join(names, "player_name", "left_semi").select("player_id")
        rounds = rounds.join(asking, "player_id", "left_semi")
    rounds = materialize(rounds)
    players = D.players(spark, sf).drop("handicap").join(player_stats.handicaps(rounds), "player_id", "left")
    return players, rounds


@query("validate_bookings", """
SELECT booking_id, nullif(concat_ws(',', CASE WHEN NOT booking_date BETWEEN DATE '2013-03-01' AND DATE '2023-02-28' THEN 'date' END,
  CASE WHEN NOT hour BETWEEN 6 AND 20 THEN 'hour' END, CASE WHEN NOT handicap BETWEEN 0 AND 36 THEN 'handicap' END), '') AS reject_reason
FROM (SELECT booking_id, handicap + 3 * cast(cart AS INTEGER) AS handicap, hour + cast(cart AS INTEGER) AS hour,
  CAST(booking_date + INTERVAL 1 YEAR AS DATE) AS booking_date FROM requests)""", ("requests",))
def validate_bookings(spark: SparkSession, sf: str) -> DataFrame:
    """All events as requests, shifted so that every rule is broken by some."""
    cart = (F.col("event_id") % 2 == 0).cast("int")
    asked = D.table(spark, sf, "events").select(
        F.col("event_id").alias("booking_id"),
        ((F.col("event_id") % 361) / 10.0 + cart * 3).alias("handicap"),
        (F.col("event_id") % 15 + 6 + cart).cast("int").alias("hour"),
        F.add_months(F.date_add(F.lit("2017-04-01").cast("date"), (F.col("event_id") * 37 % 2000).cast("int")), 12).alias("booking_date"),
    )
    return bookings.validate_bookings(asked, handicap_col="handicap").select("booking_id", "reject_reason")


@query("register_players", with_views("", "requests", "players") + """
, first AS (
  SELECT player_name, handicap, booking_id FROM requests WHERE event_type = 'signup' AND player_name IS NOT NULL
    AND player_name NOT IN (SELECT player_name FROM players WHERE registered)
  QUALIFY row_number() OVER (PARTITION BY player_name ORDER BY booking_id) = 1
)
SELECT (SELECT max(player_id) FROM players WHERE registered) + row_number() OVER (ORDER BY booking_id) AS player_id,
  player_name, 'guest' AS member_status, handicap, 0 AS rounds_played FROM first""")
def register_players(spark: SparkSession, sf: str) -> DataFrame:
    return bookings.register_players(D.registrations(spark, sf), D.players(spark, sf, existing=True))


@query("price_bookings", with_views("", "requests", "players", "handicaps", "rounds", "weather") + BOOKED + """
SELECT booking_id, CASE WHEN reject_reason IS NULL THEN amount END AS price_paid FROM judged""")
def price_bookings(spark: SparkSession, sf: str) -> DataFrame:
    asked, weather = D.booking_requests(spark, sf), D.weather_once(spark, sf)
    players, rounds = _stats(spark, sf, weather, asked)
    frame = bookings.booking_features(bookings.validate_bookings(asked), players, rounds, weather)
    return bookings.price_bookings(frame).select("booking_id", "price_paid")


BOOK_SQL = with_views("", "requests", "players", "handicaps", "rounds", "weather") + BOOKED + """
SELECT booking_id, player_id, CAST(booking_date AS TIMESTAMP) + to_hours(hour) AS tee_time,
  CASE WHEN reject_reason IS NULL THEN amount END AS price_paid,
  CASE WHEN reject_reason IS NULL THEN 'confirmed' ELSE 'rejected' END AS booking_status,
  booking_date AS round_date, CAST(NULL AS DOUBLE) AS score_prediction, CAST(round_number AS INTEGER) AS round_number, booking_time, reject_reason FROM judged"""


@query("book_requests", BOOK_SQL)
def book_requests(spark: SparkSession, sf: str) -> DataFrame:
    asked, weather = D.booking_requests(spark, sf), D.weather_once(spark, sf)
    players, rounds = _stats(spark, sf, weather, asked)
    return bookings.book(asked, players, rounds, weather)


_NEWCOMERS = with_views("", "requests", "players", "handicaps", "rounds", "weather") + """
, first AS (
  SELECT player_name, handicap, booking_id FROM requests WHERE event_type = 'signup' AND player_name IS NOT NULL
    AND player_name NOT IN (SELECT player_name FROM players WHERE registered)
  QUALIFY row_number() OVER (PARTITION BY player_name ORDER BY booking_id) = 1
), known AS (
  SELECT player_id, player_name, h.handicap FROM players p LEFT JOIN handicaps h USING (player_id) WHERE registered
  UNION ALL SELECT (SELECT max(player_id) FROM players WHERE registered) + row_number() OVER (ORDER BY booking_id), player_name, handicap FROM first
)""" + (
    BOOKED.replace("'purchase'", "'signup'")
    .replace("LEFT JOIN players p", "LEFT JOIN known p")
    .replace("  LEFT JOIN handicaps h ON p.player_id = h.player_id\n", "")
    .replace("h.handicap AS", "p.handicap AS")
    .replace("FROM rounds GROUP BY 1", "FROM rounds WHERE player_id IN (SELECT player_id FROM players WHERE registered) GROUP BY 1")
)


@query("book_newcomers", _NEWCOMERS + """
SELECT booking_id, player_id, CAST(booking_date AS TIMESTAMP) + to_hours(hour) AS tee_time, amount AS price_paid,
  'confirmed' AS booking_status, booking_date AS round_date, CAST(NULL AS DOUBLE) AS score_prediction, booking_time
FROM judged WHERE reject_reason IS NULL""")
def book_newcomers(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups that book at once: registered, booked and stored, and the stored table read back."""
    asked, weather = D.registrations(spark, sf), D.weather_once(spark, sf)
    registered = D.players(spark, sf, existing=True).drop("handicap")
    rounds = materialize(D.rounds(spark, sf, weather).join(registered, "player_id", "left_semi"))
    players = registered.join(player_stats.handicaps(rounds), "player_id", "left")
    booked, fresh = bookings.book_with_newcomers(asked, players, rounds, weather)
    store = ParquetTables(spark, shared_folder(spark))
    store.append(bookings.booking_records(booked), "bookings")
    store.append(fresh, "players")
    return store.read("bookings")


def _training_set(spark: SparkSession, sf: str, adjusted: bool = False) -> DataFrame:
    weather = D.weather_once(spark, sf)
    rounds = materialize(D.adjusted_rounds(spark, sf, weather) if adjusted else D.rounds(spark, sf, weather))
    return features.training_set(rounds, player_stats.handicaps(rounds), weather)


def training(spark: SparkSession, sf: str, adjusted: bool = False) -> DataFrame:
    return features.complete_rows(features.engineer_features(_training_set(spark, sf, adjusted)))


@query("engineer_features", "SELECT * FROM features", ("features",))
def engineer_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.engineer_features(_training_set(spark, sf))


@query("training_features", "SELECT * FROM complete", ("complete",))
def training_features(spark: SparkSession, sf: str) -> DataFrame:
    return training(spark, sf)


@query("training_rejects", """
SELECT count(*) AS rows, (SELECT count(*) FROM complete) AS kept, """ + ", ".join(
    f"count(*) - count({c}) AS {c}" for c in ["score", *features.BASE_FEATURES]) + " FROM training", ("training", "complete"))
def training_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return features.training_rejects(_training_set(spark, sf))


_SCALED = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM complete)) / (SELECT stddev_pop({c}) FROM complete), 6) AS {c}"
    for c in features.SCALED
)


@query("scale_features", f"SELECT round_id, {_SCALED}, wind_precip, weekend FROM complete", ("complete",))
def scale_features(spark: SparkSession, sf: str) -> DataFrame:
    frame = materialize(training(spark, sf))
    scaled = features.apply_scaler(frame, features.scaler_stats(frame))
    return scaled.select("round_id", *[F.round(c, 6).alias(c) for c in features.SCALED], "wind_precip", "weekend")


@query("train_test_split", f"""
SELECT round_id, CASE WHEN {hash_sql('round_id', 42)} % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM rounds""", ("rounds",))
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounds(spark, sf).select("round_id", features.split_flag().alias("split"))
