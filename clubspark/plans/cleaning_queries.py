"""Scans, reshaping and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubspark.functions import columns as C
from clubspark.operators import ranking, reshape, scoring
from clubspark.plans import domain as D
from clubspark.plans.registry import hash_sql, query, with_views
from clubspark.session import shared_folder
from clubspark.sources import files, tables


@query("scan_table", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.ParquetTables(spark, sf, suffix=".parquet").read("customer").select("c_custkey", "c_name", "c_mktsegment")


@query(
    "scan_query",
    "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment",
)
def scan_query(spark: SparkSession, sf: str) -> DataFrame:
    store = tables.ParquetTables(spark, sf, suffix=".parquet")
    return store.query(
        "SELECT c_mktsegment, count(*) AS customers FROM {customer} WHERE c_acctbal > 0 GROUP BY c_mktsegment"
    )


@query(
    "param_lookup",
    "SELECT c_custkey AS player_id, c_name AS player_name FROM customer WHERE c_name = 'Customer#000000007'",
)
def param_lookup(spark: SparkSession, sf: str) -> DataFrame:
    store = tables.ParquetTables(spark, sf, suffix=".parquet")
    return store.query(
        "SELECT c_custkey AS player_id, c_name AS player_name FROM {customer} WHERE c_name = :name",
        {"name": C_NAME},
    )


C_NAME = "Customer#000000007"


@query("scan_csv", """
SELECT scorecard_id, player_name AS "Name", r1, r2, r3, r4 FROM scorecards""", ("scorecards",))
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Scorecards written as CSV with a header and read back with the declared schema."""
    path = shared_folder(spark)
    cards = D.scorecards(spark, sf)
    files.write_csv(cards, path)
    back = files.read_csv(spark, path, cards.schema)
    return back.select(
        "scorecard_id", "Name", *[F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(reshape.ROUND_COLUMNS, 1)]
    )


@query(
    "append_rounds",
    """SELECT round_id, player_id, round_date, score FROM adjusted
UNION ALL SELECT round_id, player_id, round_date, score FROM adjusted""",
    ("adjusted",),
)
def append_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends of the same rounds: rounds are stored again on every run."""
    store = tables.ParquetTables(spark, shared_folder(spark))
    rounds = D.adjusted_rounds(spark, sf)
    store.append(rounds, "rounds")
    store.append(rounds, "rounds")
    return store.read("rounds").select("round_id", "player_id", "round_date", "score")


@query(
    "filter_not_null",
    "SELECT scorecard_id, player_name FROM scorecards WHERE player_name IS NOT NULL",
    ("scorecards",),
)
def filter_not_null(spark: SparkSession, sf: str) -> DataFrame:
    cards = D.scorecards(spark, sf).where(F.col("Name").isNotNull())
    return cards.select("scorecard_id", F.col("Name").alias("player_name"))


@query("unpivot_rounds", "SELECT scorecard_id, player_name, round_number, score FROM rounds_raw", ("rounds_raw",))
def unpivot_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.unpivot_rounds(D.scorecards(spark, sf))


@query("filter_played", "SELECT round_id, player_name, score FROM rounds_raw WHERE score > 0", ("rounds_raw",))
def filter_played(spark: SparkSession, sf: str) -> DataFrame:
    rounds = reshape.with_round_id(reshape.unpivot_rounds(D.scorecards(spark, sf)))
    return reshape.played(rounds).select("round_id", "player_name", "score")


@query("clean_weather", "SELECT * FROM weather", ("weather",))
def clean_weather(spark: SparkSession, sf: str) -> DataFrame:
    return D.weather(spark, sf)


@query("convert_units", """
SELECT date, avg_temp, round(wind_speed * 0.621371, 2) AS wind_speed,
  round((avg_temp - 32) * 5 / 9, 2) AS celsius FROM weather_f""", ("weather_f",))
def convert_units(spark: SparkSession, sf: str) -> DataFrame:
    w = reshape.convert_units(D.weather(spark, sf), temp_unit="C", wind_unit="kmh")
    return w.select("date", "avg_temp", "wind_speed", F.round(C.f_to_c(F.col("avg_temp")), 2).alias("celsius"))


@query("calendar_columns", """
SELECT round_id, dayname(round_date) AS day_of_week, CAST(isodow(round_date) - 1 AS INTEGER) AS day_of_week_int,
  CAST(month(round_date) AS INTEGER) AS month, CAST(year(round_date) AS INTEGER) AS year FROM rounds_raw""", ("rounds_raw",))
def calendar_columns(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("round_id", "day_of_week", "day_of_week_int", "month", "year")
    return reshape.calendar_columns(D.rounds_raw(spark, sf), "round_date").select(*cols)


@query("season_column", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring'
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season FROM orders""")
def season_column(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "orders").select("o_orderkey", C.season(F.col("o_orderdate")).alias("season"))


@query("normalize_name", """
SELECT c_custkey, array_to_string(list_transform(
    regexp_extract_all(trim('  ' || lower(c_mktsegment) || '''' || c_name || '-mc' || lower(c_mktsegment) || ' '), '[A-Za-z]+|[^A-Za-z]+'),
    lambda run: upper(run[1]) || lower(run[2:])), '') AS player_name FROM customer""")
def normalize_name(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.lower("c_mktsegment")
    typed = F.concat(F.lit("  "), segment, F.lit("'"), F.col("c_name"), F.lit("-mc"), segment, F.lit(" "))
    return D.table(spark, sf, "customer").select("c_custkey", C.normalize_name(typed).alias("player_name"))


@query("assign_dates", "SELECT round_id, round_date FROM rounds_raw", ("rounds_raw",))
def assign_dates(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounds_raw(spark, sf).select("round_id", "round_date")


_WEIGHTED = f"""
, days AS (
  SELECT CAST(unnest(generate_series(DATE '2017-04-01', DATE '2022-10-30', INTERVAL 1 DAY)) AS DATE) AS day
), slots AS (
  SELECT row_number() OVER (ORDER BY day, copy) - 1 AS slot, day
  FROM days, (VALUES (1), (2), (3), (4)) AS copies(copy) WHERE copy = 1 OR isodow(day) >= 6
), redated AS (
  SELECT round_id, player_id, score, day AS round_date
  FROM rounds JOIN slots ON {hash_sql('round_id', 1)} % (SELECT count(*) FROM slots) = slot
)
"""


@query("assign_dates_weighted", with_views("", "rounds") + _WEIGHTED + "SELECT * FROM redated")
def assign_dates_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.assign_dates_weighted(D.rounds(spark, sf))


@query("sample_rows", f"SELECT round_id, score FROM rounds ORDER BY {hash_sql('round_id', 42)}, round_id LIMIT 10", ("rounds",))
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.sample_rows(D.rounds(spark, sf).select("round_id", "score"))


@query("apply_defaults", """
SELECT event_id AS booking_id, user_id AS player_id, 75.0::DOUBLE AS price_paid, 'confirmed' AS booking_status,
  CAST(NULL AS DOUBLE) AS score_prediction FROM events WHERE event_type = 'purchase'""")
def apply_defaults(spark: SparkSession, sf: str) -> DataFrame:
    out = reshape.apply_defaults(D.bookings(spark, sf), "bookings")
    return out.select("booking_id", "player_id", "price_paid", "booking_status", "score_prediction")


@query("adjust_scores", "SELECT * FROM adjusted", ("adjusted",))
def adjust_scores(spark: SparkSession, sf: str) -> DataFrame:
    return D.adjusted_rounds(spark, sf)


@query("adjust_scores_compound", """
SELECT round_id, player_id, round_date, CAST(score + coalesce(delta, 0) *
  (row_number() OVER (PARTITION BY player_id ORDER BY round_id DESC) + 1) AS INTEGER) AS score
FROM rounds LEFT JOIN deltas ON round_date = date""", ("rounds", "deltas"))
def adjust_scores_compound(spark: SparkSession, sf: str) -> DataFrame:
    weather = D.weather_once(spark, sf)
    return scoring.adjust_scores_compounded(D.rounds(spark, sf, weather), weather)


@query("adjust_scores_eda", """
SELECT round_id, player_id, CAST(score
  + CASE WHEN avg_temp < 50 THEN 3 WHEN avg_temp > 95 THEN 2 WHEN avg_temp > 80 THEN -1 ELSE 0 END
  + CASE WHEN wind_speed > 15 THEN 3 WHEN wind_speed > 10 THEN 2 WHEN wind_speed < 3 THEN -1 ELSE 0 END
  + CASE WHEN precipitation > 10 THEN 3 WHEN precipitation > 0 THEN 1 WHEN precipitation = 0 THEN -1 ELSE 0 END
  + CASE WHEN day_of_week_int IN (5, 6) THEN -1 WHEN day_of_week_int IN (0, 1) THEN 1 ELSE 0 END
  + CASE WHEN round_number > 10 THEN -1 WHEN round_number > 50 THEN -2 WHEN round_number > 125 THEN -3
         WHEN round_number = 1 THEN 1 ELSE 0 END AS INTEGER) AS score
FROM numbered LEFT JOIN weather_f ON round_date = date""", ("numbered", "weather_f"))
def adjust_scores_eda(spark: SparkSession, sf: str) -> DataFrame:
    weather = D.weather_once(spark, sf)
    out = scoring.adjust_scores_exploratory(ranking.round_numbers(D.rounds(spark, sf, weather)), weather)
    return out.select("round_id", "player_id", "score")


@query("round_numbers", "SELECT round_id, player_id, round_date, round_number FROM numbered", ("numbered",))
def round_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rounds = D.rounds(spark, sf).select("round_id", "player_id", "round_date")
    return ranking.round_numbers(rounds)
