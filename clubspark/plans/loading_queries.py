"""Joins, loads, per-player state and data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clubspark.deliveries import Deliveries
from clubspark.operators import loading, player_stats, quality, reshape
from clubspark.operators import reports as R
from clubspark.plans import domain as D
from clubspark.plans.booking_queries import _training_set
from clubspark.plans.registry import differential_sql, handicap_sql, query, with_views
from clubspark.schemas import SCORECARDS, WEATHER_RAW
from clubspark.session import materialize, shared_folder
from clubspark.sources.files import write_csv
from clubspark.sources.tables import ParquetTables
from clubspark.venue import Venue

_FIRST_SEEN = """, first_seen AS (
  SELECT player_name, min(scorecard_id) AS first_seen FROM scorecards WHERE player_name IS NOT NULL GROUP BY player_name
)
"""
_NEW_IDS = _FIRST_SEEN + """, fresh AS (
  SELECT (SELECT max(player_id) FROM players WHERE registered) + row_number() OVER (ORDER BY first_seen) AS player_id, player_name
  FROM first_seen WHERE player_name NOT IN (SELECT player_name FROM players WHERE registered)
)
"""


@query("distinct_players", "SELECT DISTINCT player_name FROM rounds_raw", ("rounds_raw",))
def distinct_players(spark: SparkSession, sf: str) -> DataFrame:
    return loading.player_names(D.scorecards(spark, sf)).select("player_name")


@query(
    "assign_player_ids",
    with_views("", "scorecards") + _FIRST_SEEN + "SELECT row_number() OVER (ORDER BY first_seen) AS player_id, player_name FROM first_seen",
)
def assign_player_ids(spark: SparkSession, sf: str) -> DataFrame:
    return loading.assign_player_ids(loading.player_names(D.scorecards(spark, sf)))


@query(
    "new_players",
    """SELECT DISTINCT player_name FROM scorecards WHERE player_name IS NOT NULL
AND player_name NOT IN (SELECT player_name FROM players WHERE registered)""",
    ("scorecards", "players"),
)
def new_players(spark: SparkSession, sf: str) -> DataFrame:
    names = loading.player_names(D.scorecards(spark, sf))
    return loading.new_players(names, D.players(spark, sf, existing=True)).select("player_name")


@query("load_players", with_views("", "scorecards", "players") + _NEW_IDS + """
SELECT player_id, player_name, 'guest' AS member_status, CAST(NULL AS DOUBLE) AS handicap, 0 AS rounds_played FROM fresh
UNION ALL SELECT player_id, player_name, member_status, handicap, rounds_played FROM players WHERE registered""")
def load_players(spark: SparkSession, sf: str) -> DataFrame:
    existing = D.players(spark, sf, existing=True)
    return loading.load_players(D.scorecards(spark, sf), existing).union(existing)


@query("new_weather", "SELECT * FROM weather WHERE date >= DATE '2020-01-01'", ("weather",))
def new_weather(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = D.weather_once(spark, sf)
    stored = cleaned.where(F.col("date") < F.lit(D.WEATHER_LOADED_TO).cast("date"))
    return loading.new_weather(cleaned, stored)


@query("load_weather", "SELECT * FROM weather", ("weather",))
def load_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Stored days plus the new ones: each day once."""
    cleaned = D.weather_once(spark, sf)
    stored = cleaned.where(F.col("date") < F.lit(D.WEATHER_LOADED_TO).cast("date"))
    return stored.union(loading.new_weather(cleaned, stored))


@query("rounds_with_player_id", """
SELECT round_id, player_id, r.player_name, score FROM rounds_raw r JOIN players p ON r.player_name = p.player_name WHERE registered""",
       ("rounds_raw", "players"))
def rounds_with_player_id(spark: SparkSession, sf: str) -> DataFrame:
    cards = D.scorecards(spark, sf).withColumnRenamed("Name", "player_name")
    known = loading.with_player_id(cards, D.players(spark, sf, existing=True))
    long = reshape.unpivot_rounds(known.withColumnRenamed("player_name", "Name"), ids=("scorecard_id", "player_id"))
    return reshape.with_round_id(long).select("round_id", "player_id", "player_name", "score")


@query("rounds_with_weather", """
SELECT round_id, player_name, round_date, score FROM rounds_raw WHERE round_date IN (SELECT date FROM weather)""",
       ("rounds_raw", "weather"))
def rounds_with_weather(spark: SparkSession, sf: str) -> DataFrame:
    kept = loading.with_known_weather(D.rounds_raw(spark, sf), D.weather_dates(spark, sf))
    return kept.select("round_id", "player_name", "round_date", "score")


_LOADED = """
SELECT round_id, player_id, r.player_name, round_date, CAST(score + coalesce(delta, 0) AS INTEGER) AS score
FROM rounds_raw r JOIN players p ON r.player_name = p.player_name JOIN deltas ON round_date = date
WHERE score > 0"""


@query("load_rounds", _LOADED + " AND o_orderdate >= TIMESTAMP '1999-01-01'", ("rounds_raw", "players", "deltas"))
def load_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The scorecards that came in since the last load, as stored rounds."""
    fresh = D.scorecards(spark, sf, loaded=False)
    out = loading.load_rounds(fresh, D.players(spark, sf), D.weather_once(spark, sf))
    return out.select("round_id", "player_id", "player_name", "round_date", "score")


@query("load_audit", """
SELECT 'players' AS table_name, count(DISTINCT player_name) AS found, (SELECT count(*) FROM players WHERE registered) AS existing,
  count(DISTINCT CASE WHEN player_name NOT IN (SELECT player_name FROM players WHERE registered) THEN player_name END) AS new,
  0 AS rejected, (SELECT count(*) FROM players WHERE registered) + count(DISTINCT CASE WHEN player_name NOT IN
    (SELECT player_name FROM players WHERE registered) THEN player_name END) AS final FROM scorecards
UNION ALL
SELECT 'weather', count(*), count(CASE WHEN date < DATE '2020-01-01' THEN 1 END), count(CASE WHEN date >= DATE '2020-01-01' THEN 1 END), 0, count(*)
FROM weather
UNION ALL
SELECT 'rounds', count(*), (SELECT count(*) FROM rounds),
  count(CASE WHEN score > 0 AND round_date IN (SELECT date FROM weather) THEN 1 END),
  count(CASE WHEN NOT (score > 0 AND round_date IN (SELECT date FROM weather)) THEN 1 END),
  (SELECT count(*) FROM rounds) + count(CASE WHEN score > 0 AND round_date IN (SELECT date FROM weather) THEN 1 END)
FROM rounds_raw""", ("scorecards", "players", "weather", "rounds", "rounds_raw"))
def load_audit(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = materialize(D.weather_dates(spark, sf))
    stored_days = cleaned.where(F.col("date") < F.lit(D.WEATHER_LOADED_TO).cast("date"))
    return loading.load_audit(
        D.scorecards(spark, sf), D.players(spark, sf, existing=True), cleaned, stored_days, D.rounds(spark, sf, cleaned)
    )


@query("handicaps", "SELECT * FROM handicaps", ("handicaps",))
def handicaps(spark: SparkSession, sf: str) -> DataFrame:
    return player_stats.handicaps(D.rounds(spark, sf))


@query("handicaps_eda", f"""
SELECT player_id, {handicap_sql('total', 'kept')} AS handicap FROM (
  SELECT player_id, sum({differential_sql('score')}) AS total, count(*) AS kept FROM (
    SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY round_id) AS rn, count(*) OVER (PARTITION BY player_id) AS n FROM rounds)
  WHERE rn = 1 OR rn > n - least(20, n) + 1 GROUP BY player_id)""", ("rounds",))
def handicaps_eda(spark: SparkSession, sf: str) -> DataFrame:
    return player_stats.handicaps_file_order(D.rounds(spark, sf))


@query("membership", """
SELECT player_id, CASE WHEN n >= 30 THEN 'member' ELSE 'guest' END AS member_status
FROM (SELECT player_id, count(*) AS n FROM rounds GROUP BY player_id)""", ("rounds",))
def membership(spark: SparkSession, sf: str) -> DataFrame:
    counts = player_stats.round_counts(D.rounds(spark, sf))
    return counts.select("player_id", player_stats.membership(F.lit("guest"), F.col("rounds")).alias("member_status"))


PLAYER_STATS_SQL = with_views(f"""
SELECT p.player_id, player_name, CASE WHEN coalesce(n, 0) >= 30 THEN 'member' ELSE 'guest' END AS member_status,
  h.handicap, CAST(coalesce(n, 0) AS INTEGER) AS rounds_played
FROM players p
LEFT JOIN (SELECT player_id, count(*) AS n FROM adjusted GROUP BY player_id) c ON p.player_id = c.player_id
LEFT JOIN (SELECT player_id, {handicap_sql('total', 'n')} AS handicap FROM (
  SELECT player_id, sum({differential_sql('score')}) AS total, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY round_date DESC, round_id DESC) AS age FROM adjusted)
  WHERE age <= 20 GROUP BY player_id)) h ON p.player_id = h.player_id""", "players", "adjusted")


@query("player_stats", PLAYER_STATS_SQL)
def stats_of_players(spark: SparkSession, sf: str) -> DataFrame:
    return player_stats.player_stats(
        D.players(spark, sf), D.adjusted_rounds(spark, sf, D.weather_once(spark, sf))
    )


_BY_NAME = with_views("", "rounds_raw", "deltas") + f"""
, stored AS (
  SELECT player_name, round_id, round_date, CAST(score + coalesce(delta, 0) AS INTEGER) AS score
  FROM rounds_raw JOIN deltas ON round_date = date WHERE score > 0
)
SELECT names.player_name, CASE WHEN coalesce(n, 0) >= 30 THEN 'member' ELSE 'guest' END AS member_status,
  h.handicap, CAST(coalesce(n, 0) AS INTEGER) AS rounds_played
FROM (SELECT DISTINCT player_name FROM rounds_raw) AS names
LEFT JOIN (SELECT player_name, count(*) AS n FROM stored GROUP BY 1) c ON names.player_name = c.player_name
LEFT JOIN (SELECT player_name, {handicap_sql('total', 'n')} AS handicap FROM (
  SELECT player_name, sum({differential_sql('score')}) AS total, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY player_name ORDER BY round_date DESC, round_id DESC) AS age FROM stored)
  WHERE age <= 20 GROUP BY player_name)) h ON names.player_name = h.player_name"""


@query("incremental_loads", _BY_NAME)
def incremental_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries loaded one after the other into stored tables, then the player table."""
    venue = Venue(ParquetTables(spark, shared_folder(spark)))
    for load_id, loaded in enumerate((True, False), start=1):
        venue.load(
            D.scorecards(spark, sf, loaded=loaded),
            D.weather_raw(spark, sf, reshape.FIRST_WEATHER_DAY),
            load_id,
            tie_break=D.TIE_BREAK,
        )
    return venue.players().select("player_name", "member_status", "handicap", "rounds_played")


@query("file_deliveries", """
SELECT names.player_name, CASE WHEN coalesce(n, 0) >= 30 THEN 'member' ELSE 'guest' END AS member_status, CAST(coalesce(n, 0) AS INTEGER) AS rounds_played
FROM (SELECT DISTINCT player_name FROM rounds_raw) AS names
LEFT JOIN (SELECT player_name, count(*) AS n FROM rounds_raw WHERE score > 0 GROUP BY 1) c ON names.player_name = c.player_name""", ("rounds_raw",))
def file_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """CSV deliveries in a folder: the second call finds the first delivery again and a new one, the third nothing new.

    The weather files name every day, so that all played rounds are kept whatever dates their ids draw.
    """
    folder = shared_folder(spark)
    venue = Venue(ParquetTables(spark, f"{folder}/tables"))
    arrivals = Deliveries(venue, scorecards="scorecards*/*.csv", weather="weather*/*.csv")
    days = F.explode(F.sequence(F.lit("2017-04-01").cast("date"), F.lit("2022-12-31").cast("date"))).alias("time")
    weather = _all_columns(spark.range(1).select(days, F.lit(20.0).alias("tavg"), F.lit(0.0).alias("prcp")), WEATHER_RAW)
    for number, loaded in enumerate((True, False)):
        write_csv(_all_columns(D.scorecards(spark, sf, loaded=loaded), SCORECARDS), f"{folder}/in/scorecards{number}")
        write_csv(weather, f"{folder}/in/weather{number}")
        arrivals.load_all(f"{folder}/in")
    arrivals.load_all(f"{folder}/in")
    return venue.players().select("player_name", "member_status", "rounds_played")


def _all_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a declared file, null where there are none."""
    return df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


@query("round_counts", """
SELECT p.player_id, player_name, count(round_id) AS round_count
FROM players p LEFT JOIN rounds r ON p.player_id = r.player_id GROUP BY p.player_id, player_name""", ("players", "rounds"))
def round_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounds_per_player(D.players(spark, sf), D.rounds(spark, sf))


@query("best_per_player", """
SELECT n.player_id, round_id, round_date, score, CAST(round_number AS BIGINT) AS round_number, handicap
FROM numbered n JOIN handicaps h ON n.player_id = h.player_id
QUALIFY row_number() OVER (PARTITION BY n.player_id ORDER BY round_number DESC) = 1""", ("numbered", "handicaps"))
def best_per_player(spark: SparkSession, sf: str) -> DataFrame:
    rounds = materialize(D.rounds(spark, sf))
    return R.best_per_player(rounds, player_stats.handicaps(rounds))


@query("check_unique", """
SELECT 'players' AS table_name, 'player_id' AS column_name, count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows
FROM (SELECT player_id, count(*) AS n FROM players GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'players', 'player_name', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT)
FROM (SELECT player_name, count(*) AS n FROM players GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'weather_raw', 'time', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT)
FROM (SELECT "time", count(*) AS n FROM weather_raw GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'rounds', 'round_id', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT)
FROM (SELECT round_id, count(*) AS n FROM rounds GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'bookings', 'player_id', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT)
FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 1)""",
       ("players", "weather_raw", "rounds"))
def check_unique(spark: SparkSession, sf: str) -> DataFrame:
    players = D.players(spark, sf)
    return quality.check_unique(
        [
            ("players", players, "player_id"),
            ("players", players, "player_name"),
            ("weather_raw", D.weather_raw(spark, sf), "time"),
            ("rounds", D.rounds(spark, sf), "round_id"),
            ("bookings", D.bookings(spark, sf), "player_id"),
        ]
    )


@query("check_columns", """
SELECT 'scorecards' AS table_name, 'Name' AS column_name, 'not_null' AS rule, count(*) - count(player_name) AS violations FROM scorecards
UNION ALL SELECT 'scorecards', 'Name', 'length', count(CASE WHEN length(player_name) > 100 THEN 1 END) FROM scorecards
UNION ALL SELECT 'weather_raw', 'tavg', 'not_null', count(*) - count(tavg) FROM weather_raw
UNION ALL SELECT 'weather_raw', 'wspd', 'not_null', count(*) - count(wspd) FROM weather_raw
UNION ALL SELECT 'events', 'event_type', 'length', count(CASE WHEN length(event_type) > 5 THEN 1 END) FROM events""",
       ("scorecards", "weather_raw"))
def check_columns(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_columns(
        [
            ("scorecards", D.scorecards(spark, sf), ["Name"], {"Name": 100}),
            ("weather_raw", D.weather_raw(spark, sf), ["tavg", "wspd"], {}),
            ("events", D.table(spark, sf, "events"), [], {"event_type": 5}),
        ]
    )


def _declared_sql() -> str:
    """Each declared rule as a statement of its own."""
    rows = []

    def add(table: str, column: str, rule: str, violations: str) -> None:
        rows.append(f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{rule}' AS rule, CAST({violations} AS BIGINT) AS violations")

    for table, columns in {
        "players": ["player_id", "player_name"],
        "weather": ["date"],
        "rounds": ["round_id", "player_name", "score"],
        "bookings": ["booking_id", "tee_time", "price_paid", "round_date", "booking_time"],
    }.items():
        for c in columns:
            add(table, c, "not_null", f"(SELECT count(*) FROM stored_{table} WHERE {c} IS NULL)")
    for table, column, n in [
        ("players", "player_name", 100), ("players", "member_status", 20), ("weather", "day_of_week", 20),
        ("rounds", "player_name", 100), ("bookings", "booking_status", 20),
    ]:
        add(table, column, "length", f"(SELECT count(*) FROM stored_{table} WHERE length({column}) > {n})")
    for table, c in [
        ("players", "player_id"), ("players", "player_name"), ("weather", "date"), ("rounds", "round_id"), ("bookings", "booking_id")
    ]:
        add(table, c, "unique", f"(SELECT count({c}) - count(DISTINCT {c}) FROM stored_{table})")
    for table, c, parent, key in [
        ("rounds", "player_id", "players", "player_id"), ("rounds", "round_date", "weather", "date"),
        ("bookings", "player_id", "players", "player_id"),
    ]:
        add(table, c, "reference", f"(SELECT count(*) FROM stored_{table} WHERE {c} NOT IN (SELECT {key} FROM stored_{parent}))")
    return "\nUNION ALL ".join(rows)


@query("check_declared", with_views("", "players", "weather", "rounds_raw") + """
, stored_players AS (SELECT * FROM players WHERE registered)
, stored_weather AS (SELECT * FROM weather)
, stored_rounds AS (SELECT r.*, p.player_id FROM rounds_raw r JOIN players p ON r.player_name = p.player_name WHERE score > 0)
, stored_bookings AS (
  SELECT event_id // 2 AS booking_id, user_id AS player_id, ts AS tee_time, CASE WHEN event_id % 7 <> 0 THEN value END AS price_paid,
    repeat(event_type, CAST(1 + event_id % 4 AS INTEGER)) AS booking_status, CAST(ts AS DATE) AS round_date, ts AS booking_time FROM events)
""" + _declared_sql())
def check_declared(spark: SparkSession, sf: str) -> DataFrame:
    """All declared rules over a venue's tables; the bookings are made of events so that rules of each kind are broken."""
    registered = D.players(spark, sf, existing=True)
    event = F.col("event_id")
    bookings = D.table(spark, sf, "events").select(
        F.floor(event / 2).alias("booking_id"),
        F.col("user_id").alias("player_id"),
        F.col("ts").alias("tee_time"),
        F.when(event % 7 != 0, F.col("value")).alias("price_paid"),
        F.repeat("event_type", (event % 4 + 1).cast("int")).alias("booking_status"),
        F.to_date("ts").alias("round_date"),
        F.col("ts").alias("booking_time"),
    )
    rounds = loading.rounds_from_scorecards(D.scorecards(spark, sf), D.players(spark, sf))
    return quality.check_declared(
        {"players": registered, "weather": D.weather_once(spark, sf), "rounds": rounds, "bookings": bookings}
    )


@query("check_foreign_keys", """
SELECT 'rounds.player_id' AS reference, count(DISTINCT player_id) AS orphan_keys, count(*) AS orphan_rows
FROM rounds WHERE player_id NOT IN (SELECT player_id FROM players WHERE registered)
UNION ALL SELECT 'rounds.round_date', count(DISTINCT round_date), count(*)
FROM rounds_raw WHERE round_date NOT IN (SELECT date FROM weather)
UNION ALL SELECT 'bookings.player_id', count(DISTINCT user_id), count(*)
FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT player_id FROM players WHERE registered)""",
       ("rounds", "rounds_raw", "players", "weather"))
def check_foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    players = D.players(spark, sf, existing=True)
    return quality.check_foreign_keys(
        [
            ("rounds.player_id", D.rounds(spark, sf), "player_id", players, "player_id"),
            ("rounds.round_date", D.rounds_raw(spark, sf), "round_date", D.weather_dates(spark, sf), "date"),
            ("bookings.player_id", D.bookings(spark, sf), "player_id", players, "player_id"),
        ]
    )


@query("training_set", "SELECT * FROM training", ("training",))
def training_set(spark: SparkSession, sf: str) -> DataFrame:
    return _training_set(spark, sf)
