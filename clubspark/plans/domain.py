"""The venue's tables as views of the benchmark tables.

A customer is a player, an order is a scorecard of four rounds, a line item is
a weather reading, a purchase event is a booking request and a sign-up event a
registration.  Only the columns a view needs are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clubspark.operators import loading, reshape, scoring
from clubspark.session import materialize

# Orders from this day on, and players of this segment, have not been loaded yet.
LOAD_DATE = "1999-01-01"
NEW_SEGMENT = "HOUSEHOLD"
# Weather before this day is already stored.
WEATHER_LOADED_TO = "2020-01-01"
WEATHER_YEARS = 22
TIE_BREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


# Declared, so that no query spends a job on reading file footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _round_scores() -> list[Column]:
    def score(k: int) -> Column:
        return 62 + (F.floor("o_totalprice").cast("bigint") + 37 * k + F.col("o_orderkey")) % 48

    scores = [score(1), score(2)] + [F.when(F.col("o_orderstatus") == "F", 0).otherwise(score(k)) for k in (3, 4)]
    return [s.cast("int").alias(name) for s, name in zip(scores, reshape.ROUND_COLUMNS)]


def _unnamed() -> Column:
    return (F.col("o_orderkey") % 97 == 96) | (F.col("o_custkey") % 25 == 24)


def _scorecards_from(orders: DataFrame, customers: DataFrame) -> DataFrame:
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.select(
        F.col("o_orderkey").alias("scorecard_id"),
        F.year("o_orderdate").alias("Year"),
        F.when(~_unnamed(), F.col("c_name")).alias("Name"),
        *_round_scores(),
    )


def scorecards(spark: SparkSession, sf_dir: str, loaded: bool | None = None) -> DataFrame:
    """Raw scorecards: all, those already loaded, or those still to load."""
    orders = table(spark, sf_dir, "orders")
    if loaded is not None:
        cut = F.lit(LOAD_DATE).cast("timestamp_ntz")
        orders = orders.where(F.col("o_orderdate") < cut if loaded else F.col("o_orderdate") >= cut)
    return _scorecards_from(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


def rounds_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivoted, dated rounds of the raw scorecards, missed cuts included."""
    return reshape.assign_dates(reshape.with_round_id(reshape.unpivot_rounds(scorecards(spark, sf_dir))))


def weather_raw(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """Weather readings, many per day; ``since`` becomes a filter on the stored date column."""
    # Shifting whole years keeps the day of the month, so day 13 goes by the stored column.
    li = table(spark, sf_dir, "lineitem").where(F.dayofmonth("l_shipdate") != 13)
    if since is not None:
        shifted = F.add_months(F.lit(since).cast("date"), -12 * WEATHER_YEARS).cast("timestamp_ntz")
        li = li.where(F.col("l_shipdate") >= shifted)
    day = F.add_months(F.to_date("l_shipdate"), 12 * WEATHER_YEARS)
    temp = ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 45 - 8).cast("double")
    rain = ((F.col("l_partkey") + F.col("l_suppkey") * 3) % 80) / F.lit(4.0)
    return li.select(
        day.alias("time"),
        F.when(F.col("l_partkey") % 53 != 0, temp).alias("tavg"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(rain).alias("prcp"),
        F.when(F.col("l_suppkey") % 41 != 0, F.col("l_quantity") / 2.0).alias("wspd"),
        *TIE_BREAK,
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean weather table: one row per day, Celsius and miles per hour."""
    raw = weather_raw(spark, sf_dir, reshape.FIRST_WEATHER_DAY)
    return reshape.clean_weather(raw, tie_break=TIE_BREAK)


def weather_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.convert_units(weather(spark, sf_dir))


def weather_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with weather, from the date column alone."""
    raw = weather_raw(spark, sf_dir, reshape.FIRST_WEATHER_DAY)
    return raw.select(F.col("time").alias("date")).distinct()


def players(spark: SparkSession, sf_dir: str, existing: bool = False) -> DataFrame:
    """The player table: all players, or those already registered."""
    customers = table(spark, sf_dir, "customer")
    if existing:
        customers = customers.where(F.col("c_mktsegment") != NEW_SEGMENT)
    return customers.select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("player_name"),
        F.lit("guest").alias("member_status"),
        F.lit(None).cast("double").alias("handicap"),
        F.lit(0).alias("rounds_played"),
    )


def rounds_from_orders(orders: DataFrame, days: DataFrame) -> DataFrame:
    """Stored rounds from an orders table or stream."""
    wide = orders.where(~_unnamed()).select(
        F.col("o_orderkey").alias("scorecard_id"),
        F.col("o_custkey").alias("player_id"),
        F.lit("").alias("Name"),
        *_round_scores(),
    )
    long = reshape.unpivot_rounds(wide, ids=("scorecard_id", "player_id"))
    dated = reshape.assign_dates(reshape.played(reshape.with_round_id(long)))
    return loading.with_known_weather(dated, days).select("round_id", "player_id", "round_date", "score")


def rounds(spark: SparkSession, sf_dir: str, days: DataFrame | None = None) -> DataFrame:
    """Stored rounds: played, on days with weather, keyed by player id; ``days`` is a weather table already at hand.

    A stored round carries its player id, so the customer table is not needed.
    """
    known = weather_dates(spark, sf_dir) if days is None else days.select("date")
    return rounds_from_orders(table(spark, sf_dir, "orders"), known)


def adjusted_rounds(spark: SparkSession, sf_dir: str, days: DataFrame | None = None) -> DataFrame:
    """Stored rounds with adjusted scores; ``days`` is a weather table already at hand."""
    days = weather_once(spark, sf_dir) if days is None else days
    return scoring.adjust_scores(rounds(spark, sf_dir, days), days)


def weather_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather table written once, for queries that join it more than once."""
    return materialize(weather(spark, sf_dir))


def requests_from_events(events: DataFrame, customers: DataFrame, kind: str) -> DataFrame:
    """Booking-form records of one event type; names as typed, untidy."""
    events = events.where(F.col("event_type") == kind)
    who = customers.select("c_custkey", "c_name")
    return events.join(who, events["user_id"] == who["c_custkey"], "left").select(
        F.col("event_id").alias("booking_id"),
        F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")).alias("player_name"),
        F.col("ts").alias("booking_time"),
        (F.col("event_id") % 15 + 6).cast("int").alias("hour"),
        (F.col("event_id") % 2 == 0).alias("cart"),
        F.date_add(F.lit("2017-04-01").cast("date"), (F.col("event_id") * 37 % 2000).cast("int")).alias("booking_date"),
        ((F.col("event_id") % 361) / 10.0).alias("handicap"),
        F.col("user_id").alias("player_id"),
    )


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return requests_from_events(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"), kind)


def booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "purchase").drop("handicap", "player_id")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "signup").drop("player_id")


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bookings, keyed by player id."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return events.select(
        F.col("event_id").alias("booking_id"),
        F.col("user_id").alias("player_id"),
        F.col("ts").alias("booking_time"),
    )
