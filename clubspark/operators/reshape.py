"""Cleaning and reshaping of scorecards and weather."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clubspark.functions import columns as C

# The scorecard's round columns, the first weather day kept, the
# years, months and days a round may fall on, the weighted calendar.
ROUND_COLUMNS = ("Open.R1", "Open.R2", "Open.R3", "Open.R4")
FIRST_WEATHER_DAY = "2017-04-01"
YEARS = (2017, 6)
MONTHS = (4, 7)
DAYS = (1, 28)
WEIGHTED_CALENDAR = ("2017-04-01", "2022-10-30")
WEEKEND_WEIGHT = 4


def unpivot_rounds(wide: DataFrame, ids: Sequence[str] = ("scorecard_id",)) -> DataFrame:
    """One row per round of each named scorecard: ids, player_name, round_number, score."""
    numbers = [str(k) for k in range(1, len(ROUND_COLUMNS) + 1)]
    scores = [F.col(f"`{name}`").alias(k) for name, k in zip(ROUND_COLUMNS, numbers)]
    long = (
        wide.select(*ids, "Name", *scores)
        .where(F.col("Name").isNotNull())
        .unpivot([*ids, "Name"], [f"`{k}`" for k in numbers], "label", "score")
    )
    return long.select(
        *ids,
        F.col("Name").alias("player_name"),
        F.col("label").cast("int").alias("round_number"),
        F.col("score").cast("int").alias("score"),
    )


def with_round_id(rounds: DataFrame) -> DataFrame:
    """Give each unpivoted round an id of its own, stable over reruns."""
    rounds_per_card = len(ROUND_COLUMNS)
    return rounds.withColumn(
        "round_id", F.col("scorecard_id").cast("bigint") * rounds_per_card + F.col("round_number")
    )


def played(rounds: DataFrame) -> DataFrame:
    """Drop missed cuts (score 0) and unknown scores."""
    return rounds.where(F.col("score") > 0)


def drop_zero_scores(rounds: DataFrame) -> DataFrame:
    """The exploratory form of :func:`played`: only zeros go, unknown scores stay."""
    return rounds.where(F.col("score").isNull() | (F.col("score") != 0))


def assign_dates(rounds: DataFrame, seed: int = 0, id_col: str = "round_id") -> DataFrame:
    """Give each round a repeatable date spread over the playing seasons.

    The draw always yields a date; saying so spares later joins a null check
    that would draw again.
    """
    h = C.portable_hash(F.col(id_col), seed)

    def draw(step: int, span: tuple[int, int]) -> Column:
        first, count = span
        return (C.idiv(h, step) % count + first).cast("int")

    date = F.make_date(draw(1, YEARS), draw(YEARS[1], MONTHS), draw(YEARS[1] * MONTHS[1], DAYS))
    first_day = F.lit(datetime.date(YEARS[0], MONTHS[0], DAYS[0]))
    return rounds.withColumn("round_date", F.coalesce(date, first_day))


def weighted_calendar(spark: SparkSession) -> DataFrame:
    """(slot, date): every day of the calendar, weekend days several times.

    The calendar is fixed, so the table has a fixed number of rows (3,791).
    """
    first, last = (F.lit(d).cast("date") for d in WEIGHTED_CALENDAR)
    day = F.explode(F.sequence(first, last)).alias("date")
    weight = F.when(F.weekday("date") >= 5, WEEKEND_WEIGHT).otherwise(1)
    slots = (
        spark.range(1, numPartitions=1)
        .select(day)
        .select("date", F.explode(F.sequence(F.lit(1), weight)).alias("copy"))
    )
    return slots.select(
        (F.row_number().over(Window.orderBy("date", "copy")) - 1).cast("bigint").alias("slot"), "date"
    )


def assign_dates_weighted(rounds: DataFrame, seed: int = 1, id_col: str = "round_id") -> DataFrame:
    """Reassign round dates, weekend days being drawn four times as often."""
    calendar = weighted_calendar(rounds.sparkSession)
    total = calendar.agg(F.count(F.lit(1))).scalar()
    slot = C.portable_hash(F.col(id_col), seed) % total
    return (
        rounds.drop("round_date")
        .withColumn("slot", slot)
        .join(F.broadcast(calendar.withColumnRenamed("date", "round_date")), "slot")
        .drop("slot")
    )


def clean_weather(
    raw: DataFrame,
    tie_break: Sequence[str] = ("tavg", "prcp", "wspd"),
    dow_convention: str = "monday0",
    since: str | None = FIRST_WEATHER_DAY,
) -> DataFrame:
    """One weather row per day: the first by ``tie_break``.

    The smallest leading key per day is found by a hash aggregation, whose
    result (one row per calendar day) then thins out the readings, so only the
    few that share it are ranked.  The rank filter again keeps one row per day
    and map task before the shuffle.  No day reaches one task whole.
    """
    day = raw.withColumn("date", F.to_date("time")).where(F.col("date").isNotNull())
    if since is not None:
        day = day.where(F.col("date") >= F.lit(since).cast("date"))
    lead = tie_break[0]
    leads = day.groupBy(F.col("date").alias("_date")).agg(F.min(lead).alias("_lead"))
    leading = (F.col("date") == F.col("_date")) & F.col(lead).eqNullSafe(F.col("_lead"))
    first = Window.partitionBy("date").orderBy(*[F.col(c).asc_nulls_last() for c in tie_break])
    return (
        day.join(F.broadcast(leads), leading)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .select(
            "date",
            F.col("tavg").alias("avg_temp"),
            F.col("prcp").alias("precipitation"),
            F.col("wspd").alias("wind_speed"),
            C.weekday_name(F.col("date")).alias("day_of_week"),
            C.weekday_int(F.col("date"), dow_convention).alias("day_of_week_int"),
        )
    )


def convert_units(weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph") -> DataFrame:
    """Weather in Fahrenheit and miles per hour, rounded to two places."""
    out = weather
    if temp_unit == "C":
        out = out.withColumn("avg_temp", F.round(C.c_to_f(F.col("avg_temp")), 2))
    elif temp_unit != "F":
        raise ValueError(f"unknown temp_unit {temp_unit!r}")
    if wind_unit == "kmh":
        out = out.withColumn("wind_speed", F.round(C.km_to_miles(F.col("wind_speed")), 2))
    elif wind_unit != "mph":
        raise ValueError(f"unknown wind_unit {wind_unit!r}")
    return out


def to_celsius(weather: DataFrame, temp_unit: str = "C") -> DataFrame:
    """Weather with the temperature in Celsius, for the rules that are stated in it."""
    if temp_unit == "C":
        return weather
    if temp_unit == "F":
        return weather.withColumn("avg_temp", C.f_to_c(F.col("avg_temp")))
    raise ValueError(f"unknown temp_unit {temp_unit!r}")


def calendar_columns(df: DataFrame, date_col: str, dow_convention: str = "monday0") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns(
        {
            "day_of_week": C.weekday_name(d),
            "day_of_week_int": C.weekday_int(d, dow_convention),
            "month": F.month(d),
            "year": F.year(d),
            "season": C.season(d),
        }
    )


def sample_rows(df: DataFrame, n: int = 10, seed: int = 42, id_col: str = "round_id") -> DataFrame:
    """n rows drawn by hash: a bounded top-n, not a sort of the whole table."""
    return (
        df.withColumn("_draw", C.portable_hash(F.col(id_col), seed))
        .orderBy("_draw", id_col)
        .limit(n)
        .drop("_draw")
    )


def apply_defaults(df: DataFrame, table: str, fill_nulls: bool = False) -> DataFrame:
    """Add the columns a writer left out, with their declared defaults.

    A null the writer gave stays null, as in SQL, unless ``fill_nulls``.
    """
    from clubspark.schemas import DEFAULTS, TABLES

    out = df
    for name, value in DEFAULTS.get(table, {}).items():
        default = F.lit(value).cast(TABLES[table][name].dataType)
        if name not in df.columns:
            out = out.withColumn(name, default)
        elif fill_nulls and value is not None:
            out = out.withColumn(name, F.coalesce(F.col(name), default))
    return out
