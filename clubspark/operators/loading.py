"""Incremental loads of players, weather and rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.operators.ranking import dense_ids
from clubspark.operators.reshape import apply_defaults, assign_dates, played, unpivot_rounds, with_round_id
from clubspark.operators.scoring import adjust_scores


def player_names(scorecards: DataFrame) -> DataFrame:
    """(player_name, first_seen): distinct names with the first scorecard naming them."""
    return (
        scorecards.where(F.col("Name").isNotNull())
        .groupBy(F.col("Name").alias("player_name"))
        .agg(F.min("scorecard_id").alias("first_seen"))
    )


def new_players(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Names the player table does not hold yet."""
    return names.join(existing.select("player_name"), "player_name", "left_anti")


def assign_player_ids(names: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(player_id, player_name) in order of first appearance, above the ids in use."""
    start = None
    if existing is not None:
        start = existing.agg(F.coalesce(F.max("player_id"), F.lit(0).cast("bigint"))).scalar()
    return dense_ids(names, "first_seen", "player_id", start).select("player_id", "player_name")


def load_players(scorecards: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows to append to the player table for the new names."""
    fresh = assign_player_ids(new_players(player_names(scorecards), existing), existing)
    rows = apply_defaults(fresh.withColumn("handicap", F.lit(None).cast("double")), "players")
    return rows.select("player_id", "player_name", "member_status", "handicap", "rounds_played")


def new_weather(cleaned: DataFrame, existing: DataFrame) -> DataFrame:
    """Cleaned days the weather table does not hold yet."""
    return cleaned.join(existing.select("date"), "date", "left_anti")


def with_player_id(rounds: DataFrame, players: DataFrame) -> DataFrame:
    """Attach player ids by unique name; rows of unknown players go.

    Works on unpivoted rounds or, four times cheaper, on whole scorecards.
    """
    return rounds.join(players.select("player_id", "player_name"), "player_name")


def with_known_weather(rounds: DataFrame, weather: DataFrame) -> DataFrame:
    """Keep the rounds whose day has weather.  One date per calendar day is sent to all tasks."""
    days = F.broadcast(weather.select(F.col("date").alias("round_date")).distinct())
    return rounds.join(days, "round_date", "left_semi")


def rounds_from_scorecards(scorecards: DataFrame, players: DataFrame, seed: int = 0) -> DataFrame:
    """Dated, played rounds with player ids; the join runs before the unpivot."""
    known = with_player_id(scorecards.withColumnRenamed("Name", "player_name"), players)
    long = unpivot_rounds(known.withColumnRenamed("player_name", "Name"), ids=("scorecard_id", "player_id"))
    return assign_dates(played(with_round_id(long)), seed)


def load_rounds(
    scorecards: DataFrame,
    players: DataFrame,
    weather: DataFrame,
    existing: DataFrame | None = None,
    seed: int = 0,
    temp_unit: str = "C",
    wind_unit: str = "mph",
) -> DataFrame:
    """The rows to append to the round table, scores adjusted once.

    Rounds are appended on every run; with ``existing`` those already stored
    are left out.  Round numbers depend on later loads, so they are a view
    over the table (ranking.round_numbers), stored null.
    """
    rounds = with_known_weather(rounds_from_scorecards(scorecards, players, seed), weather)
    if existing is not None:
        rounds = rounds.join(existing.select("round_id"), "round_id", "left_anti")
    adjusted = adjust_scores(rounds, weather, temp_unit, wind_unit)
    return adjusted.select(
        "round_id", "player_id", "player_name", "round_date", "score", F.lit(None).cast("int").alias("round_number")
    )


def load_audit(
    scorecards: DataFrame, players: DataFrame, cleaned: DataFrame, weather: DataFrame, stored: DataFrame
) -> DataFrame:
    """Found, existing, new, rejected and final counts per table.

    ``players``, ``weather`` and ``stored`` are the tables before the load; rounds are
    checked against all players and all days known after it.  Names and rounds are counted in one pass
    over the scorecards: every named one has a row per round, so the rounds by name hold all names.
    """
    have_day = F.broadcast(
        cleaned.select("date").union(weather.select("date")).distinct().withColumn("known", F.lit(1))
    )
    cards = assign_dates(with_round_id(unpivot_rounds(scorecards)))
    refused = F.col("known").isNull() | ~(F.col("score") > 0) | F.col("score").isNull()
    by_name = (
        cards.join(have_day, cards["round_date"] == have_day["date"], "left")
        .groupBy("player_name")
        .agg(F.count(F.lit(1)).alias("rounds"), F.count(F.when(refused, 1)).alias("refused"))
    )
    seen = players.select("player_name", F.lit(1).alias("known"))
    zero = F.lit(0).cast("bigint")
    delivered = by_name.join(seen, "player_name", "left").agg(
        F.count(F.lit(1)).alias("names"),
        F.count("known").alias("known"),
        F.coalesce(F.sum("rounds"), zero).alias("rounds"),
        F.coalesce(F.sum("refused"), zero).alias("refused"),
    )
    days = cleaned.join(weather.select("date", F.lit(1).alias("known")), "date", "left").agg(
        F.count(F.lit(1)).alias("days"), F.count("known").alias("known")
    )

    def row(name: str, found: Column, table: DataFrame, new: Column, rejected: Column) -> Column:
        existing = table.agg(F.count(F.lit(1))).scalar()
        return F.struct(
            F.lit(name).alias("table_name"),
            found.alias("found"),
            existing.alias("existing"),
            new.alias("new"),
            rejected.alias("rejected"),
        )

    names, rounds, refused = F.col("names"), F.col("rounds"), F.col("refused")
    of_cards = delivered.select(
        F.inline(
            F.array(
                row("players", names, players, names - F.col("known"), zero),
                row("rounds", rounds, stored, rounds - refused, refused),
            )
        )
    )
    of_days = days.select(F.inline(F.array(row("weather", F.col("days"), weather, F.col("days") - F.col("known"), zero))))
    return of_cards.union(of_days).withColumn("final", F.col("existing") + F.col("new"))
