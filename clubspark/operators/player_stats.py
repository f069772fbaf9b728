"""Handicap, round count and membership per player.

Everything a player's row needs is in two mergeable summaries: the number of
rounds and the 20 latest rounds.  Both are reduced before the shuffle, can be
kept per load or micro-batch, and are combined by adding up and ranking again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubspark.functions.columns import idiv
from clubspark.operators.ranking import latest_rounds

# Fixed values of the handicap rule: course rating 67.3, slope 113 over 119,
# factor 0.96, the 20 latest rounds; 30 rounds make a guest a member.
LATEST = 20
MEMBER_ROUNDS = 30


def differential_tenths(score: Column) -> Column:
    """(score - 67.3) * 113 / 119 rounded half away from zero, in tenths, exactly."""
    t = score.cast("bigint") * 10 - 673
    return F.signum(t).cast("bigint") * idiv(F.abs(t) * 226 + 119, 238)


def handicap_tenths(total: Column, rounds: Column) -> Column:
    """0.96 * total / rounds rounded half away from zero, in tenths, exactly."""
    return F.signum(total).cast("bigint") * idiv(F.abs(total) * 192 + rounds * 100, rounds * 200)


def round_counts(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("player_id").agg(F.count(F.lit(1)).alias("rounds"))


def summarize(rounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, latest): the mergeable summaries of a set of rounds."""
    narrow = rounds.select("player_id", "round_date", "round_id", "score")
    return round_counts(narrow), latest_rounds(narrow, LATEST)


def merge_counts(counts: DataFrame) -> DataFrame:
    """Add up counts of several loads."""
    return counts.groupBy("player_id").agg(F.sum("rounds").cast("bigint").alias("rounds"))


def handicaps_from_latest(latest: DataFrame) -> DataFrame:
    """(player_id, handicap) from at most 20 rounds per player."""
    per_player = latest.groupBy("player_id").agg(
        F.sum(differential_tenths(F.col("score"))).alias("_total"), F.nullif(F.count("score"), F.lit(0)).alias("_n")
    )  # as a mean passes over nulls, so does the count; without any score there is no handicap
    return per_player.select(
        "player_id", (handicap_tenths(F.col("_total"), F.col("_n")) / F.lit(10.0)).alias("handicap")
    )


def handicaps(rounds: DataFrame) -> DataFrame:
    """(player_id, handicap) over each player's 20 latest rounds."""
    return handicaps_from_latest(latest_rounds(rounds.select("player_id", "round_date", "round_id", "score"), LATEST))


def handicaps_file_order(rounds: DataFrame) -> DataFrame:
    """The exploratory rule as it was written: the first score plus the last 19, in file order.

    Both ends are ranked with a limit, so no player's rounds meet whole.
    """
    narrow = rounds.select("player_id", "round_id", "score")
    by_id = Window.partitionBy("player_id")

    def ends(order: Column, n: int) -> DataFrame:
        return (
            narrow.withColumn("_rank", F.row_number().over(by_id.orderBy(order))).where(F.col("_rank") <= n).drop("_rank")
        )

    both = ends(F.col("round_id").asc(), 1).union(ends(F.col("round_id").desc(), LATEST - 1))
    return handicaps_from_latest(both.distinct())


def membership(status: Column, rounds: Column) -> Column:
    """A guest with 30 rounds or more becomes a member; any other status stays."""
    return F.when((status == "guest") & (rounds >= MEMBER_ROUNDS), "member").otherwise(status)


def player_stats_from(players: DataFrame, counts: DataFrame, latest: DataFrame) -> DataFrame:
    """Players with rounds_played, member_status and handicap brought up to date.

    Players without rounds keep the handicap they registered with.
    """
    totals = counts.withColumnRenamed("rounds", "_rounds")
    fresh = handicaps_from_latest(latest).withColumnRenamed("handicap", "_handicap")
    rounds = F.coalesce(F.col("_rounds"), F.lit(0))
    return (
        players.join(totals, "player_id", "left")
        .join(fresh, "player_id", "left")
        .select(
            "player_id",
            "player_name",
            membership(F.col("member_status"), rounds).alias("member_status"),
            F.coalesce(F.col("_handicap"), F.col("handicap")).alias("handicap"),
            rounds.cast("int").alias("rounds_played"),
        )
    )


def player_stats(players: DataFrame, rounds: DataFrame) -> DataFrame:
    return player_stats_from(players, *summarize(rounds))


def handicap_for_player(rounds: DataFrame, player_id: int) -> DataFrame:
    """The handicap of one player: a filter on the key, then the same rule (null without scores)."""
    mine = latest_rounds(rounds.where(F.col("player_id") == player_id), LATEST)
    total = F.sum(differential_tenths(F.col("score")))
    n = F.count("score")
    return mine.agg(
        F.lit(player_id).cast("bigint").alias("player_id"),
        F.when(n > 0, handicap_tenths(total, F.greatest(n, F.lit(1))) / F.lit(10.0)).alias("handicap"),
    )
