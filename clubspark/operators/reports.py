"""Reports, profiles and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.functions import columns as C
from clubspark.operators import quantiles
from clubspark.operators.player_stats import round_counts
from clubspark.operators.ranking import latest_rounds, top_rows
from clubspark.operators.reshape import convert_units
from clubspark.session import materialize

HISTOGRAM_BINS = 30


def _by_date(rounds: DataFrame, weather: DataFrame, how: str = "inner") -> DataFrame:
    """Join rounds with weather; the weather side holds one row per calendar day."""
    return rounds.join(F.broadcast(weather), rounds["round_date"] == weather["date"], how)


def player_summary(players: DataFrame, rounds: DataFrame) -> DataFrame:
    """Round count, mean, best and worst score of every player, players without rounds too.

    Rounds are reduced to one row per player before they meet the player table.
    """
    per_player = rounds.groupBy("player_id").agg(
        F.count("round_id").alias("_n"),
        F.avg("score").alias("avg_score"),
        F.min("score").alias("best_score"),
        F.max("score").alias("worst_score"),
    )
    return (
        players.join(per_player, "player_id", "left")
        .select(
            "player_id",
            "player_name",
            "member_status",
            "handicap",
            F.coalesce("_n", F.lit(0)).alias("total_rounds"),
            "avg_score",
            "best_score",
            "worst_score",
        )
        .orderBy(F.col("avg_score").asc_nulls_last(), "player_id")
    )


def weather_impact(rounds: DataFrame, weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph") -> DataFrame:
    """Rounds and scores per weather class.

    Rounds are reduced to one row per day first (partial aggregation in the
    scan stage); days then meet their weather, a few thousand rows on each side.
    """
    days = rounds.groupBy("round_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("scored"),
        F.sum("score").alias("total"),
        F.min("score").alias("lo"),
        F.max("score").alias("hi"),
    )
    fahrenheit = convert_units(weather, temp_unit, wind_unit)
    category = C.weather_category(F.col("precipitation"), F.col("wind_speed"), F.col("avg_temp"))
    return (
        days.join(fahrenheit.select("date", category.alias("weather_category")), F.col("round_date") == F.col("date"))
        .groupBy("weather_category")
        .agg(
            F.sum("n").cast("bigint").alias("rounds_played"),
            (F.sum("total") / F.nullif(F.sum("scored"), F.lit(0))).alias("avg_score"),
            F.min("lo").alias("best_score"),
            F.max("hi").alias("worst_score"),
        )
        .orderBy("avg_score", "weather_category")
    )


def monthly_trends(rounds: DataFrame) -> DataFrame:
    return (
        rounds.groupBy(F.year("round_date").alias("year"), F.month("round_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("rounds_played"), F.avg("score").alias("avg_score"))
        .orderBy("year", "month")
    )


def performers_by_conditions(
    players: DataFrame, rounds: DataFrame, weather: DataFrame, min_rounds: int = 3, wind_unit: str = "mph"
) -> DataFrame:
    """Mean score per player and condition, with at least three rounds."""
    classes = convert_units(weather, wind_unit=wind_unit).select("date", C.conditions(F.col("precipitation"), F.col("wind_speed")).alias("conditions"))
    per_player = (
        _by_date(rounds.select("player_id", "round_date", "score"), classes)
        .groupBy("player_id", "conditions")
        .agg(F.count(F.lit(1)).alias("rounds_played"), F.avg("score").alias("avg_score"))
        .where(F.col("rounds_played") >= min_rounds)
    )
    return (
        per_player.join(players.select("player_id", "player_name"), "player_id")
        .select("player_name", "conditions", "rounds_played", "avg_score")
        .orderBy("conditions", "avg_score", "player_name")
    )


def rounds_per_player(players: DataFrame, rounds: DataFrame) -> DataFrame:
    """Round count of every player, 0 for those without rounds."""
    return players.join(round_counts(rounds), "player_id", "left").select(
        "player_id", "player_name", F.coalesce("rounds", F.lit(0)).alias("round_count")
    )


def latest_booking(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("player_id").agg(F.max("booking_id").alias("booking_id"))


def value_counts(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return (
        df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("rounds")).orderBy(F.col("rounds").desc(), name)
    )


def score_by_weekday(rounds: DataFrame, best_first: bool = True) -> DataFrame:
    """Mean score per weekday."""
    mean = F.col("avg_score")
    return (
        rounds.groupBy(
            C.weekday_int(F.col("round_date")).alias("day_of_week_int"),
            C.weekday_name(F.col("round_date")).alias("day_of_week"),
        )
        .agg(F.avg("score").alias("avg_score"))
        .orderBy(mean.asc() if best_first else mean.desc(), "day_of_week_int")
    )


def describe(df: DataFrame, names: list[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max of each numeric column.

    Quartiles are exact on any domain (operators.quantiles): the columns are written once, and a few
    counting passes find the ranks.  With ``exact=False`` they come from one pass with a sketch.
    """
    shares = [0.25, 0.5, 0.75]
    narrow = df.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    if not exact:
        stats = [
            F.struct(
                F.lit(n).alias("column_name"), F.count(n).alias("count"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"),
                F.min(n).alias("min"), F.percentile_approx(n, shares, 10000).alias("q"), F.max(n).alias("max"),
            )
            for n in names
        ]
        one = narrow.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("r")).select("r.*")
        quartiles = [F.col("q")[i].alias(f"q{int(100 * s)}") for i, s in enumerate(shares)]
        return one.select("column_name", "count", "mean", "std", "min", *quartiles, "max")
    narrow = materialize(narrow)
    known = {n: s.asDict() for n, s in quantiles.summaries(narrow, names).first().asDict().items()}
    values = quantiles.order_statistics(narrow, {n: quantiles.ranks_of(known[n]["count"], shares) for n in names}, known)
    rows = []
    for n in names:
        s = known[n]
        found = [quantiles.interpolated(values, n, s["count"], share) for share in shares]
        rows.append((n, s["count"], s["mean"], s["std"], s["min"], *found, s["max"]))
    schema = "column_name string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    return df.sparkSession.createDataFrame(rows, schema)


def profile_columns(df: DataFrame) -> DataFrame:
    """Row count, filled cells and type of each column, in one pass."""
    cells = [
        F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.count(F.col(f"`{n}`")).alias("non_null"))
        for n, t in df.dtypes
    ]
    return (
        df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*cells).alias("c"))
        .select("row_count", F.explode("c").alias("c"))
        .select("c.column_name", "c.data_type", "row_count", "c.non_null")
    )


def last_round_per_player(rounds: DataFrame) -> DataFrame:
    """Each player's round with the highest round number, and that number.

    The number of the last round is the round count, so no player's rounds
    need to be ranked.
    """
    latest = latest_rounds(rounds.select("player_id", "round_id", "round_date", "score"), 1)
    counts = round_counts(rounds).withColumnRenamed("rounds", "round_number")
    return latest.join(counts, latest["player_id"].eqNullSafe(counts["player_id"])).select(
        latest["player_id"], "round_number", "round_id", "round_date", "score"
    )


def most_rounds(rounds: DataFrame) -> DataFrame:
    """The rows holding the highest round number of all, with ties."""
    last = last_round_per_player(rounds)
    return last.where(F.col("round_number") == round_counts(rounds).agg(F.max("rounds")).scalar())


def best_per_player(rounds: DataFrame, handicaps: DataFrame) -> DataFrame:
    """One row per player: highest round number and handicap."""
    return last_round_per_player(rounds).join(handicaps, "player_id")


def score_std(rounds: DataFrame) -> DataFrame:
    return rounds.agg(F.stddev_samp("score").alias("score_std"))


def score_counts(rounds: DataFrame) -> DataFrame:
    """(score, n): scores are small whole numbers, so this is a tiny table at any scale."""
    return rounds.where(F.col("score").isNotNull()).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(rounds: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal bins over [min, max], the last one closed, empty bins included."""
    counts = score_counts(rounds)
    ends = counts.agg(F.min("score").cast("bigint").alias("lo"), F.max("score").cast("bigint").alias("hi"))
    both = ends.select(F.struct("lo", "hi")).scalar()
    lo, hi = both["lo"], both["hi"]
    width = F.greatest(hi - lo, F.lit(1))
    per_bin = counts.groupBy(F.least(C.idiv((F.col("score") - lo) * bins, width) + 1, F.lit(bins)).alias("bin")).agg(
        F.sum("n").alias("n")
    )
    edges = ends.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin"), "lo", "hi")
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double")
    return edges.join(per_bin, "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * span / bins).alias("lower"),
        (F.col("lo") + F.col("bin") * span / bins).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("rounds"),
    )


def player_history(rounds: DataFrame, weather: DataFrame, player_id: int | None = None, min_rounds: int = 1) -> DataFrame:
    """Rounds with their weather by date: one player, or all of them."""
    mine = rounds if player_id is None else rounds.where(F.col("player_id") == player_id)
    if min_rounds > 1:
        enough = round_counts(mine).where(F.col("rounds") >= min_rounds)
        mine = mine.join(enough, "player_id", "left_semi")
    return (
        _by_date(mine, weather, "left")
        .select("player_id", "round_id", "score", "round_date", "avg_temp", "wind_speed", "precipitation")
        .orderBy("player_id", "round_date", "round_id")
    )


def top_scores(rounds: DataFrame, n: int = 10, best: bool = True) -> DataFrame:
    """The n best (or worst) scores, ties by round id."""
    score = F.col("score")
    return top_rows(rounds, n, score.asc() if best else score.desc(), F.col("round_id").asc())


def poor_condition_rounds(rounds: DataFrame, weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph") -> DataFrame:
    """Rounds played on cold, wet and windy days; days are filtered before the join."""
    w = convert_units(weather, temp_unit, wind_unit)
    days = w.where(C.poor_conditions(F.col("precipitation"), F.col("wind_speed"), F.col("avg_temp")))
    return _by_date(rounds, days.select("date", "avg_temp", "precipitation", "wind_speed")).drop("date")


def top_handicaps(handicaps: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(handicaps, n, F.col("handicap").asc(), F.col("player_id").asc())


def top_round_counts(rounds: DataFrame, n: int = 15) -> DataFrame:
    """The players with most rounds."""
    return top_rows(
        round_counts(rounds).withColumnRenamed("rounds", "round_number"),
        n,
        F.col("round_number").desc(),
        F.col("player_id").asc(),
    )
