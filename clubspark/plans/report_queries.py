"""Reports, profiles, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubspark.operators import player_stats, reshape
from clubspark.operators import reports as R
from clubspark.plans import domain as D
from clubspark.plans.registry import query

_CONDITIONS = "CASE WHEN precipitation > 0.5 THEN 'Rainy' WHEN wind_speed > 15 THEN 'Windy' ELSE 'Good Conditions' END"
_CATEGORY = (
    "CASE WHEN precipitation > 0.5 THEN 'Rainy' WHEN wind_speed > 15 THEN 'Windy' "
    "WHEN avg_temp < 45 OR avg_temp > 95 THEN 'Extreme Weather' ELSE 'Good Conditions' END"
)
_POOR = "avg_temp < 65 AND precipitation > 15 AND wind_speed > 10"


@query("weather_impact", f"""
SELECT {_CATEGORY} AS weather_category, count(*) AS rounds_played, avg(score) AS avg_score,
  min(score) AS best_score, max(score) AS worst_score
FROM rounds_raw JOIN weather_f ON round_date = date WHERE score > 0 GROUP BY 1""", ("rounds_raw", "weather_f"))
def weather_impact(spark: SparkSession, sf: str) -> DataFrame:
    return R.weather_impact(reshape.played(D.rounds_raw(spark, sf)), D.weather(spark, sf))


@query("player_summary", """
SELECT p.player_id, player_name, member_status, h.handicap, count(round_id) AS total_rounds, avg(score) AS avg_score,
  min(score) AS best_score, max(score) AS worst_score
FROM players p LEFT JOIN rounds r ON p.player_id = r.player_id LEFT JOIN handicaps h ON p.player_id = h.player_id
GROUP BY ALL""", ("players", "rounds", "handicaps"))
def player_summary(spark: SparkSession, sf: str) -> DataFrame:
    rounds = D.rounds(spark, sf)
    players = D.players(spark, sf).drop("handicap").join(player_stats.handicaps(rounds), "player_id", "left")
    return R.player_summary(players, rounds)


@query("monthly_trends", """
SELECT CAST(year(round_date) AS INTEGER) AS year, CAST(month(round_date) AS INTEGER) AS month,
  count(*) AS rounds_played, avg(score) AS avg_score FROM rounds GROUP BY 1, 2""", ("rounds",))
def monthly_trends(spark: SparkSession, sf: str) -> DataFrame:
    return R.monthly_trends(D.rounds(spark, sf))


@query("performers_by_conditions", f"""
SELECT player_name, {_CONDITIONS} AS conditions, count(*) AS rounds_played, avg(score) AS avg_score
FROM players p JOIN rounds r ON p.player_id = r.player_id JOIN weather_f ON round_date = date
GROUP BY 1, 2 HAVING count(*) >= 3""", ("players", "rounds", "weather_f"))
def performers_by_conditions(spark: SparkSession, sf: str) -> DataFrame:
    weather = D.weather_once(spark, sf)
    return R.performers_by_conditions(D.players(spark, sf), D.rounds(spark, sf, weather), weather)


@query("latest_booking", """
SELECT user_id AS player_id, max(event_id) AS booking_id FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def latest_booking(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_booking(D.bookings(spark, sf))


@query("value_counts_day", "SELECT round_date, count(*) AS rounds FROM rounds GROUP BY 1", ("rounds",))
def value_counts_day(spark: SparkSession, sf: str) -> DataFrame:
    return R.value_counts(D.rounds(spark, sf), F.col("round_date"), "round_date")


@query("value_counts_month", "SELECT CAST(month(round_date) AS INTEGER) AS month, count(*) AS rounds FROM rounds GROUP BY 1", ("rounds",))
def value_counts_month(spark: SparkSession, sf: str) -> DataFrame:
    return R.value_counts(D.rounds(spark, sf), F.month("round_date"), "month")


@query("value_counts_weekday", "SELECT dayname(round_date) AS day_of_week, count(*) AS rounds FROM rounds GROUP BY 1", ("rounds",))
def value_counts_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return R.value_counts(D.rounds(spark, sf), F.date_format("round_date", "EEEE"), "day_of_week")


@query("score_by_weekday", """
SELECT CAST(isodow(round_date) - 1 AS INTEGER) AS day_of_week_int, dayname(round_date) AS day_of_week, avg(score) AS avg_score
FROM adjusted GROUP BY 1, 2""", ("adjusted",))
def score_by_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return R.score_by_weekday(D.adjusted_rounds(spark, sf))


def _describe_sql(column: str, table: str) -> str:
    q = "".join(f", CAST(quantile_cont({column}, {p}) AS DOUBLE) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS \"count\", round(avg({column}), 6) AS mean, "
        f"round(stddev_samp({column}), 6) AS std, CAST(min({column}) AS DOUBLE) AS \"min\"{q}, CAST(max({column}) AS DOUBLE) AS \"max\" FROM {table}"
    )


@query("describe_scores", " UNION ALL ".join([
    _describe_sql("score", "rounds"), _describe_sql("avg_temp", "weather"),
    _describe_sql("precipitation", "weather"), _describe_sql("wind_speed", "weather")]), ("rounds", "weather"))
def describe_scores(spark: SparkSession, sf: str) -> DataFrame:
    both = R.describe(D.rounds(spark, sf), ["score"]).union(
        R.describe(D.weather(spark, sf), ["avg_temp", "precipitation", "wind_speed"])
    )
    return both.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("profile_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count({c}) AS non_null FROM weather"
    for c, t in [("date", "date"), ("avg_temp", "double"), ("precipitation", "double"), ("wind_speed", "double"),
                 ("day_of_week", "string"), ("day_of_week_int", "int")]), ("weather",))
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return R.profile_columns(D.weather(spark, sf))


@query("most_rounds", """
SELECT player_id, CAST(round_number AS BIGINT) AS round_number, round_id, round_date, score FROM numbered
WHERE round_number = (SELECT max(round_number) FROM numbered)""", ("numbered",))
def most_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return R.most_rounds(D.rounds(spark, sf))


@query("score_std", "SELECT round(stddev_samp(score), 6) AS score_std FROM rounds", ("rounds",))
def score_std(spark: SparkSession, sf: str) -> DataFrame:
    return R.score_std(D.rounds(spark, sf)).select(F.round("score_std", 6).alias("score_std"))


@query("score_histogram", """
SELECT bin, round(lo + (bin - 1) * CAST(hi - lo AS DOUBLE) / 30, 6) AS lower, round(lo + bin * CAST(hi - lo AS DOUBLE) / 30, 6) AS upper,
  (SELECT count(*) FROM rounds WHERE least((score - lo) * 30 // (hi - lo) + 1, 30) = bin) AS rounds
FROM (SELECT min(score) AS lo, max(score) AS hi FROM rounds), range(1, 31) AS bins(bin)""", ("rounds",))
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    out = R.score_histogram(D.rounds(spark, sf))
    return out.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query("player_history", """
SELECT player_id, round_id, score, round_date, avg_temp, wind_speed, precipitation
FROM rounds LEFT JOIN weather ON round_date = date""", ("rounds", "weather"))
def player_history(spark: SparkSession, sf: str) -> DataFrame:
    weather = D.weather_once(spark, sf)
    return R.player_history(D.rounds(spark, sf, weather), weather)


@query("top_scores", "SELECT * FROM rounds ORDER BY score, round_id LIMIT 10", ("rounds",))
def top_scores(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_scores(D.rounds(spark, sf))


_POOR_ROUNDS = f"""
SELECT round_id, player_id, round_date, score, avg_temp, precipitation, wind_speed
FROM rounds JOIN weather_f ON round_date = date WHERE {_POOR}"""


@query("top_scores_poor", _POOR_ROUNDS + " ORDER BY score, round_id LIMIT 10", ("rounds", "weather_f"))
def top_scores_poor(spark: SparkSession, sf: str) -> DataFrame:
    weather = D.weather_once(spark, sf)
    return R.top_scores(R.poor_condition_rounds(D.rounds(spark, sf, weather), weather))


@query("worst_scores_poor", _POOR_ROUNDS + " ORDER BY score DESC, round_id LIMIT 10", ("rounds", "weather_f"))
def worst_scores_poor(spark: SparkSession, sf: str) -> DataFrame:
    weather = D.weather_once(spark, sf)
    return R.top_scores(R.poor_condition_rounds(D.rounds(spark, sf, weather), weather), best=False)


@query("top_handicaps", "SELECT player_id, handicap FROM handicaps ORDER BY handicap, player_id LIMIT 10", ("handicaps",))
def top_handicaps(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_handicaps(player_stats.handicaps(D.rounds(spark, sf)))


@query("top_rounds", """
SELECT player_id, count(*) AS round_number FROM rounds GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""", ("rounds",))
def top_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_round_counts(D.rounds(spark, sf))
