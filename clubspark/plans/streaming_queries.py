"""Streams over the benchmark tables, read to the end and compared with the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubspark.operators.player_stats import round_counts
from clubspark.plans import domain as D
from clubspark.plans.booking_queries import BOOK_SQL, _stats
from clubspark.plans.loading_queries import PLAYER_STATS_SQL
from clubspark.plans.registry import query, with_views
from clubspark.session import materialize, shared_folder
from clubspark.streaming import rounds as S

#: Micro-batches that the rounds come in.
BATCHES = 20


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return S.file_stream(spark, f"{sf}/{name}.parquet*", D.SCHEMAS[name])


@query("stream_adjust_scores", with_views("SELECT * FROM adjusted", "adjusted"))
def stream_adjust_scores(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    weather = D.weather_once(spark, sf)
    rounds = D.rounds_from_orders(_stream(spark, sf, "orders"), weather.select("date"))
    adjusted = S.adjusted_stream(rounds, weather)
    S.write_table(adjusted, f"{path}/rounds", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(adjusted.schema).parquet(f"{path}/rounds")


@query("stream_player_stats", PLAYER_STATS_SQL)
def stream_player_stats(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    weather = D.weather_once(spark, sf)
    rounds = D.rounds_from_orders(_stream(spark, sf, "orders"), weather.select("date"))
    state = S.PlayerStatsStream(spark, f"{path}/state")
    state.start(S.adjusted_stream(rounds, weather), f"{path}/checkpoint").awaitTermination()
    return state.stats(D.players(spark, sf))


@query("stream_bookings", BOOK_SQL)
def stream_bookings(spark: SparkSession, sf: str) -> DataFrame:
    """Three deliveries, one after the other, earlier requests in later ones, and some requests twice."""
    path = shared_folder(spark)
    weather = D.weather_once(spark, sf)
    players, rounds = _stats(spark, sf, weather)
    players, counts = materialize(players), materialize(round_counts(rounds))
    events = D.table(spark, sf, "events")
    booked = S.BookingStream(spark, f"{path}/state", players, counts, weather)
    for part in range(3):
        sent = events.where((F.col("event_id") % 3 == 2 - part) | (F.col("event_id") % 10 == part))
        sent.write.mode("append").parquet(f"{path}/events")
        arriving = S.file_stream(spark, f"{path}/events", D.SCHEMAS["events"])
        asked = D.requests_from_events(arriving, D.table(spark, sf, "customer"), "purchase")
        booked.start(asked.drop("handicap", "player_id"), f"{path}/checkpoint").awaitTermination()
    return booked.bookings()


@query("stream_player_state", PLAYER_STATS_SQL)
def stream_player_state(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds in 20 micro-batches, late ones in each; one row of state per player."""
    path = shared_folder(spark)
    weather = D.weather_once(spark, sf)
    rounds = D.adjusted_rounds(spark, sf, weather).select("player_id", "round_date", "round_id", "score")
    rounds.withColumn("part", F.pmod(F.xxhash64("round_id"), F.lit(BATCHES))).write.partitionBy("part").parquet(f"{path}/rounds")
    state = S.PlayerStateStream(spark, f"{path}/checkpoint")
    for part in range(BATCHES):
        stored = S.file_stream(spark, f"{path}/rounds/part={{{','.join(map(str, range(part + 1)))}}}", rounds.schema)
        state.start(stored).awaitTermination()
    return state.stats(D.players(spark, sf))
