import datetime

import pytest
from pyspark.sql import functions as F

from clubspark.operators import player_stats
from clubspark.streaming import rounds as S

D0 = datetime.date(2020, 5, 1)


@pytest.fixture(scope="module")
def all_rounds(spark):
    rows = [(i, i % 3, D0 + datetime.timedelta(days=(i * 37) % 90), 65 + (i * 13) % 50) for i in range(150)]
    return spark.createDataFrame(rows, "round_id long, player_id long, round_date date, score int")


@pytest.fixture(scope="module")
def players(spark):
    return spark.createDataFrame(
        [(i, f"P{i}", "guest", None, 0) for i in range(4)],
        "player_id long, player_name string, member_status string, handicap double, rounds_played int",
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_of_many_batches_equals_batch(spark, all_rounds, players, tmp_path):
    source = str(tmp_path / "in")
    all_rounds.repartition(6, F.hash("round_id")).write.parquet(source)
    stream = S.file_stream(spark, source, all_rounds.schema, max_files=1)
    state = S.PlayerStatsStream(spark, str(tmp_path / "state"))
    state.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    want = rows(player_stats.player_stats(players, all_rounds))
    assert rows(state.stats(players)) == want
    assert rows(state.compacted_copy(str(tmp_path / "small")).stats(players)) == want

    # late rounds arrive in a second run that continues from the checkpoint
    late = all_rounds.withColumn("round_id", F.col("round_id") + 1000).withColumn("round_date", F.date_sub("round_date", 60))
    late.write.mode("append").parquet(source)
    state.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(state.stats(players)) == rows(player_stats.player_stats(players, all_rounds.union(late)))


def test_repeated_batch_replaces_itself(spark, all_rounds, players, tmp_path):
    state = S.PlayerStatsStream(spark, str(tmp_path))
    assert rows(state.stats(players)) == rows(players)
    for batch_id in (0, 0, 1, 0):
        half = all_rounds.where((F.col("round_id") < 75) if batch_id == 0 else (F.col("round_id") >= 75))
        state.update(half, batch_id)
    assert rows(state.stats(players)) == rows(player_stats.player_stats(players, all_rounds))


def test_state_is_one_row_per_player(spark, all_rounds, players, tmp_path):
    """Over 20 batches with late rounds and a null score the state stays as large as the players are many."""
    rounds = all_rounds.withColumn("score", F.when(F.col("round_id") != 7, F.col("score")))
    source = str(tmp_path / "in")
    rounds.withColumn("part", F.pmod(F.hash("round_id"), F.lit(20))).repartition(20, "part").write.partitionBy("part").parquet(source)
    stream = S.file_stream(spark, source, rounds.schema, max_files=1)
    state = S.PlayerStateStream(spark, str(tmp_path / "checkpoint"))
    running = state.start(stream)
    running.awaitTermination()
    progress = [p for p in running.recentProgress if p["numInputRows"]]
    assert len(progress) == 20
    assert {p["stateOperators"][0]["numRowsTotal"] for p in progress} <= {1, 2, 3}
    assert state.state().count() == 3
    assert state.state().where(F.size("ids") > player_stats.LATEST).count() == 0
    assert rows(state.stats(players)) == rows(player_stats.player_stats(players, rounds))

    # another run goes on from the checkpoint; every round of it is older than those kept
    late = rounds.withColumn("round_id", F.col("round_id") + 1000).withColumn("round_date", F.date_sub("round_date", 400))
    late.withColumn("part", F.lit(99)).write.mode("append").partitionBy("part").parquet(source)
    state.start(S.file_stream(spark, source, rounds.schema)).awaitTermination()
    assert rows(state.stats(players)) == rows(player_stats.player_stats(players, rounds.unionByName(late)))


def test_players_of_a_range_share_a_row_of_state(spark, players, tmp_path):
    """3,000 players in three ranges: the function that keeps the state is called three times a batch, not once per player."""
    rounds = spark.range(0, 9000, 1, 3).select(
        F.col("id").alias("round_id"), F.when(F.col("id") != 5, F.col("id") % 3000).alias("player_id"),
        F.date_add(F.lit(D0), (F.col("id") % 11).cast("int")).alias("round_date"), F.when(F.col("id") % 7 != 0, F.lit(80)).alias("score"),
    )
    rounds.write.parquet(str(tmp_path / "in"))
    state = S.PlayerStateStream(spark, str(tmp_path / "checkpoint"))
    running = state.start(S.file_stream(spark, str(tmp_path / "in"), rounds.schema, max_files=1))
    running.awaitTermination()
    progress = [p for p in running.recentProgress if p["numInputRows"]]
    assert len(progress) == 3 and progress[-1]["stateOperators"][0]["numRowsTotal"] == 4  # the null player's range too
    assert rows(state.stats(players)) == rows(player_stats.player_stats(players, rounds))
    got = {r["player_id"]: r for r in state.state().collect()}
    assert len(got) == 3001 and got[None]["ids"] == [5]
    assert got[17]["rounds"] == 3 and sorted(got[17]["ids"]) == [17, 3017, 6017] and got[17]["days"] == sorted(got[17]["days"], reverse=True)


def test_a_hot_player_sends_few_rows(spark, tmp_path):
    hot = spark.range(5000).select(
        F.col("id").alias("round_id"), F.lit(1).cast("long").alias("player_id"), F.date_add(F.lit(D0), (F.col("id") % 700).cast("int")).alias("round_date"), F.lit(80).alias("score")
    )
    reduced = S.PlayerStateStream(spark, str(tmp_path)).reduced(hot.repartition(4)).collect()
    assert len(reduced) == 4 * player_stats.LATEST and sum(r["rounds"] for r in reduced) == 5000


def test_a_task_of_many_rounds_is_merged_on_the_way(spark, players, tmp_path):
    """One task of 250,000 rounds merges its rows while more batches come, also of files and into the state."""
    many = spark.range(0, 250_000, 1, 1).select(
        F.col("id").alias("round_id"), (F.col("id") % 7000).alias("player_id"),
        F.date_add(F.lit(D0), (F.col("id") * 37 % 700).cast("int")).alias("round_date"), F.when(F.col("id") % 9 != 0, F.lit(80)).alias("score"),
    )
    state = S.PlayerStateStream(spark, str(tmp_path / "checkpoint"))
    reduced = state.reduced(many)
    assert reduced.agg(F.sum("rounds"), F.count(F.lit(1)), F.countDistinct("player_id")).first()[:] == (250_000, 140_000, 7000)
    many.write.parquet(str(tmp_path / "in"))
    state.start(S.file_stream(spark, str(tmp_path / "in"), many.schema)).awaitTermination()
    assert rows(state.stats(players)) == rows(player_stats.player_stats(players, many))


def sides(spark):
    people = spark.createDataFrame([(1, "Ann", 5.0)], "player_id long, player_name string, handicap double")
    played = spark.createDataFrame([(1, 1)], "round_id long, player_id long")
    weather = spark.createDataFrame(
        [(datetime.date(2021, 6, 2), 20.0, 0.0, 5.0)], "date date, avg_temp double, precipitation double, wind_speed double"
    )
    return people, player_stats.round_counts(played), weather


ASKED = "booking_id long, player_name string, booking_date date, hour int, cart boolean, booking_time timestamp_ntz"


def asked_for(spark, ids, time=None):
    time = time or datetime.datetime(2021, 1, 1)
    return spark.createDataFrame([(i, "ann", datetime.date(2021, 6, 2), 10, False, time) for i in ids], ASKED)


def test_bookings_read_back_only_their_ranges(spark, tmp_path):
    """Over 20 batches the files that a batch looks into are those of its own ids."""
    book = S.BookingStream(spark, str(tmp_path / "out"), *sides(spark), ids_per_range=10)
    for batch in range(20):
        book.update(asked_for(spark, [*range(batch * 10, batch * 10 + 10), max(0, batch * 10 - 5)]), batch)
    assert sorted(r["booking_id"] for r in book.bookings().collect()) == list(range(200))
    looked = book.booked_elsewhere(asked_for(spark, [42, 45, 9999]), 99)
    folders = {f.split("/ids=")[1].split("/")[0] for f in looked.inputFiles()}
    assert folders == {"4"} and looked.count() == 10
    assert book.booked_elsewhere(asked_for(spark, [777_777]), 99) is None
    before = book.bookings().count()
    book.update(asked_for(spark, range(200)), 50)  # all are known
    assert book.bookings().count() == before


def test_requests_without_an_id_are_rejected(spark, tmp_path):
    book = S.BookingStream(spark, str(tmp_path / "out"), *sides(spark))
    for _ in range(2):  # the same batch again replaces itself
        book.update(asked_for(spark, [None, None, 5, 5]), 0)
    book.update(asked_for(spark, [None, 5]), 1)
    got = sorted((r["booking_id"] or 0, r["booking_status"], r["reject_reason"]) for r in book.bookings().collect())
    assert got == [(0, "rejected", "booking_id")] * 3 + [(5, "confirmed", None)]


def test_the_earliest_of_equal_ids_is_kept(spark, tmp_path):
    book = S.BookingStream(spark, str(tmp_path / "out"), *sides(spark))
    first = datetime.datetime(2020, 1, 1)
    book.update(asked_for(spark, [5]).union(asked_for(spark, [5], first)), 0)
    assert [r["booking_time"] for r in book.bookings().collect()] == [first]


def test_booking_stream_books_once(spark, tmp_path):
    asked = spark.createDataFrame(
        [(i, "ann", datetime.date(2021, 6, 2), 10, False, datetime.datetime(2021, 1, 1)) for i in (1, 2, 1, 2, 3)],
        "booking_id long, player_name string, booking_date date, hour int, cart boolean, booking_time timestamp_ntz",
    )
    asked.write.parquet(str(tmp_path / "in"))
    people = spark.createDataFrame([(1, "Ann", 5.0)], "player_id long, player_name string, handicap double")
    played = spark.createDataFrame([(1, 1)], "round_id long, player_id long")
    weather = spark.createDataFrame(
        [(datetime.date(2021, 6, 2), 20.0, 0.0, 5.0)], "date date, avg_temp double, precipitation double, wind_speed double"
    )
    book = S.BookingStream(spark, str(tmp_path / "out"), people, player_stats.round_counts(played), weather)
    book.start(S.file_stream(spark, str(tmp_path / "in"), asked.schema), str(tmp_path / "checkpoint")).awaitTermination()
    out = book.bookings()
    assert sorted(r["booking_id"] for r in out.collect()) == [1, 2, 3]
    assert out.where(F.col("price_paid") == 75.0).count() == 3

    # a late request, and one that is known, in a later batch; then that batch once more
    late = asked.where("booking_id = 3").limit(1).withColumn("booking_id", F.lit(9).cast("long"))
    late = late.withColumn("booking_time", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).union(asked.where("booking_id = 2"))
    for _ in range(2):
        book.update(late, 7)
        assert sorted(r["booking_id"] for r in book.bookings().collect()) == [1, 2, 3, 9]


def test_loads_and_batches_of_one_number_coexist(spark, all_rounds, tmp_path):
    state = S.PlayerStatsStream(spark, str(tmp_path))
    state.update(all_rounds.where("round_id < 5"), 1, "load")
    state.update(all_rounds.where("round_id >= 5 AND round_id < 8"), 1)
    assert sum(r["rounds"] for r in state.counts().collect()) == 8


def test_null_scores_are_no_rounds_in_means(spark):
    from clubspark.operators import reports

    rows = [(1, 1, D0, 80), (2, 1, D0, None), (3, 2, D0, None)]
    rounds = spark.createDataFrame(rows, "round_id long, player_id long, round_date date, score int")
    got = {r["player_id"]: r["handicap"] for r in player_stats.handicaps(rounds).collect()}
    assert got == {1: 11.6, 2: None}
    assert [player_stats.handicap_for_player(rounds, p).first()["handicap"] for p in (1, 2, 3)] == [11.6, None, None]
    weather = spark.createDataFrame([(D0, 20.0, 0.0, 5.0)], "date date, avg_temp double, precipitation double, wind_speed double")
    impact = reports.weather_impact(rounds, weather).first()
    assert impact["avg_score"] == 80.0 and impact["rounds_played"] == 3
    last = {r["player_id"]: (r["round_number"], r["round_id"]) for r in reports.last_round_per_player(rounds).collect()}
    assert last == {1: (2, 2), 2: (1, 3)}
    assert "SortAggregate" not in reports.last_round_per_player(rounds)._jdf.queryExecution().toString()
