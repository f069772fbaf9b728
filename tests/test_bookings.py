import datetime

import pytest
from pyspark.sql import functions as F

from clubspark.operators import bookings

D = datetime.date
WED, SAT = D(2021, 6, 2), D(2021, 6, 5)


def features(spark, **change):
    row = dict(
        booking_id=1, player_id=1, handicap=10.0, round_number=5, day_of_week_int=2, hour=10, cart=False,
        avg_temp=20.0, precipitation=0.0, wind_speed=5.0,
    ) | change
    schema = (
        "booking_id long, player_id long, handicap double, round_number int, day_of_week_int int, hour int, "
        "cart boolean, avg_temp double, precipitation double, wind_speed double"
    )
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, 75),
        ({"day_of_week_int": 5}, 95),
        ({"day_of_week_int": 4}, 75),
        ({"cart": True}, 95),
        ({"hour": 14}, 60),
        ({"hour": 13}, 75),
        ({"hour": 14, "day_of_week_int": 6}, 95),
        ({"precipitation": 0.6}, 70),
        ({"precipitation": 0.5}, 75),
        ({"wind_speed": 15.1}, 70),
        ({"avg_temp": 14.9}, 70),
        ({"avg_temp": 15.0}, 75),
        ({"handicap": 2.9}, 70),
        ({"handicap": 3.0}, 75),
        ({"handicap": 15.0}, 75),
        ({"handicap": 15.1}, 80),
        ({"round_number": 15}, 75),
        ({"round_number": 16}, 70),
    ],
)
def test_price_boundaries(spark, change, want):
    row = bookings.price_bookings(features(spark, **change)).first()
    assert (row["price_paid"], row["reject_reason"]) == (want, None)


@pytest.mark.parametrize(
    "change, reason",
    [({"handicap": None}, "handicap"), ({"avg_temp": None}, "weather"), ({"player_id": None, "handicap": None}, "player")],
)
def test_unknown_inputs_are_rejected(spark, change, reason):
    row = bookings.price_bookings(features(spark, **change)).first()
    assert (row["price_paid"], row["reject_reason"]) == (None, reason)


def test_validation(spark):
    df = spark.createDataFrame(
        [(1, WED, 6, 36.0), (2, D(2013, 2, 28), 5, 36.1), (3, D(2023, 3, 1), 20, None), (4, None, 21, 0.0)],
        "booking_id long, booking_date date, hour int, handicap double",
    )
    out = bookings.validate_bookings(df, "handicap")
    assert {r["booking_id"]: r["reject_reason"] for r in out.collect()} == {
        1: None, 2: "date,hour,handicap", 3: "date,handicap", 4: "date,hour",
    }


@pytest.fixture(scope="module")
def venue(spark):
    players = spark.createDataFrame(
        [(1, "Ann O'Neil", 4.0), (2, "Bo", None)], "player_id long, player_name string, handicap double"
    )
    rounds = spark.createDataFrame([(i, 1) for i in range(16)], "round_id long, player_id long")
    weather = spark.createDataFrame(
        [(WED, 20.0, 0.0, 5.0)], "date date, avg_temp double, precipitation double, wind_speed double"
    )
    return players, rounds, weather


def requests(spark, *rows):
    return spark.createDataFrame(
        [(i, name, date, hour, False, datetime.datetime(2021, 1, 1)) for i, name, date, hour in rows],
        "booking_id long, player_name string, booking_date date, hour int, cart boolean, booking_time timestamp_ntz",
    )


def test_booking(spark, venue):
    asked = requests(
        spark,
        (1, " ann o'neil ", WED, 10),
        (2, "bo", WED, 10),
        (3, "nobody", WED, 10),
        (4, "ann o'neil", SAT, 10),
        (5, "ann o'neil", WED, 5),
    )
    got = {r["booking_id"]: r for r in bookings.book(asked, *venue).collect()}
    assert got[1]["booking_status"] == "confirmed" and got[1]["price_paid"] == 70.0
    assert got[1]["round_number"] == 17 and got[1]["tee_time"] == datetime.datetime(2021, 6, 2, 10)
    assert [got[i]["reject_reason"] for i in (2, 3, 4, 5)] == ["handicap", "player", "weather", "hour"]
    assert {got[i]["booking_status"] for i in (2, 3, 4, 5)} == {"rejected"}


def test_newcomers_are_registered_and_booked(spark, venue):
    asked = requests(spark, (1, "bo", WED, 10), (2, " cy", WED, 10), (3, "di", SAT, 10), (4, "ed", WED, 10), (5, "cy", WED, 12))
    asked = asked.drop("booking_time").withColumn("handicap", F.col("booking_id") * 10.0 - 10)
    asked = asked.withColumn("handicap", F.when(F.col("booking_id") != 4, F.col("handicap")).otherwise(36.5))
    booked, fresh = bookings.book_with_newcomers(
        asked, *venue, predict=lambda df: df.withColumn("prediction", F.col("handicap") + 80.5)
    )
    assert {(r["player_id"], r["player_name"], r["handicap"]) for r in fresh.collect()} == {(3, "Cy", 10.0), (4, "Di", 20.0)}
    got = {r["booking_id"]: r for r in booked.collect()}
    assert [got[i]["reject_reason"] for i in range(1, 6)] == ["handicap", None, "weather", "player", None]
    assert (got[2]["player_id"], got[2]["score_prediction"], got[2]["round_number"]) == (3, 90.0, 1)
    assert got[2]["booking_time"] is not None and got[3]["score_prediction"] is None
    stored = bookings.booking_records(booked)
    assert {r["booking_id"] for r in stored.collect()} == {2, 5} and stored.columns == bookings.BOOKINGS.names


def test_earliest_registration_wins(spark):
    asked = spark.createDataFrame(
        [(7, "cy ", 9.0), (3, " CY", 5.5), (4, "ann o'neil", 1.0), (9, "di", 2.0)],
        "booking_id long, player_name string, handicap double",
    )
    existing = spark.createDataFrame([(10, "Ann O'Neil")], "player_id long, player_name string")
    rows = bookings.register_players(asked, existing).collect()
    assert {(r["player_id"], r["player_name"], r["handicap"]) for r in rows} == {(11, "Cy", 5.5), (12, "Di", 2.0)}


def test_whole_strokes_round_to_even(spark):
    from clubspark.operators.bookings import rounded_prediction

    df = spark.createDataFrame([(88.5,), (89.5,)], "p double")
    assert [r[0] for r in df.select(rounded_prediction(F.col("p"))).collect()] == [88.0, 90.0]
