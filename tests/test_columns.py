import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from clubspark.functions import columns as C
from clubspark.operators import features, reshape

D = datetime.date


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "typed", ["  adam o'neil ", "smith-jones", "\tMARY ANN\n", "jean-luc de la tour", "x1y2", "", "éva ZSÓFIA"]
)
def test_names_like_python_title(spark, typed):
    assert value(spark, C.normalize_name(F.lit(typed))) == typed.strip().title()


def test_units(spark):
    assert value(spark, C.c_to_f(F.lit(5.0))) == 41.0
    assert value(spark, C.f_to_c(F.lit(95.0))) == 35.0
    assert value(spark, C.km_to_miles(F.lit(10.0))) == pytest.approx(6.21371)


def test_weekday_conventions(spark):
    sunday = F.lit(D(2020, 6, 7))
    assert value(spark, C.weekday_int(sunday)) == 6
    assert value(spark, C.weekday_int(sunday, "spark")) == 1
    with pytest.raises(ValueError):
        C.weekday_int(sunday, "other")


@pytest.mark.parametrize("month, name", [(12, "Winter"), (2, "Winter"), (3, "Spring"), (8, "Summer"), (9, "Fall"), (11, "Fall")])
def test_seasons(spark, month, name):
    assert value(spark, C.season(F.lit(D(2020, month, 1)))) == name


@pytest.mark.parametrize(
    "rain, wind, temp, four, three",
    [
        (0.6, 20.0, 20.0, "Rainy", "Rainy"),
        (0.5, 15.1, 20.0, "Windy", "Windy"),
        (0.5, 15.0, 44.9, "Extreme Weather", "Good Conditions"),
        (0.0, 15.0, 95.1, "Extreme Weather", "Good Conditions"),
        (0.0, 15.0, 45.0, "Good Conditions", "Good Conditions"),
        (None, None, None, "Good Conditions", "Good Conditions"),
    ],
)
def test_weather_classes(spark, rain, wind, temp, four, three):
    r, w, t = (F.lit(v).cast("double") for v in (rain, wind, temp))
    assert value(spark, C.weather_category(r, w, t)) == four
    assert value(spark, C.conditions(r, w)) == three


def test_hash_survives_large_ids(spark):
    df = spark.createDataFrame([(2**62,), (10**15,), (0,)], "x long")
    got = {r["x"]: r["h"] for r in df.select("x", C.portable_hash(F.col("x"), 42).alias("h")).collect()}
    for x, h in got.items():
        assert h == int(hashlib.md5(f"42:{x}".encode()).hexdigest()[:15], 16)


def test_draws_are_independent(spark):
    """Samples spread over the ids, the split does not follow from the date, ids with high partition bits draw differently."""
    ids = spark.range(40000).select(F.col("id").alias("round_id"))
    sample = [r["round_id"] for r in reshape.sample_rows(ids, 200).collect()]
    assert max(sample) > 30000 and 15000 < sum(sample) / 200 < 25000
    both = reshape.assign_dates(ids).select("round_date", features.split_flag().alias("s")).collect()
    shares = {}
    for r in both:
        shares.setdefault(r["round_date"], []).append(r["s"] == "train")
    means = [sum(v) / len(v) for v in shares.values()]
    assert max(means) - min(means) > 0.1 and abs(sum(means) / len(means) - 0.8) < 0.02
    low, high = (ids.select(C.portable_hash(F.col("round_id") + F.lit(k))).collect() for k in (0, 2**33))
    assert low != high


def test_unpivot_keeps_four_rounds_per_named_card(spark):
    cards = spark.createDataFrame(
        [(1, "A", 70, 71, 0, 0), (2, None, 1, 2, 3, 4), (3, "B", 80, None, 82, 83)],
        "scorecard_id long, Name string, `Open.R1` int, `Open.R2` int, `Open.R3` int, `Open.R4` int",
    )
    rounds = reshape.with_round_id(reshape.unpivot_rounds(cards))
    got = {(r["player_name"], r["round_number"]): (r["score"], r["round_id"]) for r in rounds.collect()}
    assert got == {
        ("A", 1): (70, 5), ("A", 2): (71, 6), ("A", 3): (0, 7), ("A", 4): (0, 8),
        ("B", 1): (80, 13), ("B", 2): (None, 14), ("B", 3): (82, 15), ("B", 4): (83, 16),
    }
    assert reshape.played(rounds).count() == 5
    assert reshape.drop_zero_scores(rounds).count() == 6


def test_weather_keeps_the_first_row_per_day(spark):
    raw = spark.createDataFrame(
        [("2018-05-01", 10.0, 0.0, 3.0), ("2018-05-01", 9.0, 1.0, 2.0), ("2017-03-31", 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)],
        "time string, tavg double, prcp double, wspd double",
    )
    rows = reshape.clean_weather(raw).collect()
    assert [(r["date"], r["avg_temp"], r["day_of_week"], r["day_of_week_int"]) for r in rows] == [
        (D(2018, 5, 1), 9.0, "Tuesday", 1)
    ]


def test_defaults(spark):
    df = spark.createDataFrame([(1, None)], "player_id long, member_status string")
    assert reshape.apply_defaults(df, "players").first()["member_status"] is None
    filled = reshape.apply_defaults(df, "players", fill_nulls=True).first()
    assert filled["member_status"] == "guest" and filled["rounds_played"] == 0


def test_weighted_dates(spark):
    rounds = spark.range(0, 20000).select(F.col("id").alias("round_id"))
    out = reshape.assign_dates_weighted(rounds)
    assert out.count() == 20000
    weekend = out.where(F.weekday("round_date") >= 5).count() / 20000
    assert 0.58 < weekend < 0.65  # 8 of 13 slots
    span = out.agg(F.min("round_date"), F.max("round_date")).first()
    assert span[0] >= D(2017, 4, 1) and span[1] <= D(2022, 10, 30)
