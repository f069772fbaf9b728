import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from clubspark.operators import player_stats, scoring

DAY = datetime.date(2020, 6, 3)  # a Wednesday: no weekday strokes


def weather(spark, temp, wind, rain, weekday=2):
    return spark.createDataFrame(
        [(DAY, temp, rain, wind, weekday)],
        "date date, avg_temp double, precipitation double, wind_speed double, day_of_week_int int",
    )


def rounds(spark, n=1):
    return spark.createDataFrame(
        [(i, 1, DAY, 80) for i in range(1, n + 1)], "round_id long, player_id long, round_date date, score int"
    )


CASES = [
    (dict(temp=49.9, wind=5.0, rain=None), 4),
    (dict(temp=50.0, wind=5.0, rain=None), 0),
    (dict(temp=80.0, wind=5.0, rain=None), 0),
    (dict(temp=80.1, wind=5.0, rain=None), -1),
    (dict(temp=95.0, wind=5.0, rain=None), -1),
    (dict(temp=95.1, wind=5.0, rain=None), 4),
    (dict(temp=60.0, wind=15.1, rain=None), 4),
    (dict(temp=60.0, wind=15.0, rain=None), 3),
    (dict(temp=60.0, wind=10.0, rain=None), 0),
    (dict(temp=60.0, wind=3.0, rain=None), 0),
    (dict(temp=60.0, wind=2.9, rain=None), -1),
    (dict(temp=None, wind=None, rain=10.1), 5),
    (dict(temp=None, wind=None, rain=10.0), 3),
    (dict(temp=None, wind=None, rain=0.0), -1),
    (dict(temp=None, wind=None, rain=None), 0),
    (dict(temp=None, wind=None, rain=None, weekday=5), -1),
    (dict(temp=None, wind=None, rain=None, weekday=4), 0),
    (dict(temp=None, wind=None, rain=None, weekday=1), 2),
    (dict(temp=None, wind=None, rain=None, weekday=0), 2),
]


@pytest.mark.parametrize("day, strokes", CASES)
def test_adjustment_boundaries(spark, day, strokes):
    out = scoring.adjust_scores(rounds(spark), weather(spark, **day), temp_unit="F").first()
    assert out["score"] == 80 + strokes


def test_round_without_weather_keeps_its_score(spark):
    empty = weather(spark, 1.0, 1.0, 1.0).limit(0)
    assert scoring.adjust_scores(rounds(spark), empty, temp_unit="F").first()["score"] == 80


def test_celsius_is_converted_first(spark):
    assert scoring.adjust_scores(rounds(spark), weather(spark, 9.9, 5.0, None)).first()["score"] == 84


def test_compounded_variant(spark):
    out = scoring.adjust_scores_compounded(rounds(spark, 3), weather(spark, 40.0, 5.0, None), temp_unit="F")
    assert {r["round_id"]: r["score"] for r in out.collect()} == {1: 80 + 4 * 4, 2: 80 + 4 * 3, 3: 80 + 4 * 2}


def test_compounded_equals_once_without_adjustment(spark):
    calm = weather(spark, 60.0, 5.0, None)
    once = scoring.adjust_scores(rounds(spark, 4), calm, temp_unit="F").collect()
    many = scoring.adjust_scores_compounded(rounds(spark, 4), calm, temp_unit="F").collect()
    assert sorted(once) == sorted(many)


def test_exploratory_round_rule(spark):
    numbered = rounds(spark, 4).withColumn(
        "round_number", F.element_at(F.array(*[F.lit(n) for n in (1, 2, 11, 60)]), F.col("round_id").cast("int"))
    )
    out = scoring.adjust_scores_exploratory(numbered, weather(spark, 60.0, 5.0, None), temp_unit="F")
    assert [r["score"] for r in out.orderBy("round_id").collect()] == [81, 80, 79, 79]


# --- handicap --------------------------------------------------------------


def half_away(x: Fraction) -> int:
    return int(x + Fraction(1, 2)) if x >= 0 else -int(-x + Fraction(1, 2))


def exact_handicap(scores):
    tenths = [half_away((Fraction(s) - Fraction(673, 10)) * 113 / 119 * 10) for s in scores]
    return half_away(Fraction(sum(tenths), len(tenths)) * Fraction(96, 100)) / 10


def make(spark, histories):
    rows, round_id = [], 0
    for player, scores in histories.items():
        for i, score in enumerate(scores):
            round_id += 1
            rows.append((round_id, player, DAY + datetime.timedelta(days=i), score))
    return spark.createDataFrame(rows, "round_id long, player_id long, round_date date, score int")


def test_handicaps_and_membership(spark):
    histories = {n: [60 + (n * 7 + i * 5) % 45 for i in range(n)] for n in (1, 16, 20, 21, 29, 30)}
    players = spark.createDataFrame(
        [(n, f"P{n}", "guest", 12.3 if n == 0 else None, 0) for n in (0, *histories)] + [(99, "P99", "owner", None, 0)],
        "player_id long, player_name string, member_status string, handicap double, rounds_played int",
    )
    got = {r["player_id"]: r for r in player_stats.player_stats(players, make(spark, histories)).collect()}
    for n, scores in histories.items():
        assert got[n]["handicap"] == exact_handicap(scores[-20:])
        assert got[n]["rounds_played"] == n
        assert got[n]["member_status"] == ("member" if n >= 30 else "guest")
    assert got[0]["handicap"] == 12.3 and got[0]["rounds_played"] == 0
    assert got[99]["handicap"] is None and got[99]["member_status"] == "owner"


def test_rounding_tie_goes_away_from_zero(spark):
    for total, n, want in [(50, 16, 3), (-50, 16, -3)]:
        row = spark.range(1).select(player_stats.handicap_tenths(F.lit(total), F.lit(n)).alias("h")).first()
        assert row["h"] == want == half_away(Fraction(total, n) * Fraction(96, 100))


def test_differentials_are_exact(spark):
    df = spark.range(0, 250).select(F.col("id").cast("int").alias("s"))
    for row in df.select("s", player_stats.differential_tenths(F.col("s")).alias("d")).collect():
        assert row["d"] == half_away((Fraction(row["s"]) - Fraction(673, 10)) * 113 / 119 * 10)


def test_same_day_rounds_in_the_latest_twenty(spark):
    rows = [(i, 1, DAY, 70 + i) for i in range(1, 26)]
    df = spark.createDataFrame(rows, "round_id long, player_id long, round_date date, score int")
    assert player_stats.handicaps(df).first()["handicap"] == exact_handicap([70 + i for i in range(6, 26)])


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 30])
def test_file_order_handicap(spark, n):
    scores = [60 + (i * 11) % 45 for i in range(n)]
    kept = [scores[-i] for i in range(min(20, n))]
    assert player_stats.handicaps_file_order(make(spark, {1: scores})).first()["handicap"] == exact_handicap(kept)


def test_handicap_of_one_player(spark):
    df = make(spark, {1: [80, 90], 2: [70]})
    assert player_stats.handicap_for_player(df, 1).first()["handicap"] == exact_handicap([80, 90])
    assert player_stats.handicap_for_player(df, 7).first()["handicap"] is None
