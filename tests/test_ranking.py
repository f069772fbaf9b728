import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clubspark.operators import ranking


@pytest.fixture(scope="module")
def rounds(spark):
    rng = random.Random(7)
    rows = []
    for round_id in rng.sample(range(5000), 900):
        player = 1 if rng.random() < 0.4 else rng.randrange(2, 40)
        rows.append((round_id, player, rng.randrange(6), rng.randrange(60, 110)))
    return spark.createDataFrame(rows, "round_id long, player_id long, d int, score int").withColumn(
        "round_date", F.date_add(F.lit("2020-05-01").cast("date"), F.col("d"))
    )


def numbered(df, name):
    return {row["round_id"]: row[name] for row in df.collect()}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("order", [["round_date"], []])
def test_split_positions_equal_plain_window(rounds, order, descending):
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in [*order, "round_id"]]
    nulls = rounds.withColumn("player_id", F.when(F.col("player_id") != 5, F.col("player_id")))
    nulls = nulls.withColumn("round_date", F.when(F.col("d") != 2, F.col("round_date")))
    plain = nulls.withColumn("p", F.row_number().over(Window.partitionBy("player_id").orderBy(*sort)))
    split = ranking.position_in_key(nulls, "player_id", order, "round_id", "p", descending)
    assert numbered(plain, "p") == numbered(split, "p")
    assert split.schema["p"].dataType == plain.schema["p"].dataType and split.columns == plain.columns


def test_a_key_in_many_pieces(spark, rounds):
    """Without coalescing, the player of two rows in five lies in several range partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers = ranking.round_numbers(rounds).where("player_id = 1").select("round_number").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(n for (n,) in numbers) == list(range(1, len(numbers) + 1))


def test_positions_of_no_rows(rounds):
    assert ranking.round_numbers(rounds.limit(0)).count() == 0


def test_round_numbers_run_from_one(rounds):
    out = ranking.round_numbers(rounds).groupBy("player_id").agg(
        F.sort_array(F.collect_list("round_number")).alias("n"), F.count("*").alias("c")
    )
    assert all(row["n"] == list(range(1, row["c"] + 1)) for row in out.collect())


def test_same_day_rounds_are_ordered_by_id(spark):
    rows = [(5, 1, 0), (3, 1, 0), (9, 1, -1)]
    df = spark.createDataFrame(rows, "round_id long, player_id long, d int").withColumn(
        "round_date", F.date_add(F.lit("2020-05-02").cast("date"), F.col("d"))
    )
    assert numbered(ranking.round_numbers(df), "round_number") == {9: 1, 3: 2, 5: 3}


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_dense_ids(spark, bits):
    seen = random.Random(3).sample(range(10**4), 300) + [2**50, 2**41 + 5]
    df = spark.createDataFrame([(s,) for s in seen], "first_seen long")
    out = ranking.dense_ids(df, "first_seen", "id", F.lit(100), chunk_bits=bits)
    got = {row["first_seen"]: row["id"] for row in out.collect()}
    assert got == {s: 101 + i for i, s in enumerate(sorted(seen))}


def test_latest_and_first(rounds):
    rows = rounds.collect()
    latest = {r["round_id"] for r in ranking.latest_rounds(rounds, 3).collect()}
    first = {r["round_id"] for r in ranking.first_rounds(rounds, 2).collect()}
    by_player = {}
    for r in sorted(rows, key=lambda r: (r["round_date"], r["round_id"])):
        by_player.setdefault(r["player_id"], []).append(r["round_id"])
    assert latest == {i for ids in by_player.values() for i in ids[-3:]}
    assert first == {i for ids in by_player.values() for i in ids[:2]}
