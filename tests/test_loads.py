import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clubspark import schemas
from clubspark.deliveries import Deliveries
from clubspark.operators import loading, player_stats, quality
from clubspark.player_rows import PlayerRows
from clubspark.sources import files
from clubspark.sources.tables import ParquetTables
from clubspark.venue import Venue

COLUMNS = "scorecard_id long, Name string, `Open.R1` int, `Open.R2` int, `Open.R3` int, `Open.R4` int"


@pytest.fixture(scope="module")
def weather(spark):
    days = F.sequence(F.lit("2017-04-01").cast("date"), F.lit("2022-12-31").cast("date"))
    return spark.range(1).select(F.explode(days).alias("time")).select(
        "time",
        (F.dayofyear("time") % 35).cast("double").alias("tavg"),
        (F.dayofyear("time") % 4 * 4).cast("double").alias("prcp"),
        (F.dayofyear("time") % 20).cast("double").alias("wspd"),
    )


def cards(spark, ids):
    rows = [(i, None if i % 9 == 8 else f"Player {i % 5}", 70 + i % 30, 75 + i % 20, (i % 3) * 40, 90) for i in ids]
    return spark.createDataFrame(rows, COLUMNS)


def players_of(venue):
    return sorted(tuple(r) for r in venue.players().collect())


def test_loads_are_incremental_and_repeatable(spark, weather, tmp_path):
    venue = Venue(ParquetTables(spark, str(tmp_path / "a")))
    assert venue.players().count() == 0 and venue.rounds().count() == 0
    venue.load(cards(spark, range(0, 4)), weather, 1)
    first_ids = {r["player_name"]: r["player_id"] for r in venue.players().collect()}
    venue.load(cards(spark, range(4, 40)), weather, 2)
    once = players_of(venue)
    assert {r["player_name"]: r["player_id"] for r in venue.players().collect()}.items() >= first_ids.items()
    assert sorted(r[0] for r in once) == list(range(1, 6))

    venue.load(cards(spark, range(4, 40)), weather, 2)  # the same load again replaces itself
    assert players_of(venue) == once
    assert players_of(venue) == sorted(tuple(r) for r in venue.rebuilt_players().collect())
    assert venue.weather().count() == venue.weather().select("date").distinct().count()
    assert venue.rounds().count() == venue.rounds().select("round_id").distinct().count()
    assert venue.rounds().where(F.col("score").isNull()).count() == 0

    other = Venue(ParquetTables(spark, str(tmp_path / "b")))
    other.load(cards(spark, range(0, 40)), weather, 1)
    strip = lambda rows: sorted(r[1:] for r in rows)
    assert strip(players_of(other)) == strip(once)

    numbered = venue.numbered_rounds().groupBy("player_id").agg(F.max("round_number").alias("m"), F.count("*").alias("n"))
    assert numbered.where(F.col("m") != F.col("n")).count() == 0


def test_quality_checks(spark):
    players = spark.createDataFrame(
        [(1, "A"), (1, "B"), (2, None), (3, "x" * 101)], "player_id long, player_name string"
    )
    rounds = spark.createDataFrame([(1, 1), (2, 7), (3, 7), (4, None)], "round_id long, player_id long")
    unique = quality.check_unique([("players", players, "player_id"), ("players", players, "player_name")]).collect()
    assert [(r["duplicate_keys"], r["surplus_rows"]) for r in unique] == [(1, 1), (0, 0)]
    columns = quality.check_columns([("players", players, ["player_name"], {"player_name": 100})]).collect()
    assert [(r["rule"], r["violations"]) for r in columns] == [("not_null", 1), ("length", 1)]
    keys = quality.check_foreign_keys([("rounds.player_id", rounds, "player_id", players, "player_id")]).first()
    assert (keys["orphan_keys"], keys["orphan_rows"]) == (1, 2)


def test_missing_table_is_empty(spark, tmp_path):
    tables = ParquetTables(spark, str(tmp_path))
    assert tables.read("weather").count() == 0
    tables.append(spark.createDataFrame([(datetime.date(2020, 1, 1), 1.0)], "date date, avg_temp double"), "weather")
    assert tables.query("SELECT * FROM {weather} WHERE avg_temp = :t", {"t": 1.0}).count() == 1


def rounds_of(spark, ids, players):
    rows = [(i, i % players, datetime.date(2020, 5, 1) + datetime.timedelta(days=i % 200), 70 + i % 30) for i in ids]
    return spark.createDataFrame(rows, "round_id long, player_id long, round_date date, score int")


def test_a_load_rewrites_only_touched_buckets(spark, tmp_path):
    rows = PlayerRows(ParquetTables(spark, str(tmp_path)), buckets=8)
    people = spark.createDataFrame([(i, f"P{i}", "guest", None, 0) for i in range(60)], schemas.PLAYERS)
    assert rows.stats(people).where("rounds_played > 0").count() == 0
    first, second = rounds_of(spark, range(3000), 60), rounds_of(spark, range(3000, 3050), 60).where("player_id < 2")
    rows.update(first, 1)
    before = {f: Path(f).stat().st_mtime_ns for f in map(str, (tmp_path / "player_rows").rglob("*.parquet"))}
    pointer = rows.pointer()
    rows.update(second, 2)
    assert {f: Path(f).stat().st_mtime_ns for f in before} == before
    changed = {b for b, folder in rows.pointer().items() if folder != pointer[b]}
    assert 1 <= len(changed) <= 2
    want = sorted(tuple(r) for r in player_stats.player_stats(people, first.union(second)).collect())
    assert sorted(tuple(r) for r in rows.stats(people).collect()) == want
    rows.update(second, 2)  # the same load again
    assert sorted(tuple(r) for r in rows.stats(people).collect()) == want
    with pytest.raises(ValueError, match="came after"):
        rows.update(first, 1)


def test_a_load_that_breaks_off_before_publishing_is_not_seen(spark, tmp_path):
    rows = PlayerRows(ParquetTables(spark, str(tmp_path)), buckets=4)
    rows.update(rounds_of(spark, range(100), 5), 1)
    seen = sorted(map(str, rows.rows().collect()))
    pointer = rows.prepare(rounds_of(spark, range(100, 150), 5), 2)  # written, not published
    assert sorted(map(str, rows.rows().collect())) == seen and rows.pointer() != pointer
    rows.update(rounds_of(spark, range(100, 150), 5), 2)
    assert rows.rows().agg(F.sum("rounds")).first()[0] == 150


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Open.R1\n" + "".join(f"Player {i},{i}\n" for i in range(4000)))
    (tmp_path / "b.csv").write_text("Name,Open.R1\n" + "".join(f"Other {i},{i}\n" for i in range(50)))
    schema = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Open.R1", T.IntegerType())])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            numbered = files.with_row_number(files.read_csv(spark, str(tmp_path), schema))
            assert numbered.count() == 4050
            assert numbered.where(F.col("`Open.R1`") != F.col("row_number")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


HEADER = "Year,Name,Course,Yards,Par,Open.Position,Integer.Position,Position.Grouping,Open.R1,Open.R2,Open.R3,Open.R4\n"


def deliver(folder, name, players, days):
    (folder / f"scorecards_{name}.csv").write_text(HEADER + "".join(f"2020,{p},,,,,,,70,75,0,80\n" for p in players))
    lines = "".join(f"{d},20,,,0,,5,\n" for d in days)
    (folder / f"weather_{name}.csv").write_text("time,tavg,tmin,tmax,prcp,wdir,wspd,pres\n" + lines)


def test_each_file_is_loaded_once(spark, tmp_path):
    every_day = [datetime.date(2017, 4, 1) + datetime.timedelta(days=i) for i in range(2100)]
    folder = tmp_path / "in"
    folder.mkdir()
    venue = Venue(ParquetTables(spark, str(tmp_path / "tables")))
    arrivals = Deliveries(venue)
    assert arrivals.load_all(str(folder)) == []
    deliver(folder, "1", ["Ann", "Ben"], every_day)
    assert arrivals.load_all(str(folder)) == [1]
    once = sorted(map(str, venue.rounds().collect()))
    assert len(once) == 6
    assert arrivals.load_all(str(folder)) == [] and sorted(map(str, venue.rounds().collect())) == once
    deliver(folder, "2", ["Ann", "Cem", "Ann"], every_day[:5])
    assert arrivals.load_all(str(folder)) == [2]
    assert {r["player_name"]: r["rounds_played"] for r in venue.players().collect()} == {"Ann": 9, "Ben": 3, "Cem": 3}
    assert venue.rounds().select("round_id").distinct().count() == 15
    deliver(folder, "1", ["Ann", "Ben", "Dan"], every_day)
    with pytest.raises(ValueError, match="changed since"):
        arrivals.load_all(str(folder))


def test_a_load_that_broke_off_is_finished_first(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    deliver(folder, "1", ["Ann"], [datetime.date(2017, 4, 1) + datetime.timedelta(days=i) for i in range(2100)])
    venue = Venue(ParquetTables(spark, str(tmp_path / "tables")))
    arrivals = Deliveries(venue)
    with monkeypatch.context() as patch:
        patch.setattr(venue.state, "update", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            arrivals.load_all(str(folder))
    broken = sorted(map(str, venue.rounds().collect()))
    deliver(folder, "2", ["Ben"], [])
    assert arrivals.load_all(str(folder)) == [1, 2]
    rounds = venue.rounds()
    assert sorted(map(str, rounds.where("player_name = 'Ann'").collect())) == broken  # the same ids and dates again
    assert {r["player_name"]: r["rounds_played"] for r in venue.players().collect()} == {"Ann": 3, "Ben": 3}


def test_declared_rules_name_every_key_and_reference():
    kinds = [(r.table, r.column, r.kind) for t in ("players", "weather", "rounds", "bookings") for r in quality.declared_rules(t)]
    assert len(kinds) == len(set(kinds)) == 24
    assert ("bookings", "booking_id", "not_null") in kinds and ("weather", "date", "unique") in kinds
    assert ("rounds", "round_date", "reference") in kinds and ("players", "member_status", "length") in kinds


def test_declared_rules_find_what_breaks_them(spark):
    day = datetime.date(2020, 5, 1)
    tables = {
        "players": spark.createDataFrame(
            [(1, "A", "guest", None, 0), (1, "A", "x" * 21, None, 0), (1, "B", None, None, 0), (None, None, "guest", None, 0)],
            "player_id long, player_name string, member_status string, handicap double, rounds_played int",
        ),
        "weather": spark.createDataFrame([], schemas.WEATHER),
        # A third column of the same name as those the check uses itself must not matter.
        "rounds": spark.createDataFrame(
            [(1, 1, "A", day, 80, "k"), (2, 7, "A", None, None, "k"), (2, None, "y" * 101, day, 81, None)],
            "round_id long, player_id long, player_name string, round_date date, score int, key string",
        ),
    }
    got = {(r["table_name"], r["column_name"], r["rule"]): r["violations"] for r in quality.check_declared(tables).collect()}
    broken = {k: n for k, n in got.items() if n}
    assert broken == {
        ("players", "player_id", "not_null"): 1,
        ("players", "player_name", "not_null"): 1,
        ("players", "player_id", "unique"): 2,
        ("players", "player_name", "unique"): 1,
        ("players", "member_status", "length"): 1,
        ("rounds", "round_id", "unique"): 1,
        ("rounds", "score", "not_null"): 1,
        ("rounds", "player_name", "length"): 1,
        ("rounds", "player_id", "reference"): 1,
        ("rounds", "round_date", "reference"): 2,
    }
    assert all(n == 0 for n in {k: n for k, n in got.items() if k[0] == "weather"}.values()) and len(got) == 16


def test_audit_counts_names_and_rounds_in_one_pass(spark, weather):
    known = spark.createDataFrame([(1, "Player 0"), (2, "Nobody")], "player_id long, player_name string")
    delivered = cards(spark, range(40)).union(
        spark.createDataFrame([(900, "Never played", 0, 0, None, 0)], COLUMNS)
    )
    days = weather.select(F.col("time").alias("date"))
    stored = spark.range(7)
    audit = {r["table_name"]: r.asDict() for r in loading.load_audit(delivered, known, days, days.limit(0), stored).collect()}
    named = [c for c in delivered.collect() if c["Name"] is not None]
    scores = [c[f"Open.R{k}"] for c in named for k in (1, 2, 3, 4)]
    played = sum(1 for s in scores if s)
    assert audit["players"] == {"table_name": "players", "found": 6, "existing": 2, "new": 5, "rejected": 0, "final": 7}
    assert audit["rounds"]["found"] == len(scores) and audit["rounds"]["new"] == played
    assert audit["rounds"]["rejected"] == len(scores) - played and audit["rounds"]["final"] == 7 + played
    assert audit["weather"]["new"] == audit["weather"]["found"] == days.count()
