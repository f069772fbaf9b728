import datetime

import pytest

from clubspark import schemas
from clubspark.operators import reshape
from clubspark.session import shared_folder
from clubspark.sources import files
from clubspark.sources.tables import JdbcTables

CARDS = """Year,Name,Course,Yards,Par,Open.Position,Integer.Position,Position.Grouping,Open.R1,Open.R2,Open.R3,Open.R4
2021,Ann Example,Links,7100,70,T2,2,2,72,75,0,0
2021,,Links,7100,70,3,3,3,80,81,82,83
2022,Bo Example,Links,7100,70,1,1,1,70,71,72,73
"""
WEATHER = """time,tavg,tmin,tmax,prcp,wdir,wspd,pres
2018-05-01,11.5,5.0,18.0,0.0,200.0,12.1,1015.2
2018-05-02,,5.0,18.0,1.5,200.0,,1015.2
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "scorecards_b.csv").write_text(CARDS)
    (tmp_path / "scorecards_a.csv").write_text(CARDS)
    (tmp_path / "weather.csv").write_text(WEATHER)
    return tmp_path


def test_discover(spark, folder, tmp_path):
    cards, days = files.discover(spark, str(folder))
    assert [p.rsplit("/", 1)[1] for p in cards] == ["scorecards_a.csv", "scorecards_b.csv"] and len(days) == 1
    assert len(files.discover(spark, str(folder), first_only=True)[0]) == 1
    (folder / "weather.csv").unlink()
    assert files.discover(spark, str(folder)) == (None, None)
    assert files.discover(spark, str(tmp_path / "none")) == (None, None)


def test_read_and_clean(spark, folder):
    cards, days = files.discover(spark, str(folder))
    read = files.with_scorecard_id(files.read_scorecards(spark, cards), start=100)
    assert read.count() == 6
    rounds = reshape.unpivot_rounds(read)
    assert rounds.count() == 16 and reshape.played(rounds).count() == 12
    ids = [r["scorecard_id"] for r in read.select("scorecard_id").collect()]
    assert len(set(ids)) == 6 and min(ids) == 100
    weather = reshape.clean_weather(files.read_weather(spark, days)).orderBy("date").collect()
    assert [(r["avg_temp"], r["wind_speed"]) for r in weather] == [(11.5, 12.1), (None, None)]


def test_inferred_schema(spark, folder):
    inferred = files.read_scorecards(spark, str(folder / "scorecards_a.csv"), infer=True)
    assert dict(inferred.dtypes)["Open.R1"] == "int"
    assert reshape.unpivot_rounds(files.with_scorecard_id(inferred)).count() == 8


def test_csv_round_trip(spark, folder, tmp_path):
    df = files.read_scorecards(spark, str(folder / "scorecards_a.csv"))
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(files.read_csv(spark, str(tmp_path / "out"), schemas.SCORECARDS).collect(), key=str) == sorted(df.collect(), key=str)


def test_jdbc_options(spark):
    """Only the options are checked: there is no database to read from."""
    db = JdbcTables(spark, "jdbc:postgresql://host/db", user="u")
    split = db.read_options("rounds", "round_id", (1, 1000), 16)
    assert split["dbtable"] == "rounds" and split["numPartitions"] == "16" and split["upperBound"] == "1000"
    assert "numPartitions" not in db.read_options("rounds")
    assert db.query_options("SELECT 1")["query"] == "SELECT 1"
    assert db.write_options("rounds")["batchsize"] == "10000"
    asked = db.query_options("SELECT ':n', a::int FROM {players} WHERE name = :name AND born < :day", {"name": "O'Neil", "day": datetime.date(2000, 1, 2)})
    assert asked["query"] == "SELECT ':n', a::int FROM players WHERE name = 'O''Neil' AND born < DATE '2000-01-02'"
    with pytest.raises(KeyError):
        db.query_options("SELECT :missing")
    there = db.exists_options("club.o'rounds")["query"]
    assert there.endswith("WHERE table_name = 'o''rounds' AND table_schema = 'club' LIMIT 1")
    assert "table_schema" not in db.exists_options("rounds")["query"]


class Session:
    """Just the settings shared_folder looks at."""

    def __init__(self, folder, master):
        self.conf = self
        self.sparkContext = self
        self.folder, self.master = folder, master

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" and self.folder else default


def test_shared_folder_follows_the_session():
    assert shared_folder(Session("hdfs://all/", "yarn")).startswith("hdfs://all/clubspark-")
    assert "clubspark-" in shared_folder(Session(None, "local[2]"))
    with pytest.raises(RuntimeError):
        shared_folder(Session(None, "yarn"))
