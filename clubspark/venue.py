"""The stored tables of a venue and their incremental load."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clubspark import schemas
from clubspark.operators import loading, player_stats, ranking, reshape
from clubspark.player_rows import PlayerRows
from clubspark.sources.tables import ParquetTables


class Venue:
    """Players, weather, rounds and per-player state below one folder.

    A load has an id.  Players and weather are appended by anti-join; the
    rounds of a load are written below its id, so a load that is run again after a failure replaces
    itself.  Only the buckets of the players in a load are rewritten, and published together.
    """

    def __init__(self, tables: ParquetTables):
        self.tables = tables
        self.spark = tables.spark
        self.state = PlayerRows(tables)

    def load(
        self,
        scorecards: DataFrame,
        raw_weather: DataFrame,
        load_id: int,
        seed: int = 0,
        temp_unit: str = "C",
        wind_unit: str = "mph",
        tie_break: tuple[str, ...] = ("tavg", "prcp", "wspd"),
    ) -> None:
        """Load one delivery: new names, new days, then all its rounds.

        ``scorecards`` carry a ``scorecard_id`` that no earlier load used.
        """
        self.tables.append(loading.load_players(scorecards, self.tables.read("players")), "players")
        cleaned = reshape.clean_weather(raw_weather, tie_break)
        self.tables.append(loading.new_weather(cleaned, self.tables.read("weather")), "weather")
        rounds = loading.load_rounds(
            scorecards,
            self.tables.read("players"),
            self.tables.read("weather"),
            seed=seed,
            temp_unit=temp_unit,
            wind_unit=wind_unit,
        )
        name = f"rounds/load={load_id}"
        self.tables.replace(rounds, name)
        self.state.update(self.spark.read.schema(schemas.ROUNDS).parquet(self.tables.path(name)), load_id)

    def rounds(self) -> DataFrame:
        """All stored rounds; the round number is left to :meth:`numbered_rounds`."""
        if not self.tables.exists("rounds"):
            return self.tables.read("rounds")
        return self.spark.read.schema(schemas.ROUNDS).parquet(self.tables.path("rounds")).drop("load")

    def numbered_rounds(self) -> DataFrame:
        return ranking.round_numbers(self.rounds())

    def weather(self) -> DataFrame:
        return self.tables.read("weather")

    def players(self) -> DataFrame:
        """Players with round count, membership and handicap from the kept summaries."""
        return self.state.stats(self.tables.read("players"))

    def rebuilt_players(self) -> DataFrame:
        """The same from all stored rounds, to check the summaries against."""
        return player_stats.player_stats(self.tables.read("players"), self.rounds())
