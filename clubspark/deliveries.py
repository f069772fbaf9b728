"""Loading a venue from a folder of CSV deliveries: each file once, in one call that may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubspark.session import materialize
from clubspark.sources import files
from clubspark.sources.tables import hadoop_path
from clubspark.venue import Venue

MANIFEST = "file_number long, family string, path string, bytes long, load_id long"

#: Rows of one file, as a power of two; a scorecard's id is its file's number and its row in it.
ROW_BITS = 36


class Deliveries:
    """Scorecard and weather files of a folder, loaded into a venue.

    A manifest lists the files taken, with the load that took them; it is written before the load, and a
    second table lists the loads that ended.  A load that broke off is run again with the same files and ids before
    any other.  A file whose size is no longer the one in the manifest is refused: its rows are stored already.
    """

    def __init__(self, venue: Venue, scorecards: str = "scorecards*.csv", weather: str = "weather*.csv"):
        self.venue, self.spark, self.tables = venue, venue.spark, venue.tables
        self.patterns = (scorecards, weather)

    def manifest(self) -> DataFrame:
        if not self.tables.exists("manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self.tables.path("manifest"))

    def _ended(self) -> set[int]:
        if not self.tables.exists("loads_ended"):
            return set()
        return {r["load_id"] for r in self.spark.read.schema("load_id long").parquet(self.tables.path("loads_ended")).collect()}

    def _sized(self, paths: list[str]) -> dict[str, int]:
        return {p: system.getFileStatus(found).getLen() for p in paths for found, system in [hadoop_path(self.spark, p)]}

    def claim(self, folder: str) -> list[tuple] | None:
        """The manifest rows to load now: those of a load that broke off, else of new files; None if there are none."""
        taken = [tuple(r) for r in self.manifest().collect()]  # one row per file ever delivered
        open_loads = sorted({r[4] for r in taken} - self._ended())
        if open_loads:
            return [r for r in taken if r[4] == open_loads[0]]
        cards, days = files.discover(self.spark, folder, *self.patterns)
        if cards is None:
            return None
        sizes = self._sized([*cards, *days])
        known = {r[2]: r[3] for r in taken}
        changed = [p for p, size in sizes.items() if known.get(p, size) != size]
        if changed:
            raise ValueError(f"changed since they were loaded: {', '.join(changed)}")
        number = max((r[0] for r in taken), default=-1)
        load_id = max((r[4] for r in taken), default=0) + 1
        new = [("scorecards", p) for p in cards if p not in known] + [("weather", p) for p in days if p not in known]
        rows = [(number + i, family, p, sizes[p], load_id) for i, (family, p) in enumerate(new, start=1)]
        if not rows:
            return None
        self.tables.replace(self.spark.createDataFrame(rows, MANIFEST).drop("load_id").coalesce(1), f"manifest/load_id={load_id}")
        return rows

    def scorecards(self, rows: list[tuple]) -> DataFrame:
        """The scorecards of claimed files with ids that do not depend on how the files are read."""
        paths = {p: n for n, family, p, _, _ in rows if family == "scorecards"}
        if not paths:
            return self.spark.createDataFrame([], files.schemas.SCORECARDS).withColumn("scorecard_id", F.lit(0).cast("long"))
        numbers = self.spark.createDataFrame(list(paths.items()), "path string, file_number long")
        cards = files.with_row_number(files.read_scorecards(self.spark, list(paths)))
        named = cards.join(F.broadcast(numbers), "path")  # one row per claimed file
        return named.withColumn("scorecard_id", F.shiftleft("file_number", ROW_BITS) + F.col("row_number")).drop("path", "file_number", "row_number")

    def load(self, folder: str, **options) -> int | None:
        """Load what is new in a folder; the number of the load, or None if nothing is new."""
        rows = self.claim(folder)
        if rows is None:
            return None
        load_id = rows[0][4]
        days = [r[2] for r in rows if r[1] == "weather"]
        weather = files.read_weather(self.spark, days) if days else self.spark.createDataFrame([], files.schemas.WEATHER_RAW)
        self.venue.load(materialize(self.scorecards(rows)), weather, load_id, **options)
        self.tables.replace(self.spark.createDataFrame([(load_id,)], "load_id long").coalesce(1), f"loads_ended/load={load_id}")
        return load_id

    def load_all(self, folder: str, **options) -> list[int]:
        """Loads until nothing is new, so that a load that broke off is followed by the files that came since."""
        done = []
        while (load_id := self.load(folder, **options)) is not None:
            done.append(load_id)
        return done
