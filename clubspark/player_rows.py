"""Player summaries in buckets: a load rewrites the buckets it touches and publishes them all at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.operators import player_stats
from clubspark.sources.tables import ParquetTables, hadoop_path

#: Buckets of player ids; fixed when a venue is founded.
BUCKETS = 64

ROWS = "player_id long, rounds long, latest array<struct<day:date,id:long,score:int>>"


class PlayerRows:
    """(player_id, rounds, latest): the round count and the 20 latest rounds of each player with rounds.

    A load's rows are merged with those of the buckets its players fall in and written below a folder of its own.
    A pointer file, put in place by one rename, then names the folder of every bucket.  Readers see the
    state before or after a load, never a part of it; files of untouched buckets stay as they are.
    Pointers are numbered by load; a load that is run again starts from the pointer before its own.
    """

    def __init__(self, tables: ParquetTables, buckets: int = BUCKETS):
        self.spark, self.buckets = tables.spark, buckets
        self.root = f"{tables.root}/player_rows"

    def _pointers(self) -> dict[int, str]:
        path, system = hadoop_path(self.spark, f"{self.root}/pointers/[0-9]*.json")
        return {int(s.getPath().getName()[:-5]): s.getPath().toString() for s in system.globStatus(path) or []}

    def pointer(self, before: int | None = None) -> dict[int, str]:
        """Folder of each bucket, by the newest pointer, or the newest of an earlier load than ``before``."""
        known = self._pointers()
        numbers = [n for n in known if before is None or n < before]
        if not numbers:
            return {}
        path, system = hadoop_path(self.spark, known[max(numbers)])
        stream = system.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): folder for b, folder in json.loads(text).items()}

    def _publish(self, pointer: dict[int, str], load_id: int) -> None:
        """Write the pointer beside its place and rename it there, in place of one of the same load."""
        jvm = self.spark.sparkContext._jvm
        name = f"{self.root}/pointers/{load_id:012d}.json"
        made, system = hadoop_path(self.spark, f"{self.root}/pointers/_{uuid.uuid4().hex}")
        out = system.create(made)
        try:
            out.write(bytearray(json.dumps(pointer).encode()))
        finally:
            out.close()
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        target, _ = hadoop_path(self.spark, name)
        qualified = system.makeQualified(target)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(system.makeQualified(made), qualified, rename)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("player_id"), F.lit(self.buckets)).cast("int")

    def _read(self, pointer: dict[int, str]) -> DataFrame:
        paths = [f"{self.root}/{folder}/bucket={b}" for b, folder in sorted(pointer.items())]
        if not paths:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*paths)

    def prepare(self, rounds: DataFrame, load_id: int) -> dict[int, str]:
        """Write the touched buckets with the rounds of a load; the pointer that would show them."""
        newer = [n for n in self._pointers() if n > load_id]
        if newer:
            raise ValueError(f"load {load_id} cannot be run again, load {min(newer)} came after it")
        pointer = self.pointer(before=load_id)
        counts, latest = player_stats.summarize(rounds)
        packed = latest.groupBy("player_id").agg(
            F.collect_list(F.struct(F.col("round_date").alias("day"), F.col("round_id").alias("id"), "score")).alias("latest")
        )
        fresh = counts.join(packed, "player_id").select("player_id", "rounds", "latest").persist()
        try:
            touched = [r[0] for r in fresh.select(self._bucket()).distinct().collect()]
            old = self._read({b: pointer[b] for b in touched if b in pointer})
            merged = old.union(fresh).groupBy("player_id").agg(  # at most two rows per player
                F.sum("rounds").alias("rounds"),
                F.slice(F.sort_array(F.flatten(F.collect_list("latest")), False), 1, player_stats.LATEST).alias("latest"),
            )
            folder = f"load={load_id}-{uuid.uuid4().hex[:8]}"
            merged.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        finally:
            fresh.unpersist()
        return pointer | dict.fromkeys(touched, folder)

    def update(self, rounds: DataFrame, load_id: int) -> None:
        """Merge the rounds of a load and publish the result."""
        self._publish(self.prepare(rounds, load_id), load_id)

    def rows(self) -> DataFrame:
        return self._read(self.pointer())

    def files(self) -> dict[int, str]:
        """Folder of each bucket as published."""
        return self.pointer()

    def stats(self, players: DataFrame) -> DataFrame:
        """Players with round count, membership and handicap; see player_stats."""
        rows = self.rows()
        latest = rows.select("player_id", F.explode("latest").alias("r")).select("player_id", "r.score")
        return player_stats.player_stats_from(players, rows.select("player_id", "rounds"), latest)
