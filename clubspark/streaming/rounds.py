"""Rounds and bookings as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clubspark import schemas
from clubspark.operators import bookings, player_stats
from clubspark.operators.ranking import latest_rounds
from clubspark.operators.scoring import adjust_scores
from clubspark.sources.tables import ParquetTables, files_below


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder or glob pattern."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def adjusted_stream(rounds: DataFrame, weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph") -> DataFrame:
    """Adjust scores as rounds arrive: stateless, against the static weather table."""
    return adjust_scores(rounds, weather, temp_unit, wind_unit)


def write_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a parquet table, each input row once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


class PlayerStatsStream:
    """Player counts and handicaps kept up to date from a stream of rounds.

    Each micro-batch is reduced to the two summaries of operators.player_stats
    and written below its batch number, so a repeated batch replaces itself.
    Reading adds the counts and ranks the kept rounds again: 20 rows per player
    and batch at most, in any order of arrival.  ``compacted_copy`` folds the
    batches so far into one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = ParquetTables(spark, root)

    @staticmethod
    def _summaries(label: str) -> tuple[str, str]:
        return f"round_counts/batch={label}", f"latest_rounds/batch={label}"

    def update(self, batch: DataFrame, batch_id: int, source: str = "stream") -> None:
        """Keep the summaries of a batch; batches of different sources may have the same number."""
        batch = batch.persist()
        try:
            for name, df in zip(self._summaries(f"{source}-{batch_id}"), player_stats.summarize(batch)):
                self.tables.replace(df, name)
        finally:
            batch.unpersist()

    def start(self, rounds: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = rounds.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def _read(self, name: str) -> DataFrame:
        if not self.tables.exists(name):
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.spark.read.schema(schemas.TABLES[name]).parquet(self.tables.path(name)).drop("batch")

    def counts(self) -> DataFrame:
        return player_stats.merge_counts(self._read("round_counts"))

    def latest(self) -> DataFrame:
        return latest_rounds(self._read("latest_rounds"), player_stats.LATEST)

    def stats(self, players: DataFrame) -> DataFrame:
        return player_stats.player_stats_from(players, self.counts(), self.latest())

    def compacted_copy(self, root: str) -> PlayerStatsStream:
        """The same state as one batch below another root, for a restart with few files."""
        copy = PlayerStatsStream(self.spark, root)
        for name, df in zip(copy._summaries("base"), (self.counts(), self.latest())):
            copy.tables.replace(df, name)
        return copy


def _latest_of_players(keep: int):
    """Rows (player_id, day, round_id, score, rounds) to the ``keep`` latest of each player, the first with the sum of all ``rounds``."""

    def run(rows: pa.Table) -> pa.Table:
        order = [("player_id", "ascending"), ("day", "descending"), ("round_id", "descending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        if not rows.num_rows:
            return rows
        key, nameless = pc.fill_null(rows["player_id"], 0).to_numpy(), pc.is_null(rows["player_id"]).to_numpy()
        begins = np.concatenate([[True], (key[1:] != key[:-1]) | (nameless[1:] != nameless[:-1])])
        starts, player = np.flatnonzero(begins), np.cumsum(begins) - 1
        totals = np.add.reduceat(rows["rounds"].to_numpy(), starts)
        # The field as it came: merged rows must join with later batches, whose counts are declared never null.
        rows = rows.set_column(4, rows.schema.field("rounds"), pa.array(np.where(begins, totals[player], 0), pa.int64()))
        return rows.filter(pa.array(np.arange(len(key)) - starts[player] < keep))

    return run


def _merged_players(keep: int):
    """Tables of rows to the ``keep`` latest of each player, merged whenever they have doubled."""
    latest = _latest_of_players(keep)

    def run(tables: Iterator[pa.Table]) -> pa.Table | None:
        held, settled = [], 0
        for table in tables:
            held.append(table)
            if sum(x.num_rows for x in held) > max(2 * settled, 100_000):
                held = [latest(pa.concat_tables(held))]
                settled = held[0].num_rows
        return latest(pa.concat_tables(held)) if held else None

    return run


def _packing():
    """(pack, unpack): a table to the bytes of a compressed Arrow stream, and back."""

    def pack(rows: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows.combine_chunks())
        return sink.getvalue().to_pybytes()

    def unpack(packed: bytes) -> pa.Table:
        return pa.ipc.open_stream(pa.py_buffer(packed)).read_all()

    return pack, unpack


class PlayerStateStream:
    """The state of each player, however many rounds and micro-batches: the count and the 20 latest rounds.

    Each task first reduces its rounds to a count and 20 rows per player, so that a player who holds a third of a
    batch sends 20 rows a task to the operator that keeps the state.  Players of a range of ids share a row of the
    state, a packed table, and are brought up to date together.  Late rounds find their place among the
    latest ones.  The state lives in the checkpoint and is read from there; a batch that is repeated starts from the
    state before it.
    """

    STATE = "kept binary"
    PARTS = "player_id long, day long, round_id long, score int, rounds long"

    def __init__(self, spark: SparkSession, checkpoint: str, keep: int = player_stats.LATEST, ids_per_range: int = 1_000):
        self.spark, self.checkpoint, self.keep = spark, checkpoint.rstrip("/"), keep
        self.ids_per_range = ids_per_range

    def reduced(self, rounds: DataFrame) -> DataFrame:
        """Per task and player the latest rounds, the first of them with the count of all."""
        merged = _merged_players(self.keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = merged(pa.Table.from_batches([x]) for x in batches)
            if rows is not None:
                yield from rows.combine_chunks().to_batches()

        day = F.unix_date("round_date").cast("long").alias("day")
        narrow = rounds.select("player_id", day, "round_id", F.col("score").cast("int").alias("score"), F.lit(1).cast("long").alias("rounds"))
        return narrow.mapInArrow(run, self.PARTS)

    def updates(self, rounds: DataFrame) -> DataFrame:
        """(player_id, rounds, days, ids, scores) of the players of each micro-batch, after it."""
        merged, (pack, unpack) = _merged_players(self.keep), _packing()
        fields = [("player_id", pa.int64()), ("day", pa.int64()), ("round_id", pa.int64()), ("score", pa.int32()), ("rounds", pa.int64())]

        def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            schema, seen = pa.schema(fields), []

            def tables() -> Iterator[pa.Table]:
                if state.exists:
                    yield unpack(state.get[0])
                for part in parts:
                    part = pa.Table.from_pandas(part, schema, preserve_index=False)
                    seen.append(part["player_id"].unique())
                    yield part

            rows = merged(tables())
            state.update((pack(rows.replace_schema_metadata()),))
            rows = rows.filter(pc.is_in(rows["player_id"], pa.concat_arrays(seen).unique())).combine_chunks()
            firsts = np.flatnonzero(rows["rounds"].to_numpy())
            ends = pa.array([*firsts, rows.num_rows], pa.int32())
            lists = [rows[c].combine_chunks() for c in ("day", "round_id", "score")]
            lists = [pa.ListArray.from_arrays(ends, x) for x in lists]
            lists = [x.to_pylist() if x.values.null_count else x.to_pandas() for x in lists]  # pandas would make nulls NaN
            each = [rows[c].take(firsts).to_pylist() for c in ("player_id", "rounds")]
            yield pd.DataFrame(dict(zip(("player_id", "rounds", "days", "ids", "scores"), [*each, *lists])))

        grouped = self.reduced(rounds).withColumn("ids", F.expr(f"player_id div {self.ids_per_range}")).groupBy("ids")
        out = "player_id long, rounds long, days array<long>, ids array<long>, scores array<int>"
        return grouped.applyInPandasWithState(update, out, self.STATE, "update", GroupStateTimeout.NoTimeout)

    def start(self, rounds: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = self.updates(rounds).writeStream.format("noop").outputMode("update")
        writer = writer.option("checkpointLocation", self.checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def _kept(self) -> DataFrame:
        """The kept rounds as rows of ``PARTS``, as of the last finished batch."""
        _, unpack = _packing()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed in batch.column(0):
                    yield from unpack(packed.as_py()).to_batches()

        stored = self.spark.read.format("statestore").load(self.checkpoint).select("value.groupState.kept")
        return stored.mapInArrow(run, self.PARTS)

    def state(self) -> DataFrame:
        """(player_id, rounds, days, ids, scores), one row per player, as of the last finished batch."""
        best = F.sort_array(F.collect_list(F.struct("day", "round_id", "score")), asc=False).alias("best")
        players = self._kept().groupBy("player_id").agg(F.sum("rounds").alias("rounds"), best)
        return players.selectExpr("player_id", "rounds", "best.day AS days", "best.round_id AS ids", "best.score AS scores")

    def stats(self, players: DataFrame) -> DataFrame:
        kept = self._kept()
        return player_stats.player_stats_from(players, player_stats.merge_counts(kept), kept.select("player_id", "score"))


class BookingStream:
    """Prices and confirms or rejects booking requests as they arrive, each booking_id once.

    A request is answered however late it comes.  Bookings are stored by ranges of ids; a micro-batch reads
    back only the ranges that its own ids fall in.  Of a batch the earliest request per id is kept, ids
    booked by other batches are left out, and the rest is written below its ranges and the batch number, so a repeated
    batch replaces itself.  Requests without an id are stored as rejected, each of them.
    Players with handicap, round counts (player_id, rounds) and weather are static sides.
    """

    def __init__(
        self, spark: SparkSession, root: str, players: DataFrame, counts: DataFrame, weather: DataFrame, ids_per_range: int = 1_000_000
    ):
        self.spark = spark
        self.tables = ParquetTables(spark, root)
        self.sides = (players, counts, weather)
        self.ids_per_range = ids_per_range

    def _range(self) -> Column:
        return F.floor(F.col("booking_id") / self.ids_per_range)

    def _path(self, number: int) -> str:
        return f"{self.tables.path('bookings')}/ids={number}"

    def booked_elsewhere(self, requests: DataFrame, batch_id: int) -> DataFrame | None:
        """Ids of other batches in the ranges of the requests, read from the folders of these ranges; None if there are none."""
        numbers = [r[0] for r in requests.where(F.col("booking_id").isNotNull()).select(self._range()).distinct().collect()]
        paths = [self._path(n) for n in sorted(numbers) if files_below(self.spark, self._path(n))]
        if not paths:
            return None
        stored = self.spark.read.option("basePath", self.tables.path("bookings")).parquet(*paths)
        return stored.where(F.col("batch") != batch_id).select("booking_id")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in ("booking_id", "booking_time")]
        order = ["booking_time", *rest] if "booking_time" in batch.columns else rest
        batch = batch.persist()
        try:
            first = batch.where(F.col("booking_id").isNotNull()).groupBy("booking_id").agg(F.min(F.struct(*order)).alias("r"))
            once = first.select("booking_id", "r.*")
            others = self.booked_elsewhere(once, batch_id)
            if others is not None:
                once = once.join(others, "booking_id", "left_anti")
            nameless = batch.where(F.col("booking_id").isNull())
            booked = bookings.book(once.unionByName(nameless), *self.sides)
            stored = booked.withColumns({"ids": self._range(), "batch": F.lit(batch_id)})
            writer = stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("ids", "batch").parquet(self.tables.path("bookings"))
        finally:
            batch.unpersist()

    def start(self, requests: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = requests.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def bookings(self) -> DataFrame:
        return self.spark.read.parquet(self.tables.path("bookings")).drop("ids", "batch")
