"""Positions and ids that stay distributed when one key holds much of the data.

A plain ``row_number().over(partitionBy(key))`` sends all rows of a key to one
task.  Here all rows are range-partitioned along key and sort order, so that a
key of any size, null included, lies in as many even pieces as it needs; a row's
position is its place in the piece plus the rows of its key in the pieces before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clubspark.session import materialize

# Ids without a key are ranked in ranges of 2**16, 2**32 and 2**48 ids.
DENSE_BITS = 16


def _numbered_in_task(key: str):
    """Numbers the rows of each key in a sorted partition; marks the first key's rows and the last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, last, head = None, 0, None, True

        def out(batch: pa.RecordBatch, local, heads, ends: bool) -> pa.RecordBatch:
            flags = np.zeros(batch.num_rows, bool)
            flags[-1] = ends
            columns = [*batch.columns, pa.array(local, pa.int64()), pa.array(heads, pa.bool_()), pa.array(flags, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_local", "_head", "_last"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            left, right = keys.slice(0, n - 1), keys.slice(1)
            both_null = pc.and_(pc.is_null(left), pc.is_null(right))
            same = pc.or_(pc.fill_null(pc.equal(left, right), False), both_null).to_numpy(zero_copy_only=False)
            first = keys[0].as_py()
            goes_on = held is None or first == last
            begins = np.concatenate([[not goes_on], ~same.astype(bool)])
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(begins, at, -1))
            local = np.where(start < 0, before + at + 1, at - start + 1)
            heads = (start < 0) & head
            head = bool(heads[-1])
            if held is not None:
                yield out(*held, False)
            held, before, last = (batch, local, heads), int(local[-1]), keys[n - 1].as_py()
        if held is not None:
            yield out(*held, True)

    return run


def position_in_key(
    df: DataFrame, key: str, order: Sequence[str], id_col: str, out: str, descending: bool = False
) -> DataFrame:
    """1-based position of each row among the rows of its key, by ``order`` then the unique id.

    Rows are numbered along their sorted partition and written once, as the range bounds are drawn anew for each job.
    Only a partition's first key can begin in an earlier one; its offset is the sum of the last numbers of
    the partitions before that end in the same key, one row per partition.
    """
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in [*order, id_col]]
    placed = df.repartitionByRange(F.col(key), *sort).sortWithinPartitions(F.col(key), *sort)
    placed = placed.withColumn("_task", F.spark_partition_id())
    marks = [T.StructField("_local", T.LongType()), T.StructField("_head", T.BooleanType()), T.StructField("_last", T.BooleanType())]
    numbered = materialize(placed.mapInArrow(_numbered_in_task(key), T.StructType([*placed.schema.fields, *marks])))
    # a struct is never null and equals another with the same null, so null keys need no case of their own
    edge = [F.struct(F.col(key).alias("key")).alias("_key"), F.col("_task")]
    first = numbered.where(F.col("_head") & (F.col("_local") == 1)).select(*edge, F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_first"))
    ends = numbered.where("_last").select(*edge, F.col("_local").alias("_n"), F.lit(False).alias("_first"))
    earlier = Window.partitionBy("_key").orderBy("_task").rangeBetween(Window.unboundedPreceding, -1)
    offsets = first.union(ends).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_first")
    offsets = F.broadcast(offsets.select(F.col("_task").alias("_in"), F.lit(True).alias("_at_head"), "_before"))  # one row per partition
    joined = numbered.join(offsets, (F.col("_task") == F.col("_in")) & (F.col("_head") == F.col("_at_head")), "left")
    number = F.col("_local") + F.coalesce("_before", F.lit(0))
    return joined.select(*df.columns, number.cast("int").alias(out))


def _offsets(counts: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rows before each range, summed level by level so no window spans all ranges."""
    out = counts.withColumn("_before", F.lit(0).cast("bigint"))
    for depth in range(len(levels), 0, -1):
        parent, this = levels[: depth - 1], levels[depth - 1]
        totals = counts.groupBy(*parent, this).agg(F.sum("_n").alias("_t"))
        preceding = Window.partitionBy(*parent).orderBy(this).rowsBetween(Window.unboundedPreceding, -1)
        cumulated = totals.select(*parent, this, F.coalesce(F.sum("_t").over(preceding), F.lit(0)).alias("_c"))
        out = (
            out.join(cumulated, [*parent, this])
            .withColumn("_before", F.col("_before") + F.col("_c"))
            .drop("_c")
        )
    return out.drop("_n")


def dense_ids(df: DataFrame, order_id: str, out: str, start: Column | None = None, chunk_bits: int = DENSE_BITS) -> DataFrame:
    """Ids start+1, start+2, ... in the order of the unique number ``order_id``.

    Ranges of that number are ranked separately and shifted by the counts
    before them; the only window over everything runs on at most 2**16 counts.
    """
    levels = ["_level0", "_level1", "_level2"]
    number = F.col(order_id).cast("bigint")
    cut = df.withColumns({name: F.shiftright(number, k * chunk_bits) for name, k in zip(levels, (3, 2, 1))})
    counts = cut.groupBy(*levels).agg(F.count(F.lit(1)).alias("_n"))
    before = _offsets(counts, levels)
    local = F.row_number().over(Window.partitionBy(*levels).orderBy(order_id))
    number = F.col("_local") + F.col("_before")
    if start is not None:
        number = number + start
    return (
        cut.withColumn("_local", local)
        .join(before, levels)
        .withColumn(out, number.cast("bigint"))
        .select(*df.columns, out)
    )


def round_numbers(rounds: DataFrame) -> DataFrame:
    """Number each player's rounds 1..n by date."""
    return position_in_key(rounds.drop("round_number"), "player_id", ["round_date"], "round_id", "round_number")


def first_rounds(rounds: DataFrame, n: int) -> DataFrame:
    """Each player's first n rounds with their numbers; pruned before the shuffle."""
    by_date = Window.partitionBy("player_id").orderBy("round_date", "round_id")
    return rounds.withColumn("round_number", F.row_number().over(by_date)).where(F.col("round_number") <= n)


def latest_rounds(rounds: DataFrame, n: int = 20) -> DataFrame:
    """Each player's n latest rounds; pruned before the shuffle."""
    newest = Window.partitionBy("player_id").orderBy(F.col("round_date").desc(), F.col("round_id").desc())
    return rounds.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= n).drop("_age")


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a full order: a per-task top-n, then one small merge."""
    return df.orderBy(*order).limit(n)
