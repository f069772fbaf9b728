"""Exact order statistics of columns of any domain, by counting in ever narrower ranges.

No task and no buffer ever holds the values of a column: a pass counts the values of the ranges that still
hold a wanted rank in equal pieces, keeps least and greatest value of each, and goes on in the pieces that
hold the ranks.  A piece of one value is the answer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that a range is cut into; a pass shuffles at most so many rows per range and task.
PIECES = 4096


@dataclass
class Range:
    """Values of one column from low to high, those below it, and the ranks wanted in it."""

    column: str
    low: float
    high: float
    below: int
    ranks: list[int]

    def piece(self) -> Column:
        """Place of a value among the pieces; halves where the width of the range would not be finite."""
        x = F.col(f"`{self.column}`")
        if math.isinf(self.high - self.low):
            share = (x / 2 - self.low / 2) / (self.high / 2 - self.low / 2)
        else:
            share = (x - self.low) / (self.high - self.low)
        return F.least(F.floor(share * PIECES), F.lit(PIECES - 1)).cast("int")


def summaries(df: DataFrame, names: list[str]) -> DataFrame:
    """One struct per column: count, mean, sample sd, least and greatest value, NaNs, infinities, finite ends."""

    def one(name: str) -> Column:
        x = F.col(f"`{name}`")
        finite = F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)
        return F.struct(
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.count(F.when(x == -math.inf, 1)).alias("lowest"),
            F.count(F.when(x == math.inf, 1)).alias("highest"),
            F.min(finite).alias("low"),
            F.max(finite).alias("high"),
            F.count(finite).alias("finite"),
        ).alias(name)

    return df.agg(*[one(n) for n in names])


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], known: dict[str, dict]) -> dict[tuple[str, int], float]:
    """The values at ranks (from 0) of each column's values that are not null; NaN is the greatest.

    df: double columns that read the same in every pass; known: what ``summaries`` says of each column.
    """
    out: dict[tuple[str, int], float] = {}
    ranges = []
    for name, ranks in wanted.items():
        s = known[name]
        inside = []
        for rank in sorted(set(ranks)):
            if rank < s["lowest"]:
                out[name, rank] = -math.inf
            elif rank < s["lowest"] + s["finite"]:
                inside.append(rank)
            else:
                out[name, rank] = math.inf if rank < s["lowest"] + s["finite"] + s["highest"] else math.nan
        if inside and s["low"] == s["high"]:
            out |= {(name, rank): s["low"] for rank in inside}
        elif inside:
            ranges.append(Range(name, s["low"], s["high"], s["lowest"], inside))
    while ranges:
        ranges = _narrowed(df, ranges, out)
    return out


def _narrowed(df: DataFrame, ranges: list[Range], out: dict[tuple[str, int], float]) -> list[Range]:
    """One pass: ranks in pieces of one value are answered, the other pieces are the next ranges."""
    entries = []
    for i, r in enumerate(ranges):
        x = F.col(f"`{r.column}`")
        entries.append(F.when(x.between(r.low, r.high), F.struct(F.lit(i).alias("i"), r.piece().alias("piece"), x.alias("x"))))
    pieces = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.i", "e.piece")
    pieces = pieces.agg(F.count(F.lit(1)).alias("n"), F.min("e.x").alias("low"), F.max("e.x").alias("high"))
    before = Window.partitionBy("i").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    holds = F.lit(False)
    for i, r in enumerate(ranges):
        for rank in r.ranks:
            at = rank - r.below
            holds = holds | ((F.col("i") == i) & (F.col("below") <= at) & (F.col("below") + F.col("n") > at))
    following = []
    for row in placed.where(holds).collect():  # at most one row per wanted rank
        r = ranges[row["i"]]
        below = r.below + row["below"]
        ranks = [rank for rank in r.ranks if below <= rank < below + row["n"]]
        if row["low"] == row["high"]:
            out |= {(r.column, rank): row["low"] for rank in ranks}
        else:
            following.append(Range(r.column, row["low"], row["high"], below, ranks))
    return following


def interpolated(values: dict[tuple[str, int], float], name: str, count: int, share: float) -> float | None:
    """The quantile between its two neighbouring ranks."""
    if not count:
        return None
    place = (count - 1) * share
    lower, upper = math.floor(place), math.ceil(place)
    low, high = values[name, lower], values[name, upper]
    return low if low == high or lower == upper else (upper - place) * low + (place - lower) * high


def ranks_of(count: int, shares: list[float]) -> list[int]:
    return [f((count - 1) * s) for s in shares for f in (math.floor, math.ceil)] if count else []
