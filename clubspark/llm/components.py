"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubspark.session import materialize


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """The smallest node reachable from each node that has an edge to another one.

    edges: (u, v) of any ordered type, in either direction; loops, repeats and nulls are ignored.
    Returns (node, root), roots included.  Large and small stars alternate until nothing
    changes, which takes a number of rounds that grows with the logarithm of the
    longest chain.  Each round's edges, never more than before, are written to the shared
    folder, so that a lost executor costs one round at most; a node of very many
    edges is one row in the side that holds minima, and adaptive execution may cut the other.
    """
    pairs = materialize(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _state(pairs)
    for _ in range(rounds):
        if not before[0]:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(
            both.join(low, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        pairs = materialize(
            joined.select("u", F.col("m").alias("v"))
            .union(joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        after = _state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
