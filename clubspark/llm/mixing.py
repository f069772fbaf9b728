"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.llm.common import small
from clubspark.session import materialize

SEED = 17

#: Weight of a source: its size to this power, so that small sources gain.
TEMPERATURE = 0.5

#: Size of the mixture as a multiple of the input.
EPOCHS = 1.0

#: Means above this are drawn as a sum of equal parts, whose first term still is a normal number.
PART = 500.0


def size_of(docs: DataFrame) -> Column:
    """A document's size: bytes of text and one for its end."""
    return F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long") + 1


def rates(docs: DataFrame, weights: DataFrame | None, temperature: float, epochs: float) -> DataFrame:
    """Stored frame (source, rate): how often a document of each source is to appear in the mean."""
    sizes = docs.groupBy("source").agg(F.sum(size_of(docs)).cast("double").alias("size"))
    sizes = materialize(sizes)
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(float(temperature))))
    else:
        given = weights.select(F.col("source").alias("named"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(given, sizes["source"].eqNullSafe(given["named"]), "left").drop("named")
        weighted = weighted.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = weighted.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(float(epochs)) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")
    return materialize(
        weighted.join(F.broadcast(total), F.lit(True)).select("source", F.when(F.col("all_weight") > 0, rate).otherwise(0.0).alias("rate"))
    )


def with_inverse(rated: DataFrame) -> DataFrame:
    """Adds parts and cdf: the Poisson distribution function of rate / parts at 0, 1, 2 ...

    The list ends where less than a double can tell is left.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    mean = rated.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    return mean.withColumn(
        "cdf",
        F.expr(
            """aggregate(sequence(1, cast(ceil(mean + 12 * sqrt(mean)) + 40 AS int)),
                named_struct('p', exp(-mean), 'c', array(exp(-mean))),
                (a, j) -> named_struct('p', a.p * mean / j, 'c', array_append(a.c, element_at(a.c, -1) + a.p * mean / j)),
                a -> a.c)"""
        ),
    ).drop("mean")


def draw(doc_id: str, seed: int, part: str) -> str:
    """SQL of a number in [0, 1) that depends on the seed, the id and the part: 52 bits of an MD5."""
    key = f"concat('{seed}', ':', coalesce(cast({doc_id} AS string), ''), ':', cast({part} AS string))"
    return f"(cast(conv(substring(md5({key}), 1, 13), 16, 10) AS double) / 4503599627370496D)"


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = EPOCHS,
    seed: int = SEED,
    copy: str | None = None,
) -> DataFrame:
    """docs with each row as many times as a Poisson draw says, dealt and ordered at random.

    weights: (source, weight), one row per source; a source without a weight does not appear.
    Without weights they are the source's size (bytes and one per document) to the power ``temperature``.  The
    mixture has ``epochs`` times the input's size in the mean.  The draw depends on the seed and the
    doc_id alone, so a repeated row is repeated as often as its twin, and all null ids draw
    alike; a null source is a source.  Null texts have size one.  Empty tables stay
    empty.  ``copy`` names a column for the number of the copy, from 1, in place of one of docs with that name; further
    columns pass unchanged, and texts of any length are only measured and moved.

    The table of rates has a row per source; it is broadcast only when counted to be small.
    Of a text only the size is looked at, so its length does not matter.
    """
    rated = small(with_inverse(rates(docs, weights, temperature, epochs)).select("source", "parts", "cdf"), 100_000)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(rated, F.col("row.source").eqNullSafe(rated["source"]))
    one = draw("row.doc_id", seed, "i")
    count = F.expr(
        f"""aggregate(transform(transform(sequence(1, parts), i -> {one}), u -> size(filter(cdf, c -> c <= u))),
            0, (a, n) -> a + n)"""
    )
    counted = joined.withColumn("n", count).where("n > 0")
    copies = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_number"))
    place = F.xxhash64(F.lit(seed), "row.doc_id", F.coalesce("row.text", F.lit("")), "copy_number")
    dealt = copies.withColumn("place", place).repartition("place").sortWithinPartitions("place")
    kept = [c for c in docs.columns if copy is None or c.lower() != copy.lower()]
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in kept], *([F.col("copy_number").alias(copy)] if copy else []))
