"""CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clubspark import schemas
from clubspark.session import materialize


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row; without a schema the types are inferred by an extra pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_scorecards(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    return read_csv(spark, path, None if infer else schemas.SCORECARDS)


def with_scorecard_id(cards: DataFrame, start: int = 0) -> DataFrame:
    """Number scorecards from ``start`` in file order, with gaps and without a shuffle.

    The numbers follow the file splits, so write the result to a table once and
    read it from there.
    """
    return cards.withColumn("scorecard_id", F.monotonically_increasing_id() + start)


def with_row_number(rows: DataFrame) -> DataFrame:
    """Rows of files with ``path`` and ``row_number``, from 0 in the order of the file however the file was split.

    A row's number is its place in its split plus the rows of the file's splits before.  The
    rows are written once, so that the places hold; there is one count per split.
    """
    source = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    placed = materialize(rows.select("*", source.alias("_split"), F.monotonically_increasing_id().alias("_at")))
    splits = placed.groupBy("_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    preceding = Window.partitionBy("_split.path").orderBy("_split.block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.withColumn("_before", F.coalesce(F.sum("_n").over(preceding), F.lit(0))).drop("_n")
    numbered = placed.join(before, "_split").withColumn("row_number", F.col("_at") - F.col("_first") + F.col("_before"))
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_split.path").alias("path"), "row_number")


def read_weather(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    return read_csv(spark, path, None if infer else schemas.WEATHER_RAW)


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Files matching a glob on any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in (found or []))


def discover(
    spark: SparkSession,
    folder: str,
    scorecards: str = "scorecards*.csv",
    weather: str = "weather*.csv",
    first_only: bool = False,
) -> tuple[list[str] | None, list[str] | None]:
    """Input files per family; (None, None) unless both families are present."""
    found = [_matches(spark, f"{folder.rstrip('/')}/{pattern}") for pattern in (scorecards, weather)]
    if not all(found):
        return None, None
    cards, days = ([files[0]] if first_only else files for files in found)
    return cards, days


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)
