"""Helpers shared by the operators on documents."""

from __future__ import annotations

import shutil
import tempfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a hinted broadcast may hold at most; larger sides are shuffled.
BROADCAST_ROWS = 500_000

#: Documents in one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the executors: once per session, through Spark's own file server."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if not any(f.endswith("/clubspark.zip") for f in context.listFiles):
        package = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/clubspark", "zip", package.parent, package.name)
        context.addPyFile(made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text as UTF-8 bytes, a null text as none; the package is sent along for the workers."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a stored frame only if it is counted to be small; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sha(text: Column | str = "text") -> Column:
    """The text's SHA-256 as 32 bytes; a null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids are in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0))


def fold_of(doc_id: object, folds: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def rows_of(batch: pa.RecordBatch) -> tuple[pa.Array, list[bytes]]:
    return batch.column(0), batch.column(1).to_pylist()


def each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        if batch.num_rows:
            yield rows_of(batch)


def without(docs: DataFrame, losers: DataFrame, repeated: bool) -> DataFrame:
    """Documents except those named by (doc_id, sha) in a stored frame.

    repeated: rows that agree in id and text occur among those kept; one of each stays.
    """
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), sha(docs["text"]).alias("sha"))
    gone = small(losers.select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha")))
    same = (marked["sha"] == gone["gone_sha"]) & marked["row.doc_id"].eqNullSafe(gone["gone_id"])
    kept = marked.join(gone, same, "left_anti")
    if repeated:
        kept = kept.withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "sha"])
    return kept.select("row.*")
