"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubspark.llm.common import prepare, sha, small, without
from clubspark.session import materialize

#: Fingerprints that one owner receives on average.
OWNED = 500_000

#: Fingerprint bits beyond the logarithm of the number of documents: one text in
#: two to this power becomes a suspect by chance, and is cleared by its bytes.
SPARE_BITS = 10


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct whole numbers as Golomb-Rice coded gaps: unary quotients, then k-bit remainders."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    tail = (n * k + 7) // 8 * 8
    unary, rest = bits[: len(bits) - tail], bits[len(bits) - tail :][: n * k].reshape(n, k)
    quotients = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    gaps = (quotients << k) + (rest.astype(np.int64) << np.arange(k)).sum(axis=1)
    return np.cumsum(gaps + 1) - 1


_SENT = "owner long, sender long, n long, k long, blob binary, repeated binary"


def _send(bits: int, owner_bits: int):
    """Per task and owner, the sorted distinct fingerprints, coded, and a bitmap of those the task has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        found, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        low = bits - owner_bits
        owners = found >> low
        sender = TaskContext.get().partitionId()
        for owner in np.unique(owners):
            mine = owners == owner
            values = found[mine] & ((1 << low) - 1)
            k = max(0, int(math.log2(max(1.0, 0.69 * (1 << low) / len(values)))))
            row = [owner, sender, len(values), k, golomb_encode(values, k), np.packbits(counts[mine] > 1).tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, [pa.int64()] * 4 + [pa.binary()] * 2, strict=True)],
                ["owner", "sender", "n", "k", "blob", "repeated"],
            )

    return run


def _answer(group: pa.Table) -> pa.Table:
    """For each sender, the bitmap of its fingerprints that it or another one has again."""
    rows = group.to_pylist()
    lists = [golomb_decode(r["blob"], r["n"], r["k"]) for r in rows]
    found, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = found[counts > 1]
    bitmaps = []
    for r, values in zip(rows, lists, strict=True):
        own = np.unpackbits(np.frombuffer(r["repeated"], np.uint8))[: r["n"]].astype(bool)
        bitmaps.append(np.packbits(own | np.isin(values, shared, assume_unique=True)).tobytes())
    return pa.table(
        {
            "owner": group.column("owner"),
            "sender": group.column("sender"),
            "bitmap": pa.array(bitmaps, pa.binary()),
        }
    )


def _pick(bits: int, owner_bits: int):
    """Senders read the bitmaps: the fingerprints that are suspect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = golomb_decode(r["blob"], r["n"], r["k"])
                marked = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))[: r["n"]].astype(bool)
                full = values[marked] | (r["owner"] << (bits - owner_bits))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64())], ["fp"])

    return run


def suspects(prints: DataFrame, n: int) -> DataFrame:
    """Stored frame (fp) of the fingerprints that occur more than once.

    prints: (fp) below two to the power ``bits``; see :func:`fingerprint_bits`.
    """
    bits, owner_bits = fingerprint_bits(n)
    sent = materialize(prints.select("fp").mapInArrow(_send(bits, owner_bits), _SENT))
    replies = (
        sent.select("owner", "sender", "n", "k", "blob", "repeated")
        .groupBy("owner")
        .applyInArrow(_answer, "owner long, sender long, bitmap binary")
    )
    marked = sent.drop("repeated").join(replies, ["owner", "sender"]).mapInArrow(_pick(bits, owner_bits), "fp long")
    return materialize(marked.distinct())


def fingerprint_bits(n: int) -> tuple[int, int]:
    """Bits of a fingerprint, and how many of them name its owner, for n documents."""
    return min(62, max(1, n).bit_length() + SPARE_BITS), max(2, (n // OWNED).bit_length())


def groups(docs: DataFrame) -> DataFrame:
    """Stored frame (sha, keep_id, group_size): the texts that occur in more than one row.

    Fingerprints are exchanged in coded form; only texts whose fingerprint occurs again are
    shuffled, reduced in the scan stage to one row per text and task, and grouped
    by their bytes.  keep_id is the largest doc_id, null only if all are null.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    n = docs.count()
    bits, _ = fingerprint_bits(n)
    fp = F.shiftrightunsigned(F.xxhash64(text), 64 - bits)
    doubtful = small(suspects(docs.select(fp.alias("fp")), n))
    again = docs.select("doc_id", text.alias("text"), fp.alias("fp")).join(doubtful, "fp", "left_semi")
    same = again.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return materialize(same.where("group_size > 1").select(sha().alias("sha"), "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, empty texts are equal to each other.  Rows that agree in id
    and text are all marked kept if theirs is the largest id (:func:`deduplicate` leaves one
    of them).  A null id is kept only where the whole group has null ids.  An empty
    table gives an empty result; further columns are not looked at.  Texts of any length are hashed and
    compared whole; only those whose fingerprint occurs again are shuffled.
    """
    rows = docs.select("doc_id", sha(docs["text"]).alias("sha"))
    joined = rows.join(groups(docs), "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row, of the largest doc_id, for each text; columns as they are."""
    rows = materialize(docs.select("doc_id", sha(docs["text"]).alias("sha")).join(groups(docs), "sha"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    losers = materialize(rows.where(~kept).select("doc_id", "sha"))
    repeats = rows.where(kept).groupBy("sha").count().where("count > 1")
    return without(docs, losers, not repeats.isEmpty())
