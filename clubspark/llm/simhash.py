"""Near duplicates by SimHash with one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubspark.llm.common import sha, texts, without
from clubspark.llm.components import components
from clubspark.session import materialize

SHINGLE = 3
DISTANCE = 3

#: Members of a variant that one task compares; larger variants are cut further.
BLOCK = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes as a signed 64-bit number; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    line, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.array(
        [digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)], ">u8"
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(b, shingle) for b in batch.column("text").to_pylist()], pa.int64())
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [fps], [*rest, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sha, fp): id, hash of the text and fingerprint as a signed number, per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts(docs, sha(docs["text"]).alias("sha"))
    return rows.mapInArrow(_prints(shingle), f"doc_id {kind}, sha binary, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """Each half of the bits with each of its bits left out: 64 keys for a fingerprint.

    Of three differing bits one half holds one at most, so a linked pair shares a key.
    """
    spread = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    half = F.expr("CASE WHEN p < 32 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END")
    key = half.bitwiseAND(F.expr("~shiftleft(1L, p % 32)")).bitwiseOR(F.expr("shiftleft(CAST(p AS BIGINT), 32)"))
    return spread.select(key.alias("k1"), F.lit(0).cast("long").alias("k2"), "fp")


def _quarters(rows: DataFrame) -> DataFrame:
    """Within a variant, the other half is cut again: two quarters with one bit left out."""
    spread = rows.select("k1", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p"))
    other = "(CASE WHEN shiftright(k1, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END)"
    part = f"(shiftright({other}, CASE WHEN p < 16 THEN 0 ELSE 16 END) & 65535 & ~shiftleft(1L, p % 16))"
    return spread.select("k1", F.expr(f"shiftleft(CAST(p AS BIGINT), 16) | {part}").alias("k2"), "fp")


def _eighths(rows: DataFrame) -> DataFrame:
    """And the last quarter: two eighths with one bit left out, which leaves 11 free bits of 64."""
    spread = rows.select("k1", "k2", "fp", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    other = "(CASE WHEN shiftright(k1, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END)"
    quarter = f"(shiftright({other}, CASE WHEN shiftright(k2, 16) < 16 THEN 16 ELSE 0 END) & 65535)"
    part = f"(shiftright({quarter}, CASE WHEN p < 8 THEN 0 ELSE 8 END) & 255 & ~shiftleft(1L, p % 8))"
    key = F.expr(f"shiftleft(k2, 12) | shiftleft(CAST(p AS BIGINT), 8) | {part}")
    return spread.select("k1", key.alias("k2"), "fp")


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the bits of the absolute value


def linked_roots(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each of a block's fingerprints, the place of the first one of its component in the block."""
    n = len(fps)
    near = np.empty((n, n), bool)
    for at in range(0, n, 128):  # no large matrix of numbers
        near[at : at + 128] = bits_apart(fps[at : at + 128, None], fps[None, :]) <= distance
    root = np.arange(n, dtype=np.int32)
    while True:
        low = np.empty_like(root)
        for at in range(0, n, 128):
            low[at : at + 128] = np.where(near[at : at + 128], root[None, :], n).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


_EDGE = "big boolean, k1 long, k2 long, u long, v long"
_NAMES = ["big", "k1", "k2", "u", "v"]


def _compare(distance: int, block: int):
    """Over rows sorted by key: spanning edges of each variant; the rows of large variants go on, marked big."""

    def out(big: bool, k1, k2, u, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(u), big))] + [pa.array(x.astype(np.int64)) for x in (k1, k2, u, v)], _NAMES
        )

    def resolve(k1, k2, fp) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        sizes = np.diff(new, append=len(fp))
        first = new[sizes == 2]
        first = first[bits_apart(fp[first], fp[first + 1]) <= distance]
        us, vs = [fp[first]], [fp[first + 1]]
        for at, size in zip(new[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            part = fp[at : at + size]
            if size > block:
                yield out(True, k1[at : at + size], k2[at : at + size], part, part)
                continue
            root = linked_roots(part, distance)
            apart = root != np.arange(size)
            us.append(part[apart])
            vs.append(part[root[apart]])
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            u, v = np.unique(np.stack([u, v]), axis=1)
            zero = np.zeros(len(u), np.int64)
            yield out(False, zero, zero, u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        passing = None  # the key of a large variant whose first rows have been passed on
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(rows[0]):
                continue
            if passing is not None:
                same = (rows[0] == passing[0]) & (rows[1] == passing[1])
                n = int(same.sum())
                if n:
                    yield out(True, rows[0][:n], rows[1][:n], rows[2][:n], rows[2][:n])
                    rows = [x[n:] for x in rows]
                    if not len(rows[0]):
                        continue
                passing = None
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            last = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])
            if last:
                yield from resolve(*[x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > block:
                yield out(True, *held, held[2])
                passing, held = (held[0][0], held[1][0]), [np.zeros(0, np.int64)] * 3
        if len(held[0]):
            yield from resolve(*held)

    return run


def _level(keyed: DataFrame, distance: int, block: int) -> DataFrame:
    dealt = keyed.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return materialize(dealt.mapInArrow(_compare(distance, block), _EDGE))


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join all distinct fingerprints linked by chains of pairs within the distance.

    Halves with one bit left out are the index; what shares a key is verified.  A variant of more
    than ``block`` members is indexed again by quarters and then by eighths of its other
    half, after which 2,048 different members are the most there can be, so no task
    compares more than a block and no pair is lost.  Only spanning edges are given out, not all pairs.
    """
    if not 0 <= distance <= 3 or block < 2:
        raise ValueError("halves with one wildcard serve distances up to 3")
    one = _level(_variants(fps), distance, block)
    found, large = one.where("NOT big").select("u", "v"), one.where("big")
    for cut, limit in ((_quarters, block), (_eighths, BLOCK)):
        if large.isEmpty():
            break
        level = _level(cut(large.select("k1", "k2", F.col("u").alias("fp"))), distance, max(block, limit))
        found, large = found.union(level.where("NOT big").select("u", "v")), level.where("big")
    return found.distinct()


def _classed(docs: DataFrame, shingle: int, distance: int, block: int) -> DataFrame:
    """fingerprints() with each row's component: root (a fingerprint) and component_id."""
    rows = materialize(fingerprints(docs, shingle))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("fp"), distance, block)).withColumnRenamed("node", "fp")
    rooted = materialize(nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    named = materialize(rooted.select("fp", "root").join(lows, "root"))
    return rows.join(named, "fp")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK
) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that chains of links reach.  Equal fingerprints are
    one node, so copies cost nothing.  Null and empty texts have fingerprint zero and are linked like
    others; null ids are passed over by the minimum, so a component of null ids alone has a null component_id.
    Repeated rows give repeated rows; an empty table an empty result; further columns are not looked at.
    A text of any length gives all its shingles, repeats included.
    """
    return _classed(docs, shingle, distance, block).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK
) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then of the smallest text hash."""
    rows = materialize(_classed(docs, shingle, distance, block))
    lowest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    keepers = rows.where(lowest).groupBy("root").agg(F.min("sha").alias("keep_sha"))
    rows = materialize(rows.join(keepers, "root").withColumn("kept", lowest & (F.col("sha") == F.col("keep_sha"))))
    repeats = rows.where("kept").groupBy("root").count().where("count > 1")
    return without(docs, materialize(rows.where("NOT kept").select("doc_id", "sha")), not repeats.isEmpty())
