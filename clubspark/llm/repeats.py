"""Repeated passages: longest-previous-factor arrays over the suffixes that can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubspark.llm.common import small, texts
from clubspark.session import materialize

#: Bytes of a passage.
LENGTH = 100

#: Runs of one anchor that are sorted together; windows of more frequent anchors are exchanged one by one.
BLOCK = 256

#: Rows and suffixes that a task holds at once.
HELD, SORTED = 65_536, 400_000

_PIECE = 1 << 18  # bytes of a long text at once; buffers stay below the 20 bits of a place
_LOW = np.uint64((1 << 20) - 1)

# Two independent polynomial hashes modulo 2**64: random values of the bytes, odd bases and their inverses.
_RANDOM = np.random.default_rng(20).integers(0, 1 << 63, (2, 257), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES = _RANDOM[:, :256]
_BASES = [int(b) for b in _RANDOM[:, 256]]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                row = np.full(1 << 20, b, np.uint64)
                row[0] = 1
                both.append(np.multiply.accumulate(row))
            _POWERS.append((both[0], both[1]))
    return _POWERS[which]


def _prefix(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[which][data] * _powers(which)[0][: len(data)], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
    """Hash of each data[start:stop]."""
    return _mix((prefix[stop] - prefix[start]) * _powers(which)[1][start])


def _gram(length: int) -> int:
    return max(1, length * 32 // 100)


def _buffers(bodies: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Buffers of texts or pieces of long ones, with rows (text, place in it, place in the buffer, windows)."""
    parts, rows, size = [], [], 0
    for i, body in enumerate(bodies):
        for at in range(0, len(body) - length + 1, _PIECE):
            part = body[at : at + _PIECE + length - 1]
            parts.append(part)
            rows.append((i, at, size, len(part) - length + 1))
            size += len(part)
            if size >= 1 << 19:
                yield b"".join(parts), np.array(rows)
                parts, rows, size = [], [], 0
    if rows:
        yield b"".join(parts), np.array(rows)


def runs(bodies: list[bytes], length: int = LENGTH) -> dict[str, np.ndarray]:
    """All windows of the texts, as runs of neighbours with the same anchor.

    The anchor of a window is its leftmost least-hashed gram, so equal windows have
    equal anchors at the same place in them.  Returns text, anchor (its hash), key (hash of the run's
    bytes and shape), and at: the anchor's place and how far before it the first and last window begin.
    """
    k = _gram(length)
    w = length - k + 1
    out: dict[str, list[np.ndarray]] = {"text": [], "anchor": [], "key": [], "at": []}
    for buffer, rows in _buffers(bodies, length):
        data = np.frombuffer(buffer, np.uint8)
        one = _prefix(data, 0)
        n = len(data) - k + 1
        least = (_mix((one[k:] - one[:n]) * _powers(0)[1][:n]) & ~_LOW) | np.arange(n, dtype=np.uint64)
        size = 1
        while size < w:
            step = min(size, w - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        part = np.repeat(np.arange(len(rows)), rows[:, 3])
        start = np.arange(len(part)) - np.repeat(np.cumsum(rows[:, 3]) - rows[:, 3], rows[:, 3]) + rows[part, 2]
        gram = (least[start] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (gram[1:] != gram[:-1])]))
        end = np.append(new[1:], len(part)) - 1
        first, last, b, part = start[new], start[end], gram[new], part[new]
        shape = ((b - first) * 128 + (b - last)).astype(np.uint64)
        two = _prefix(data, 1)
        out["text"].append(rows[part, 0])
        out["anchor"].append(_hashes(one, b, b + k, 0).view(np.int64))
        out["key"].append(_mix(_hashes(two, first, last + length, 1) + shape).view(np.int64))
        out["at"].append(((b - rows[part, 2] + rows[part, 1]) << 14) | shape.astype(np.int64))
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}


def _span(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    b = at >> 14
    return b - ((at >> 7) & 127), b - (at & 127) + length


_COLUMNS = ["span", "anchor", "key", "rid", "at"]
_ROWS = "span boolean, anchor long, key long, rid long, at long"


def _out(span: bool, anchor, key, rid, at) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(rid), span))] + [pa.array(np.asarray(x, np.int64)) for x in (anchor, key, rid, at)]
    return pa.RecordBatch.from_arrays(arrays, _COLUMNS)


def _spans(rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Removed stretches: key is the start and at the stop; spread by document."""
    return _out(True, _mix(rid.astype(np.uint64)).view(np.int64), start, rid, stop)


def _firsts(anchor, key, rid, at) -> tuple[np.ndarray, np.ndarray]:
    """Order by all four, and in it a mark of the first row of each anchor and key."""
    order = np.lexsort((at, rid, key, anchor))
    a, k = anchor[order], key[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (k[1:] != k[:-1])]) if len(a) else np.zeros(0, bool)


def _index(length: int):
    """Runs of a task's texts; those that repeat an earlier run of the same batch are removed at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            found = runs(batch.column(1).to_pylist(), length)
            rid = rids[found["text"]]
            order, first = _firsts(found["anchor"], found["key"], rid, found["at"])
            keep, rest = order[first], order[~first]
            yield _out(False, found["anchor"][keep], found["key"][keep], rid[keep], found["at"][keep])
            if len(rest):
                yield _spans(rid[rest], *_span(found["at"][rest], length))

    return run


def _gather(batches: Iterator[pa.RecordBatch], rows: int = HELD) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield _columns(held)
            held, n = [], 0
    if n:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [c.to_numpy() for c in pa.Table.from_batches(held).combine_chunks().columns]


def _reduce(length: int, windows: bool):
    """Over rows sorted by anchor, key and place: all but the first of a key repeat it and are removed.

    The first ones of anchors with several keys go on: parts of them may repeat.
    Only one row is held back at the end of a batch.  With windows, keys are single windows and nothing goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor, key, whether it has several keys, and the first row if that has not gone on
        for span, anchor, key, rid, at in _gather(batches):
            if span.any():
                yield _out(True, anchor[span], key[span], rid[span], at[span])
                anchor, key, rid, at = (x[~span] for x in (anchor, key, rid, at))
            if not len(rid):
                continue
            same_anchor = np.concatenate([[last is not None and last[0] == anchor[0]], anchor[1:] == anchor[:-1]])
            same_key = same_anchor & np.concatenate([[last is not None and last[1] == key[0]], key[1:] == key[:-1]])
            if same_key.any():
                start, stop = _span(at[same_key], length)
                yield _spans(rid[same_key], start, stop)
            group = np.cumsum(~same_anchor)  # 0: goes on from before
            keys = np.bincount(group[~same_key], minlength=group[-1] + 1)
            several = keys > 1
            goes_on = last is not None and last[0] == anchor[0]
            if goes_on:
                several[0] = last[2] or keys[0] > 0
                if several[0] and last[3] is not None:
                    yield _out(False, *[[x] for x in last[3]])
                    last = (*last[:3], None)
            go = ~same_key & several[group]
            if go.any() and not windows:
                yield _out(False, anchor[go], key[go], rid[go], at[go])
            pending = None
            if not several[group[-1]]:
                mine = np.flatnonzero((group == group[-1]) & ~same_key)
                if len(mine):
                    i = mine[0]
                    pending = (anchor[i], key[i], rid[i], at[i])
                elif goes_on:
                    pending = last[3]
            last = (anchor[-1], key[-1], bool(several[group[-1]]), None if windows else pending)

    return run


def previous_factors(words: list[np.ndarray], rid: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Marks the suffixes whose longest previous factor has the full length.

    words: the first bytes of each suffix as big-endian numbers.  Suffixes are sorted; where neighbours
    agree in full they form a piece, in which a suffix has a previous or a next
    smaller position, and so an earlier match of the full length, unless it is the smallest of the piece.
    """
    order = np.lexsort((place, rid, *reversed(words)))
    full = np.ones(len(order) - 1, bool)
    for word in words:
        full &= word[order[1:]] == word[order[:-1]]
    piece = np.concatenate([[0], np.cumsum(~full)])
    r, p = rid[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], ~full]))
    smallest = np.minimum.reduceat(r, starts)[piece]
    at_smallest = np.where(r == smallest, p, np.iinfo(np.int64).max)
    lowest = np.minimum.reduceat(at_smallest, starts)[piece]
    marked = np.zeros(len(order), bool)
    marked[order] = (r != smallest) | (p != lowest)
    return marked


def _suffixes(contexts: list[bytes], rid: np.ndarray, at: np.ndarray, length: int):
    """Of runs with their bytes: sorting words, row and place of every window."""
    sizes = np.array([len(c) for c in contexts]) - length + 1
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8).astype(np.uint64)
    wide = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        wide |= data[j : len(wide) + j] << np.uint64(8 * (7 - j))
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = inside + np.repeat(np.cumsum(sizes + length - 1) - (sizes + length - 1), sizes)
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    return [wide[start + o] for o in offsets], rid[row], _span(at, length)[0][row] + inside


def _factor_spans(contexts, rid, at, length) -> Iterator[pa.RecordBatch]:
    words, owner, place = _suffixes(contexts, rid, at, length)
    again = previous_factors(words, owner, place)
    if again.any():
        yield _spans(owner[again], place[again], place[again] + length)


def _factors(length: int):
    """Over runs with their bytes, sorted by anchor: suffixes of whole anchors are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= SORTED and held[-1][0] != row[0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) - length + 1
        if held:
            yield from solve(held)

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, rid, at, contexts = zip(*rows, strict=True)
        yield from _factor_spans(contexts, np.array(rid, np.int64), np.array(at, np.int64), length)

    return run


_CONTEXT = "hot boolean, anchor long, key long, rid long, at long, bytes binary"


def _contexts(length: int):
    """Bytes of the runs of a document that may repeat in part; of frequent anchors, hashes of the single windows.

    Windows that repeat inside a batch are found here, so that the exchange has each once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            flat = [(r["rid"], e["at"], e["anchor"], e["hot"], r["text"]) for r in rows for e in r["edges"]]
            rid, at, anchor = (np.array([f[i] for f in flat], np.int64) for i in range(3))
            start, stop = _span(at, length)
            bodies = [f[4][a:b] for f, a, b in zip(flat, start.tolist(), stop.tolist(), strict=True)]
            hot = np.array([f[3] for f in flat], bool)
            cold = np.flatnonzero(~hot)
            if len(cold):
                yield out(False, anchor[cold], anchor[cold], rid[cold], at[cold], [bodies[i] for i in cold])
            for part in np.array_split(np.flatnonzero(hot), max(1, int(hot.sum()) * 70 // SORTED)):
                if len(part):
                    yield windows([bodies[i] for i in part], rid[part], at[part])

    def out(hot, anchor, key, rid, at, bodies) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(rid), hot))] + [pa.array(x) for x in (anchor, key, rid, at)] + [pa.array(bodies, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["hot", "anchor", "key", "rid", "at", "bytes"])

    def windows(bodies: list[bytes], rid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        hashes = []
        for which in (0, 1):
            parts = []
            for body in bodies:
                prefix = _prefix(np.frombuffer(body, np.uint8), which)
                n = np.arange(len(body) - length + 1)
                parts.append(_hashes(prefix, n, n + length, which))
            hashes.append(np.concatenate(parts).view(np.int64))
        _, owner, place = _suffixes(bodies, rid, at, length)
        return out(True, *hashes, owner, place << 14, [b""] * len(owner))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over stretches sorted by document and start: their unions, one row per document."""
    held = [np.zeros(0, np.int64)] * 3

    def close(rid, start, stop) -> pa.RecordBatch:
        reach = np.empty_like(stop)
        new = np.concatenate([[True], rid[1:] != rid[:-1]])
        bounds = np.append(np.flatnonzero(new), len(rid))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            reach[a:b] = np.maximum.accumulate(stop[a:b])
        begin = new | np.concatenate([[True], start[1:] > reach[:-1]])
        at = np.flatnonzero(begin)
        ends = reach[np.append(at[1:], len(rid)) - 1]
        owner = rid[at]
        cut = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner))
        offsets = pa.array(cut, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (start[at], ends)]
        return pa.RecordBatch.from_arrays([pa.array(owner[cut[:-1]]), *lists], ["rid", "starts", "stops"])

    for columns in _gather(batches):
        columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield close(*[c[:cut] for c in columns])
        held = [c[cut:] for c in columns]
    if len(held[0]):
        yield close(*held)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, rid and text: rid is the doc_id where that is a unique whole number, else the place in the
    order of id (null last) and text."""
    rows = texts(docs)
    whole = docs.schema["doc_id"].dataType.simpleString() in {"tinyint", "smallint", "int", "bigint"}
    if whole:
        ids = docs.groupBy("doc_id").count()
        if ids.where("doc_id IS NULL OR count > 1").isEmpty():
            return rows.withColumn("rid", F.col("doc_id").cast("long"))
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return materialize(ordered.withColumn("rid", F.monotonically_increasing_id()))


def repeated_spans(rows: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Stored frame (rid, starts, stops): the stretches of each text that repeat an earlier passage.

    1. Every window of a text belongs to a run of one anchor.  Runs meet by anchor; whole runs that
       repeat are settled there by two hashes, which leaves one of each.
    2. What is left of anchors with different runs is at the edges of repeated passages.  The suffixes that begin
       in those runs are sorted by anchor, and their longest previous factors mark what repeats.
    3. Anchors with more than ``block`` such runs (a line that very many texts hold) exchange their
       single windows instead, reduced to one of each per batch before they are dealt out.
    """
    indexed = rows.select("rid", "text").mapInArrow(_index(length), _ROWS)
    dealt = indexed.repartition("anchor").sortWithinPartitions("anchor", "key", "rid", "at")
    first = materialize(dealt.mapInArrow(_reduce(length, False), _ROWS))
    edges = first.where("NOT span").select("anchor", "rid", "at")
    frequent = materialize(edges.groupBy("anchor").count().where(F.col("count") > block).select("anchor", F.lit(True).alias("hot")))
    flagged = edges.join(small(frequent), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_text = materialize(flagged.groupBy("rid").agg(F.collect_list(F.struct("anchor", "at", "hot")).alias("edges")))
    opened = materialize(rows.select("rid", "text").join(per_text, "rid").mapInArrow(_contexts(length), _CONTEXT))
    cold = opened.where("NOT hot").select("anchor", "rid", "at", "bytes")
    second = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_factors(length), _ROWS)
    hot = opened.where("hot").select(F.lit(False).alias("span"), "anchor", "key", "rid", "at")
    hot = hot.repartition("anchor", "key").sortWithinPartitions("anchor", "key", "rid", "at")
    third = hot.mapInArrow(_reduce(length, True), _ROWS)
    spans = first.where("span").union(second.where("span")).union(third.where("span"))
    spans = spans.select("rid", F.col("key").alias("start"), F.col("at").alias("stop"))
    by_text = spans.repartition("rid").sortWithinPartitions("rid", "start")
    return materialize(by_text.mapInArrow(_merged, "rid long, starts array<long>, stops array<long>"))


def _cut(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, counts, kept = [], [], [], []
            for text, starts, stops in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                starts, stops = starts or [], stops or []
                left = b"".join([text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True)])
                sizes.append(len(text))
                gone.append(len(text) - len(left))
                counts.append(len(starts))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
            numbers = [pa.array(x, pa.int64()) for x in (sizes, gone, counts)]
            last = pa.array(kept, pa.string() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, last], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes), or kept_sha256 with digest.

    A byte goes if a passage of ``length`` bytes covers it that begins earlier too: in a
    text of a smaller doc_id, or before in the same one.  Passages never cross texts and are judged on the
    texts as they come.  Null and short texts lose nothing.  Where ids repeat or are null, rows count in the order of
    id (null last) and text, so a repeated row loses all that its twin has.  An empty table gives an empty
    result; further columns are not looked at.  length: 40 to 127 bytes.
    """
    if not 40 <= length <= 127:
        raise ValueError("passages have 40 to 127 bytes")
    rows = numbered(docs)
    spans = small(repeated_spans(rows, length, block), 200_000)
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, "rid", "left").select("doc_id", "text", "starts", "stops")
    found = joined.mapInArrow(
        _cut(digest), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"
    )
    return found.withColumnRenamed("kept", "kept_sha256") if digest else found
