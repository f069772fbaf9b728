"""The prefix tree of conversations, from adaptive radix trees over sorted ranges of their turn ids.

A turn's id has a fixed width: a hash of role and text, and the text's length, big-endian.  A
conversation is the string of its ids, cut into segments of bounded length; the segments after a common
beginning form a tree of their own.  All segments are sorted by tree, key and conversation and dealt out in ranges,
so that a beginning that a third of the conversations share lies in as many tasks as it needs.
Each task builds radix trees of its range and emits the nodes at turn-aligned depths.  Only nodes on
the way to a range's first or last key can lie in several ranges; these are added up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clubspark.llm.common import prepare, small
from clubspark.llm.radix import Node, insert
from clubspark.operators.ranking import position_in_key
from clubspark.session import materialize

#: Bytes of a turn's id: a hash, then the text's length in code points.
HASH, WIDTH = 16, 20

#: Turns in a segment of a conversation, and turns in a task.
SEGMENT, TASK_TURNS = 512, 50_000

#: Conversations whose first turns are shared: how many turns at most, and among how many ids.
HEADS, FAMILY = 6, 100

_ROOT = bytes(HASH)

# Whole nodes, nodes whose children are in another tree, nodes that other ranges may hold too.
_WHOLE, _LINKED, _BORDER = 0, 1, 2
_ROWS = (
    "id binary, tree binary, parent binary, depth long, conv_id long, n_convs long, length long, kids long, more boolean, "
    "saved long, leaves long, parent_conv_id long, state int, path array<binary>, first_end long, ends string, "
    "ends_sha256 string, tree_saved long, tree_leaves long"
)
_NAMES = [part.split(" ")[0] for part in _ROWS.split(", ")]
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 2 * (WIDTH - HASH), "0")))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, id): the turns of each conversation, numbered from 1 by turn, null turns first, ties by id."""
    c = conversations.where(F.col("conv_id").isNotNull())
    role, text = (F.coalesce(c[k], F.lit("")) for k in ("role", "text"))
    turns = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), turn_id(role, text).alias("id"))
    return position_in_key(turns, "conv_id", ["turn"], "id", "at").drop("turn")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, at, id): first h turns of the family's first conversation, then one's own after the first h.

    h is crc32(conv_id) modulo 6.  A row with at 0 and no id stands for each conversation, so that none is lost.
    """
    turns = materialize(turns)
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS))
    heads = materialize(heads.select(F.col("conv_id").alias("family"), F.col("at").alias("head_at"), F.col("id").alias("head")))
    known = small(materialize(heads.groupBy("family").agg(F.max("head_at").alias("known"))))
    every = turns.select("conv_id").distinct().withColumns({"family": family, "h": h})
    borrowed = every.join(small(heads), "family").where(F.col("head_at") <= F.col("h"))
    own = turns.withColumns({"family": family, "h": h}).where(F.col("at") > F.col("h")).join(known, "family", "left")
    at = F.col("at") - F.col("h") + F.least(F.col("h"), F.coalesce("known", F.lit(0)))
    return (
        every.select("conv_id", F.lit(0).alias("at"), F.lit(None).cast("binary").alias("id"))
        .union(borrowed.select("conv_id", "head_at", "head"))
        .union(own.select("conv_id", at, "id"))
    )


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, level, key, tree, next, more) of each piece of at most ``segment`` turns of a conversation.

    tree: hash of all turns before the piece; next: that with this piece, if it is full; more: whether another follows.
    """
    level = F.floor(F.greatest(F.col("at") - 1, F.lit(0)) / segment)
    ids = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id")))
    key = F.unhex(F.array_join(F.transform(F.array_sort(ids), lambda x: F.hex(x["id"])), ""))
    pieces = materialize(turns.groupBy("conv_id", level.alias("level")).agg(key.alias("key")))
    full = pieces.where(F.length("key") == segment * WIDTH)
    halves = [F.xxhash64(F.lit(half), F.col("level"), F.md5("key")) for half in (1, 2)]
    so_far = Window.partitionBy("conv_id").orderBy("level")
    chain = full.select("conv_id", "level", *[F.bit_xor(x).over(so_far).alias(f"x{i}") for i, x in enumerate(halves)])
    name = F.unhex(F.concat(*[F.lpad(F.hex(f"x{i}"), 16, "0") for i in range(2)]))
    chain = small(materialize(chain.select(F.col("conv_id").alias("c"), F.col("level").alias("l"), name.alias("next"))))
    later = small(materialize(pieces.where("level > 0").select(F.col("conv_id").alias("d"), (F.col("level") - 1).alias("m"))))
    before = chain.select(F.col("c").alias("b"), (F.col("l") + 1).alias("k"), F.col("next").alias("tree"))
    joined = pieces.join(chain, (pieces["conv_id"] == chain["c"]) & (pieces["level"] == chain["l"]), "left")
    joined = joined.join(before, (joined["conv_id"] == before["b"]) & (joined["level"] == before["k"]), "left")
    joined = joined.join(later, (joined["conv_id"] == later["d"]) & (joined["level"] == later["m"]), "left")
    tree = F.coalesce("tree", F.lit(_ROOT))
    return joined.select("conv_id", "level", "key", tree.alias("tree"), "next", F.col("d").isNotNull().alias("more"))


class _Sums:
    """What a part of a radix tree passes up: conversations, least id, and whole nodes below."""

    __slots__ = ("kids", "least", "leaves", "n", "pending", "saved")

    def __init__(self) -> None:
        self.n = self.kids = self.saved = self.leaves = 0
        self.least: int | None = None
        self.pending: list[int] = []

    def add(self, other: _Sums) -> None:
        self.n += other.n
        self.kids += other.kids
        self.saved += other.saved
        self.leaves += other.leaves
        self.pending += other.pending
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least


class _Visit:
    """A radix node being traversed: where its bytes start, which border keys lead here, its turn-aligned depths."""

    __slots__ = ("kids", "marks", "node", "on", "start", "sums")

    def __init__(self, node: Node, start: int, on: tuple[bytes, ...]) -> None:
        self.node, self.start = node, start
        self.on = tuple(key for key in on if key.startswith(node.path, start))
        self.kids = node.kids.ordered() if node.kids is not None else iter(())
        self.marks: list[tuple[int, bytes, bool]] = []
        self.sums = _Sums()


class Trie:
    """One tree of a range: its radix tree, the turns before it, and the rows of its nodes."""

    def __init__(self, tree: bytes, base: int) -> None:
        self.tree, self.base, self.root = tree, base, Node()
        self.begun = [b""]  # bytes of the turn that is not whole yet, along the way down

    def rows(self, borders: tuple[bytes, ...], rows: list[dict]) -> None:
        """Nodes at turn-aligned depths, children first; ``borders``: the range's first or last key, if in this tree."""
        ids = [self.tree]
        top = _Visit(self.root, 0, borders)
        top.marks = [(0, self.tree, True)]
        stack = [top]
        while stack:
            visit = stack[-1]
            kid = next(visit.kids, None)
            if kid is None:
                stack.pop()
                self._leave(visit, ids, rows)
                if stack:
                    stack[-1].sums.add(visit.sums)
            else:
                stack.append(self._enter(kid, visit, ids))

    def _enter(self, node: Node, above: _Visit, ids: list[bytes]) -> _Visit:
        start = above.start + len(above.node.path)
        visit = _Visit(node, start, above.on)
        prefix = self.begun[-1] if start % WIDTH else b""
        begin, end = start - start % WIDTH, start + len(node.path)
        whole = prefix + node.path
        for depth in range(begin + WIDTH, end + 1, WIDTH):
            turn = whole[depth - WIDTH - begin : depth - begin]
            following = node.values[0][1] if depth == end and node.values else None
            name = following or hashlib.blake2b(ids[-1] + turn, digest_size=HASH).digest()
            border = any(key.startswith(node.path[: depth - start], start) for key in above.on)
            visit.marks.append((int.from_bytes(turn[HASH:], "big"), name, border))
            ids.append(name)
        self.begun.append(whole[(end - end % WIDTH) - begin :])
        return visit

    def _leave(self, visit: _Visit, ids: list[bytes], rows: list[dict]) -> None:
        sums, values = visit.sums, visit.node.values
        self.begun.pop()
        if values:
            mine = _Sums()
            mine.n, mine.least = len(values), values[0][0]
            mine.saved, mine.leaves = sum(v[3] for v in values), sum(v[4] for v in values)
            sums.add(mine)
        more = any(v[2] for v in values)
        for length, name, border in reversed(visit.marks):
            depth = self.base + len(ids) - 1
            row = dict.fromkeys(_NAMES)
            row |= {"id": name, "depth": depth, "length": length, "more": more, "kids": sums.kids, "tree": self.tree}
            if depth == self.base and self.base:
                row |= {"tree": None, "state": _LINKED, "n_convs": 0, "saved": 0, "leaves": 0}
                row |= {"tree_saved": sums.saved, "tree_leaves": sums.leaves, "more": False}
                rows.append(row)
                return
            if not border:
                sums.leaves += not sums.kids and not more
                sums.saved += (sums.n - 1) * length
            row |= {"state": _BORDER if border else _LINKED if more else _WHOLE, "conv_id": sums.least, "n_convs": sums.n}
            row |= {"saved": sums.saved, "leaves": sums.leaves, "parent": ids[-2] if len(ids) > 1 else None}
            ending = [v[0] for v in values if not v[2]]
            if ending:
                text = ",".join(map(str, ending))
                row |= {"first_end": ending[0], "ends": text} if border else {"ends_sha256": hashlib.sha256(text.encode()).hexdigest()}
            if border:
                row["path"] = ids[bool(self.base) :]
                sums.kids = sums.saved = sums.leaves = 0
            else:
                for place in sums.pending:
                    rows[place]["parent_conv_id"] = sums.least
                sums.kids = 1
            sums.pending = [len(rows)]
            rows.append(row)
            ids.pop()
            values, more = [], False

def _build(segment: int):
    """Radix trees of a sorted range of pieces; yields their nodes."""
    schema = to_arrow_schema(T.StructType.fromDDL(_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, values, first, last, done = None, None, b"", None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "level", "key", "conv_id", "next", "more", "saved", "leaves")]
            for tree, level, key, conv, following, more, saved, leaves in zip(*columns, strict=True):
                if trie is None or trie.tree != tree:
                    if trie is not None:
                        trie.rows((first,) if not done else (), rows := [])
                        done.append(True)
                        yield from _batches(rows, schema)
                    else:
                        first = key
                    trie, last = Trie(tree, level * segment), None
                if key != last:
                    values, last = insert(trie.root, key), key
                values.append((conv, following, more, saved, leaves))
        if trie is not None:
            trie.rows((first, last) if not done else (last,), rows := [])
            yield from _batches(rows, schema)

    return run


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_pylist(rows[at : at + 2000], schema)


def _nodes(pieces: DataFrame, segment: int, tasks: int) -> DataFrame:
    order = ["tree", "key", "conv_id"]
    ranges = pieces.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return materialize(ranges.mapInArrow(_build(segment), _ROWS))


def _joined(rows: DataFrame) -> DataFrame:
    """Border and linked nodes, one row each, with the whole nodes below added up."""
    parts = rows.where(F.col("state") > _WHOLE).groupBy("id")
    one = materialize(
        parts.agg(
            *[F.max(c).alias(c) for c in ("tree", "parent", "depth", "length", "more", "parent_conv_id", "state", "ends_sha256", "path")],
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "kids", "saved", "leaves")],
        )
    )
    border = one.where(F.col("state") == _BORDER)
    kids = border.groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("border_kids"))
    with_kids = one.join(kids, one["id"] == kids["p"], "left").withColumn("kids", F.col("kids") + F.coalesce("border_kids", F.lit(0)))
    leaf = ((F.col("kids") == 0) & ~F.col("more")).cast("long")
    is_border = F.col("state") == _BORDER
    own = with_kids.withColumn("saved", F.when(is_border, F.col("saved") + (F.col("n_convs") - 1) * F.col("length")).otherwise(F.col("saved")))
    return materialize(own.withColumn("leaves", F.when(is_border, F.col("leaves") + leaf).otherwise(F.col("leaves"))).drop("p", "border_kids"))


def _beyond(pieces: DataFrame, rows: DataFrame) -> DataFrame:
    """What the trees after a piece hold: added once, to the least conversation's pieces before them."""
    linked = rows.where(F.col("tree_saved").isNotNull()).select(F.col("id").alias("tree"), "tree_saved", "tree_leaves")
    border = _joined(rows).where((F.col("state") == _BORDER) & (F.col("tree") != F.lit(_ROOT))).select("tree", "saved", "leaves")
    totals = linked.union(border).groupBy("tree").agg(F.sum("tree_saved").alias("saved"), F.sum("tree_leaves").alias("leaves"))
    members = pieces.where("level > 0").groupBy("tree").agg(F.min("conv_id").alias("conv_id"), F.first("level").alias("level"))
    held = members.join(totals, "tree").drop("tree")
    every = pieces.where("level > 0 OR more").select("conv_id", "level").join(held, ["conv_id", "level"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in ("saved", "leaves")]
    return every.select("conv_id", "level", *sums)


def _end_hashes(rows: DataFrame) -> DataFrame:
    """The hash over all ids that end at a border node: its parts, in order, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"e": [name], "hash": [digest.hexdigest()]})

        for batch in batches:
            for this, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if this != name:
                    if digest is not None:
                        yield row()
                    name, digest = this, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if digest is not None:
            yield row()

    parts = rows.where((F.col("state") == _BORDER) & F.col("ends").isNotNull())
    parts = parts.select("id", "ends", "first_end").repartition("id").sortWithinPartitions("id", "first_end")
    return parts.select("id", "ends").mapInArrow(run, "e binary, hash string")


def prefix_tree(turns: DataFrame, segment: int = SEGMENT, task_turns: int = TASK_TURNS) -> DataFrame:
    """One row per different beginning of the sequences in ``turns`` (conv_id, at, id), at 0 standing for each sequence.

    conv_id (least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  Equal turns are told by 128-bit hashes.  An empty table gives no node.
    """
    pieces = materialize(segments(turns, segment))
    size = pieces.agg(F.count(F.lit(1)), F.sum(F.length("key")), F.max("level")).first()
    tasks = max(1, -(-(size[0] + (size[1] or 0) // WIDTH) // task_turns))
    plain = pieces.withColumns({"saved": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")})
    rows = _nodes(plain, segment, tasks)
    if size[2]:
        beyond = materialize(_beyond(pieces, rows)).withColumnsRenamed({"conv_id": "c", "level": "l"})
        same = (pieces["conv_id"] == beyond["c"]) & (pieces["level"] == beyond["l"])
        more = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("saved", "leaves")}
        rows = _nodes(pieces.join(small(beyond), same, "left").drop("c", "l").withColumns(more), segment, tasks)
    one = _joined(rows)
    below = one.where(F.col("state") == _BORDER).select(F.explode("path").alias("a"), "saved", "leaves")
    below = below.groupBy("a").agg(F.sum("saved").alias("all_saved"), F.sum("leaves").alias("all_leaves"))
    ends = _end_hashes(rows)
    one = one.join(below, one["id"] == below["a"], "left").join(ends, one["id"] == ends["e"], "left")
    one = materialize(
        one.withColumns(
            {"saved": F.coalesce("all_saved", "saved"), "leaves": F.coalesce("all_leaves", "leaves"), "ends_sha256": F.coalesce("ends_sha256", "hash")}
        )
    )
    wanted = ["depth", "conv_id", "n_convs", "kids", "leaves", "saved", "ends_sha256", "parent", "parent_conv_id"]
    every = rows.where(F.col("state") == _WHOLE).select(*wanted).union(one.select(*wanted))
    above = small(one.select(F.col("id").alias("above"), F.col("conv_id").alias("above_conv_id")))
    needs = F.when(F.col("parent_conv_id").isNull(), F.col("parent"))
    every = every.join(above, needs == F.col("above"), "left")
    return every.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "above_conv_id").alias("parent_conv_id"),
        "n_convs",
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def rebuilt_tree(conversations: DataFrame, segment: int = SEGMENT, task_turns: int = TASK_TURNS) -> DataFrame:
    """``prefix_tree`` of the conversations as ``rebuilt``.

    Null roles and texts are empty; rows of one turn are ordered by their id; repeated rows are turns of their own;
    rows without a conv_id belong to no conversation.  Texts of any length are hashed whole in the scan and go no
    further; further columns are not looked at.
    """
    prepare(conversations.sparkSession)
    return prefix_tree(rebuilt(numbered(conversations)), segment, task_turns)
