"""The cheapest repair of a conversation's structure, by dynamic programming over its rows as a stream.

A repaired conversation's roles read, by their initials, s? (u a)+ or nothing.  Rows are kept, get
another role, are deleted, or empty rows are put between them.  The cost of the best rest from each of
the four places in that pattern is carried through the rows from the last to the first; each row leaves one
byte that says what to do with it from each place.  Blocks of these bytes are written with the rows as they fill
up, so that no conversation is held whole; a second pass, from the first row to the last, follows them and
hashes the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clubspark.llm.common import prepare
from clubspark.session import materialize

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1

#: Rows whose back-pointers are held at once.
BLOCK = 65_536

#: White space of the tables, as trimmed.
SPACE = " \t\n\x0b\x0c\r"

# Places in the pattern: nothing yet, after the system row, after a user row, after an assistant row.
_AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_TURN = (2, 2, 3, 2)
_LETTERS = "DIKR"
_INITIALS = ("s", "u", "a", "?", "")
_SOUND, _CUT, _GONE = 0, 1, 2
_END = (0, 2 * INSERT, INSERT, 0)


@cache
def step(rest: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int, int]:
    """One row before a rest: costs of the new rest from each place (least taken off), that least, and the choices, two bits a place.

    code: place of the role's initial in _INITIALS, times three, plus the row's state.  Of equally cheap
    choices the letter that comes first is taken.
    """
    initial, state = _INITIALS[code // 3], code % 3
    cost, choice = [0] * 4, [0] * 4
    for place in range(4):
        options = [(rest[place] + DELETE, "D")]
        if state != _GONE:
            extra = CUT * (state == _CUT)
            if initial == "" or initial in _AFTER[place]:
                options.append((rest[_AFTER[place].get(initial, place)] + extra, "K"))
            options.append((rest[_TURN[place]] + REROLE + extra, "R"))
        cost[place], choice[place] = min(options)
    for _ in range(2):
        for place in range(4):
            other = cost[_TURN[place]] + INSERT
            if (other, "I") < (cost[place], choice[place]):
                cost[place], choice[place] = other, "I"
    least = min(cost)
    packed = sum(_LETTERS.index(c) << 2 * place for place, c in enumerate(choice))
    return tuple(c - least for c in cost), least, packed


def walk(place: int, packed: int, code: int) -> tuple[str, int]:
    """The letters spent on one row from a place, empty rows before it included, and the place after it."""
    letters = ""
    while True:
        letter = _LETTERS[packed >> 2 * place & 3]
        letters += letter
        if letter == "I":
            place = _TURN[place]
            continue
        if letter == "K":
            place = _AFTER[place].get(_INITIALS[code // 3], place)
        elif letter == "R":
            place = _TURN[place]
        return letters, place


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage; nulls of role and text are one space.

    A row is damaged by crc32(conv_id:turn) modulo 20: 0 drops it, 1 empties its text, 2 takes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes its role user.  A null id or turn is one space there.
    """
    c = conversations
    key = F.concat_ws(":", *[F.coalesce(c[k].cast("string"), F.lit(" ")) for k in ("conv_id", "turn")])
    rows = c.select(
        c["conv_id"],
        c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"], F.lit(" ")).alias("role"),
        F.coalesce(c["text"], F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """Rows without their texts: conv_id, turn, mark (a hash of role and text), initial, blank and cut."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    return rows.select(
        "conv_id",
        "turn",
        mark(),
        F.substring("role", 1, 1).alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )


def mark() -> Column:
    """What tells rows of one turn apart, and puts them in an order."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("mark")


class Rest:
    """What is carried through one conversation, from its last row to its first."""

    def __init__(self, conv: object) -> None:
        self.conv, self.rest, self.cost, self.next = conv, _END, 0, None
        self.blank = self.repeated = self.cut = self.illegal = self.turns = 0
        self.top = self.bottom = None
        self.number = 0
        self.bytes, self.codes = bytearray(), bytearray()

    def take(self, turn: int | None, initial: str, blank: bool, cut: bool, copy: bool) -> None:
        fault = "blank" if blank else "repeated" if copy else "cut" if cut else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        state = _SOUND if fault is None else _CUT if fault == "cut" else _GONE
        code = 3 * (_INITIALS.index(initial) if initial in _INITIALS else 3) + state
        if self.next is not None:
            self.illegal += initial + self.next not in ("su", "ua", "au")
        self.next = initial
        if turn is not None and turn != self.bottom:
            self.turns += 1
            self.top = turn if self.top is None else self.top
            self.bottom = turn
        self.rest, least, packed = step(self.rest, code)
        self.cost += least
        self.bytes.append(packed)
        self.codes.append(code)

    def block(self, turn: int | None, mark: bytes, last: bool) -> dict:
        """The bytes since the last block, in the order of the rows; the first block of a conversation has its sums."""
        out = {"conv_id": self.conv, "turn": turn, "mark": mark, "packed": bytes(self.bytes[::-1]), "codes": bytes(self.codes[::-1])}
        out["number"] = self.number
        self.number += 1
        self.bytes.clear()
        self.codes.clear()
        if last:
            gaps = 0 if self.top is None else self.top - self.bottom + 1 - self.turns
            out |= {"gaps": gaps, "blank": self.blank, "duplicate": self.repeated, "truncated": self.cut}
            out |= {"illegal": self.illegal, "cost": self.cost + self.rest[0]}
        return out


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _plan(block: int, schema: pa.Schema):
    """Streams rows from each conversation's last to its first into blocks of back-pointers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Rest | None = None
        where: tuple = (None, b"")
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "mark", "initial", "blank", "cut", "copy")]
            for conv, turn, mark_, initial, blank, cut, copy in zip(*columns, strict=True):
                if open_ is None or conv != open_.conv:
                    if open_ is not None:
                        out.append(open_.block(*where, True))
                    open_ = Rest(conv)
                elif len(open_.bytes) >= block:
                    out.append(open_.block(*where, False))
                open_.take(turn, initial, blank, cut, copy)
                where = (turn, mark_)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([open_.block(*where, True)], schema)

    return run


class Repair:
    """Follows the blocks of one conversation along its rows."""

    def __init__(self, conv: object) -> None:
        self.conv, self.place, self.sums = conv, 0, None
        self.blocks: list[tuple[bytes, bytes]] = []
        self.at, self.audit, self.first, self.sha = 0, [], True, hashlib.sha256()

    def write(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "replace"))
        self.first = False

    def add(self, packed: bytes, codes: bytes, sums: dict) -> None:
        self.blocks.append((packed, codes))
        if sums["cost"] is not None:
            self.sums = sums

    def turn(self) -> str:
        """The role that the pattern wants now; it is passed over."""
        self.place = _TURN[self.place]
        return "user" if self.place == 2 else "assistant"

    def take(self, role: str, text: str) -> None:
        packed, codes = self.blocks[0]
        letters, after = walk(self.place, packed[self.at], codes[self.at])
        for _ in letters[:-1]:
            self.write(self.turn(), "")
        if letters[-1] == "R":
            self.write(self.turn(), text)
        elif letters[-1] == "K":
            self.write(role, text)
        self.place = after
        self.audit.append(letters)
        self.at += 1
        if self.at == len(packed):
            del self.blocks[0]
            self.at = 0

    def end(self) -> dict:
        while self.place in (1, 2):
            self.write(self.turn(), "")
            self.audit.append("I")
        return {"conv_id": self.conv, **self.sums, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _follow(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Repair | None = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "packed", "codes", *_SUMS)]
            for conv, role, text, packed, codes, *sums in zip(*columns, strict=True):
                if open_ is None or conv != open_.conv:
                    if open_ is not None:
                        out.append(open_.end())
                    open_ = Repair(conv)
                if packed is not None:
                    open_.add(packed, codes, dict(zip(_SUMS, sums, strict=True)))
                else:
                    open_.take(role, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([open_.end()], schema)

    return run


def _copies(rows: DataFrame) -> DataFrame:
    """Marks each row whose role and text stand earlier in its conversation, or in an equal row counted before it.

    Equal rows of one turn are interchangeable: they are counted, and all but one of the earliest are copies.
    The rows are dealt out by conversation once, which the counts, the window and the later sort all use.
    """
    groups = rows.repartition("conv_id").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
    earlier = Window.partitionBy("conv_id", "mark").orderBy(F.col("turn").asc_nulls_first())
    groups = groups.withColumn("again", F.row_number().over(earlier) > 1)
    copies = F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: F.col("again") | (i > 1))
    return groups.select(*rows.columns, F.explode(copies).alias("copy"))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation with rows.

    rows: conv_id, turn, role, text.  Rows of a conversation are read by turn, null turns first, equal turns by a
    hash of role and text.  A role's first character is its initial; an empty role has none, so that such a row may
    stay anywhere.  Null ids are one conversation; nulls of role and text count as one space; texts of any length
    are hashed as they pass.  A conversation's rows meet in one task as a sorted stream, of which a block of
    bytes and an audit of about one letter a row are held.  An empty table gives an empty result; further columns
    are not looked at.
    """
    prepare(rows.sparkSession)
    conv = rows.schema["conv_id"].dataType
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    sums = ", ".join(f"{s} long" for s in _SUMS)
    plan_schema = f"conv_id {conv.simpleString()}, turn long, mark binary, packed binary, codes binary, number long, {sums}"
    down = _copies(_coded(rows)).sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.col("mark").desc(), F.col("copy").desc())
    blocks = materialize(down.mapInArrow(_plan(block, _arrow(plan_schema)), plan_schema))
    texts = rows.select("conv_id", "turn", mark(), "role", "text")
    both = texts.unionByName(blocks, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "mark", F.col("number").desc_nulls_last())
    out_schema = f"conv_id {conv.simpleString()}, {sums}, audit string, repaired_sha256 string"
    return both.mapInArrow(_follow(_arrow(out_schema)), out_schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def repair_damaged(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``repair`` of the rows after ``damage``, with a row for every conversation; without rows all is zero or empty."""
    rows = damage(conversations)
    done = repair(rows, block).withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct()
    joined = every.join(done, every["conv_id"].eqNullSafe(done["c"]), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(F.col(s), F.lit(0).cast("long")).alias(s) for s in _SUMS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
