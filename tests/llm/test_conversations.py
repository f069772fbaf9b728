import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clubspark.llm import conversation_repair, conversation_trie, radix
from clubspark.llm.common import prepare, table
from clubspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, n long, tree binary"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows, a long conversation, shared beginnings, clashing names."""
    rows = [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(40)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t < c % 9 else f"{c} {t}?") for c in range(101, 130) for t in range(c % 11)]
    rows += [(7, None, None, None), (7, None, "user", ""), (7, 3, "user", "x" * 100_000), (7, 3, "tool", "y"), (7, 3, "tool", "y")]
    rows += [(8, 1, "", "no role."), (8, 2, "", " \t\n\x0b\x0c\r "), (None, 1, "user", "nobody"), (None, None, None, None), (-250, 5, "assistant", "é\x00.")]
    prepare(spark)
    return spark.createDataFrame([(*r, 1, b"") for r in rows], SCHEMA).repartition(4)


# --- prefix tree ----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=400))
def test_radix_tree_holds_all_keys(keys):
    root = radix.Node()
    for i, key in enumerate(keys):
        radix.insert(root, key).append(i)
    found, stack = {}, [(root, b"")]
    while stack:
        node, above = stack.pop()
        here = above + node.path
        if node.values:
            found[here] = node.values
        kids = list(node.kids.ordered()) if node.kids is not None else []
        assert [k.path[0] for k in kids] == sorted({k.path[0] for k in kids})
        assert node is root or node.values or len(kids) > 1  # paths are compressed
        stack += [(k, here) for k in kids]
    expected = defaultdict(list)
    for i, key in enumerate(keys):
        expected[key].append(i)
    assert found == expected


def test_radix_layouts_grow():
    root, kinds = radix.Node(), []
    for i in range(256):
        radix.insert(root, bytes([i * 37 % 256, 1])).append(i)
        kinds.append((type(root.kids).__name__, getattr(root.kids, "room", None)))
    assert [kinds[i] for i in (3, 4, 15, 16, 47, 48, 255)] == [
        ("Sorted", 4), ("Sorted", 16), ("Sorted", 16), ("Indexed", None), ("Indexed", None), ("Direct", None), ("Direct", None)
    ]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), len(text)


def slow_tree(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            groups[conv].append((turn is not None, turn or 0, digest(role or "", text or "")))
    for g in groups.values():
        g.sort()
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(groups):
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(g[2] for g in groups.get(family, [])[:h]) + tuple(g[2] for g in groups[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * p[-1][1] if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def tree_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def plain_rows(df):
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("segment,task_turns", [(512, 50_000), (3, 25)])
def test_tree_of_odd_rows(odd, segment, task_turns):
    assert tree_rows(conversation_trie.rebuilt_tree(odd, segment, task_turns)) == slow_tree(plain_rows(odd))


def test_tree_cut_into_many_ranges_and_segments(spark):
    df = table(spark, FOLDER, "conversations")
    assert tree_rows(conversation_trie.rebuilt_tree(df, 2, 20)) == slow_tree(plain_rows(df))


def test_tree_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"{t}") for c in range(1, 300) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert tree_rows(conversation_trie.rebuilt_tree(df, 512, 50)) == slow_tree(rows)
    assert conversation_trie.rebuilt_tree(df.limit(0)).count() == 0


# --- repair ---------------------------------------------------------------------------------


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, gaps=2):
    """All edits with few insertions, judged by the pattern itself: the least (cost, audit) and what it gives."""
    states, best = faults(rows), None
    inserts = [list(product(("user", "assistant"), repeat=n)) for n in range(gaps + 1)]
    slots = [i for options in inserts for i in options]
    choices = [["D"] if s in ("blank", "duplicate") else ["D", "K", "user", "assistant"] for s in states]
    for picked in product(*choices):
        for put in product(slots, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for i in range(len(rows) + 1):
                out += [(r, "") for r in put[i]]
                audit += "I" * len(put[i])
                cost += 2 * len(put[i])
                if i < len(rows):
                    audit += picked[i][0].upper() if picked[i] in "DK" else "R"
                    cost += 3 if picked[i] == "D" else (states[i] == "truncated") + 2 * (picked[i] != "K")
                    out += [] if picked[i] == "D" else [(rows[i][0] if picked[i] == "K" else picked[i], rows[i][1])]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def streamed(rows, block=2):
    rest, seen, blocks = conversation_repair.Rest(1), set(), []
    copies = [(r in seen, seen.add(r))[0] for r in rows]
    for i in range(len(rows) - 1, -1, -1):
        role, text = rows[i]
        body = text.rstrip(conversation_repair.SPACE)
        if len(rest.bytes) >= block:
            blocks.append(rest.block(None, b"", False))
        rest.take(i, role[:1], not body, body[-1:] not in (".", "!", "?"), copies[i])
    blocks.append(rest.block(None, b"", True))
    repair = conversation_repair.Repair(1)
    for b in reversed(blocks):
        repair.add(b["packed"], b["codes"], {s: b.get(s) for s in conversation_repair._SUMS})
    for role, text in rows:
        repair.take(role, text)
    return repair.end()


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b!", "open", " ", "c?"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=3))
def test_repair_against_every_edit(rows):
    cost, audit, text = every_repair(rows)
    got = streamed(rows)
    assert (got["cost"], got["audit"]) == (cost, audit)
    assert got["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    marks = faults(rows)
    assert [got[k] for k in ("blank", "duplicate", "truncated")] == [marks.count(k) for k in ("blank", "duplicate", "truncated")]


def slow_repair(rows):
    """(cost, audit, rows) by plain recursion from the first row; rows: (turn, role, text) in order."""
    states = faults([r[1:] for r in rows])
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    known = {}

    def go(i, place, put):
        if (i, place, put) not in known:
            want = "a" if place == "u" else "u"
            name = {"u": "user", "a": "assistant"}[want]
            options = [(0, "", ())] if i == len(rows) and place in ("", "a") else []
            if put < 2:
                c, a, o = go(i, want, put + 1)
                options.append((c + 2, "I" + a, ((name, ""), o)))
            if i < len(rows):
                _, role, text = rows[i]
                c, a, o = go(i + 1, place, 0)
                options.append((c + 3, "D" + a, o))
                extra = states[i] == "truncated"
                if states[i] not in ("blank", "duplicate"):
                    if role[:1] in after[place]:
                        c, a, o = go(i + 1, role[:1] or place, 0)
                        options.append((c + extra, "K" + a, ((role, text), o)))
                    c, a, o = go(i + 1, want, 0)
                    options.append((c + extra + 2, "R" + a, ((name, text), o)))
            known[i, place, put] = min(options, key=lambda x: x[:2]) if options else (10**9, "", ())
        return known[i, place, put]

    cost, audit, chain = go(0, "", 0)
    out = []
    while chain:
        out.append(f"{chain[0][0]}:{chain[0][1]}")
        chain = chain[1]
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [states.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def slow_damaged(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        groups[conv] += [(turn is not None, turn or 0, digest(role, text), (turn, role, text))] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: slow_repair([x[3] for x in sorted(g)]) for c, g in groups.items()}


def repaired(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == names
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [conversation_repair.BLOCK, 1, 3])
def test_repair_of_odd_rows(odd, block):
    assert repaired(conversation_repair.repair_damaged(odd, block)) == slow_damaged(plain_rows(odd))


def test_repair_query(spark):
    got = repaired(QUERIES["op13_conversation_repair"](spark, FOLDER))
    assert got == slow_damaged(plain_rows(table(spark, FOLDER, "conversations")))


def test_repair_of_nothing(odd, spark):
    assert conversation_repair.repair_damaged(odd.limit(0)).count() == 0
    dropped = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, dropped, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert repaired(conversation_repair.repair_damaged(df)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
