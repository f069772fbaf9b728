"""Secret scans through a trigram index whose queries are derived from the rules."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clubspark.llm.common import texts

#: Bytes of text indexed at once.
SLICE = 16 << 20

#: Strings that a part of a rule may stand for before it counts as anything.
MOST = 64


@dataclass(frozen=True)
class Rule:
    """kind, pattern (ASCII classes), and how long a group of the match must be; a shorter match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The rules that every scan has, in the order of their kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: Further public formats.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[^\s/@:]{3,64}@"),
)

# A query is True (anything), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def _all(queries: list[Query]) -> Query:
    flat = [q for q in queries if q is not True]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _any(queries: list[Query]) -> Query:
    return True if any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", queries)


def _of_strings(strings: list[str]) -> Query:
    """One of the strings must occur, lower-cased: all trigrams of one of them."""
    grams = [sorted({s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)}) for s in {x.lower() for x in strings}]
    return _any([_all(list(g)) for g in sorted(grams)])


def _strings(node: tuple) -> list[str] | None:
    """All strings that a single item stands for, if they are few."""
    kind, arg = node
    if kind is op.LITERAL:
        return [chr(arg)]
    if kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
        return [chr(v) for _, v in arg]
    if kind is op.SUBPATTERN:
        return _sequence_strings(list(arg[-1]))
    if kind is op.BRANCH:
        found = [_sequence_strings(list(branch)) for branch in arg[1]]
        return None if None in found else [s for f in found for s in f]
    if kind is op.MAX_REPEAT and arg[1] is not op.MAXREPEAT and arg[1] <= 8:
        one = _sequence_strings(list(arg[2]))
        out = [""] if arg[0] == 0 else []
        power = [""]
        for i in range(1, arg[1] + 1):
            power = None if one is None or power is None or len(power) * len(one) > MOST else [a + b for a in power for b in one]
            if power is None:
                return None
            out += power if i >= arg[0] else []
        return out
    return None


def _sequence_strings(items: list[tuple]) -> list[str] | None:
    out = [""]
    for item in items:
        found = _strings(item)
        if found is None or len(out) * len(found) > MOST:
            return None
        out = [a + b for a in out for b in found]
    return out


def _query(items: list[tuple]) -> Query:
    """What trigrams a sequence needs: runs of few strings, and what the items between them need."""
    queries: list[Query] = []
    run = [""]
    for item in items:
        found = _strings(item)
        if found is not None and len(run) * len(found) <= MOST:
            run = [a + b for a in run for b in found]
            continue
        queries.append(_of_strings(run))
        run = [""] if found is None else found
        kind, arg = item
        if found is None and kind is op.SUBPATTERN:
            queries.append(_query(list(arg[-1])))
        elif found is None and kind is op.BRANCH:
            queries.append(_any([_query(list(branch)) for branch in arg[1]]))
        elif found is None and kind is op.MAX_REPEAT and arg[0] > 0:
            queries.append(_query(list(arg[2])))
    return _all([*queries, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """A Boolean query of lower-cased trigrams that every text with a match satisfies; True if there is none."""
    return _query(list(_parser.parse(pattern, re.ASCII)))


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Index:
    """Posting lists of the wanted trigrams over a slice of texts."""

    def __init__(self, bodies: list[bytes], wanted: list[bytes]) -> None:
        self.n, k = len(bodies), max(1, len(wanted))
        data = np.frombuffer(b"\0".join(bodies).lower(), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(b) + 1 for b in bodies])
        slot = np.zeros(1 << 24, np.uint16)
        for i, gram in enumerate(wanted):
            slot[int.from_bytes(gram, "big")] = i + 1
        found = slot[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]] if len(data) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(found)
        pairs = np.unique((found[at].astype(np.int64) - 1) * self.n + np.searchsorted(ends, at, side="right"))
        self.postings = {g: pairs[(pairs // self.n) == i] % self.n for i, g in enumerate(wanted[:k])}

    def search(self, query: Query) -> np.ndarray:
        """Rows that satisfy the query: sorted lists are intersected and united."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        lists = sorted(map(self.search, query[1]), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


def find(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap, without those that are too short."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    compiled = [r.compiled() for r in rules]

    def slices(bodies: list[bytes]) -> Iterator[list[bytes]]:
        part, size = [], 0
        for body in bodies:
            part.append(body)
            size += len(body)
            if size >= SLICE:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list[tuple[int, int, int]]] = []
            for part in slices(batch.column(1).to_pylist()):
                index = Index(part, wanted)
                found: list[list[tuple[int, int, int]]] = [[] for _ in part]
                decoded: dict[int, str] = {}
                for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for row in index.search(query).tolist():
                        text = decoded.get(row)
                        if text is None:
                            text = decoded[row] = part[row].decode("utf-8", "replace")
                        found[row] += [(start, i, end) for start, end in find(rule, compiled[i], text)]
                spans += map(sorted, found)
            kinds = [[rules[i].kind for _, i, _ in f] for f in spans]
            columns = [[[s for s, _, _ in f] for f in spans], [[e for _, _, e in f] for f in spans]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.list_(pa.string()))] + [pa.array(c, pa.list_(pa.int64())) for c in columns],
                ["doc_id", "kinds", "starts", "ends"],
            )

    return run


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id and the secrets of each row, by start and then by rule: kinds, starts, ends (code points, end exclusive).

    The base rules are always scanned, ``more`` adds to them.  Each task indexes its texts by the trigrams that the rules
    need, in slices of bounded size; a rule is tried on the texts in its posting lists only,
    and on all if no trigram is mandatory.  Null and empty texts have no secrets.  Repeated rows give repeated
    rows; an empty table an empty result; further columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, kinds array<string>, starts array<long>, ends array<long>"
    return texts(docs).mapInArrow(_scan((*BASE, *more)), schema)


def span_digest(kinds: list[str], starts: list[int], ends: list[int]) -> str:
    """SHA-256 of the base spans as kind:start:end, comma-joined."""
    base = {r.kind for r in BASE}
    rows = zip(kinds, starts, ends, strict=True)
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in rows if k in base).encode()).hexdigest()
