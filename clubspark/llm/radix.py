"""An adaptive radix tree over byte keys: path compression, and child tables that grow with their number."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

#: Children that the four layouts hold.
FEW, SOME, MANY, ALL = 4, 16, 48, 256


class Sorted:
    """Up to 4 or up to 16 children: their first bytes in order, and the children beside them."""

    __slots__ = ("kids", "room", "signs")

    def __init__(self, room: int = FEW, signs: bytearray | None = None, kids: list | None = None) -> None:
        self.room, self.signs, self.kids = room, signs or bytearray(), kids or []

    def get(self, sign: int) -> Node | None:
        at = self.signs.find(sign)
        return None if at < 0 else self.kids[at]

    def put(self, sign: int, kid: Node) -> Sorted | Indexed:
        """With the child, in this layout or the next larger one."""
        at = bisect_left(self.signs, sign)
        if at < len(self.signs) and self.signs[at] == sign:
            self.kids[at] = kid
            return self
        if len(self.kids) < self.room:
            self.signs.insert(at, sign)
            self.kids.insert(at, kid)
            return self
        larger = Sorted(SOME, self.signs, self.kids) if self.room == FEW else Indexed(self)
        return larger.put(sign, kid)

    def ordered(self) -> Iterator[Node]:
        return iter(self.kids)


class Indexed:
    """Up to 48 children: a table from each byte to a slot."""

    __slots__ = ("kids", "slot")

    def __init__(self, smaller: Sorted) -> None:
        self.slot, self.kids = bytearray(ALL), list(smaller.kids)
        for at, sign in enumerate(smaller.signs):
            self.slot[sign] = at + 1

    def get(self, sign: int) -> Node | None:
        at = self.slot[sign]
        return self.kids[at - 1] if at else None

    def put(self, sign: int, kid: Node) -> Indexed | Direct:
        if self.slot[sign]:
            self.kids[self.slot[sign] - 1] = kid
            return self
        if len(self.kids) == MANY:
            return Direct(self).put(sign, kid)
        self.kids.append(kid)
        self.slot[sign] = len(self.kids)
        return self

    def ordered(self) -> Iterator[Node]:
        return (self.kids[at - 1] for at in self.slot if at)


class Direct:
    """A child for every byte."""

    __slots__ = ("kids",)

    def __init__(self, smaller: Indexed) -> None:
        self.kids = [smaller.get(sign) for sign in range(ALL)]

    def get(self, sign: int) -> Node | None:
        return self.kids[sign]

    def put(self, sign: int, kid: Node) -> Direct:
        self.kids[sign] = kid
        return self

    def ordered(self) -> Iterator[Node]:
        return (kid for kid in self.kids if kid is not None)


class Node:
    """The bytes that lead here from the node above, the children, and the values of the key that ends here."""

    __slots__ = ("kids", "path", "values")

    def __init__(self, path: bytes = b"") -> None:
        self.path = path
        self.kids: Sorted | Indexed | Direct | None = None
        self.values: list = []

    def adopt(self, kid: Node) -> None:
        self.kids = (self.kids or Sorted()).put(kid.path[0], kid)


def _shared(a: bytes, b: bytes) -> int:
    """How many first bytes are the same: halved, as slices compare fast."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def insert(root: Node, key: bytes) -> list:
    """The values of a key, which is added if it is new."""
    node, at = root, 0
    while at < len(key):
        kid = node.kids.get(key[at]) if node.kids is not None else None
        if kid is None:
            kid = Node(key[at:])
            node.adopt(kid)
            return kid.values
        if not key.startswith(kid.path, at):
            same = _shared(kid.path, key[at:])
            fork = Node(kid.path[:same])
            kid.path = kid.path[same:]
            fork.adopt(kid)
            node.adopt(fork)
            kid = fork
        at += len(kid.path)
        node = kid
    return node.values
