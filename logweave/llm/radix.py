"""An adaptive radix tree over byte keys of fixed-width turn ids."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator


class Kids:
    """The children of a tree node by their next byte. The layout grows with their number: up to 4 or 16 bytes in order beside their
    nodes, up to 48 nodes behind an index of all bytes, then a slot for every byte."""

    __slots__ = ("size", "keys", "slots")

    def __init__(self) -> None:
        self.size, self.keys, self.slots = 4, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.size == 256:
            return self.slots[byte]
        if self.size == 48:
            at = self.keys[byte]
            return self.slots[at - 1] if at else None
        at = bisect_left(self.keys, byte)
        return self.slots[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, node: Node) -> None:
        """Set the node of a byte; a full layout is replaced by the next larger one first."""
        if self.find(byte) is None and self.size < 256 and len(self.slots) == self.size:
            self._grow()
        if self.size == 256:
            self.slots[byte] = node
        elif self.size == 48:
            if self.keys[byte]:
                self.slots[self.keys[byte] - 1] = node
            else:
                self.slots.append(node)
                self.keys[byte] = len(self.slots)
        else:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.slots[at] = node
            else:
                insort(self.keys, byte)
                self.slots.insert(at, node)

    def _grow(self) -> None:
        pairs = list(self.items())
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            self.size, self.keys = 48, bytearray(256)
            for at, (byte, _) in enumerate(pairs):
                self.keys[byte] = at + 1
        else:
            self.size, self.keys, self.slots = 256, bytearray(), [None] * 256
            for byte, node in pairs:
                self.slots[byte] = node

    def items(self) -> Iterator[tuple[int, Node]]:
        """Bytes and nodes in order of the bytes."""
        if self.size == 256:
            yield from ((b, n) for b, n in enumerate(self.slots) if n is not None)
        elif self.size == 48:
            yield from ((b, self.slots[at - 1]) for b, at in enumerate(self.keys) if at)
        else:
            yield from zip(self.keys, self.slots)


class Node:
    """``path``: the bytes that all keys below share after the byte that led here; ``ends`` and ``goes``: what ends here, or goes on beyond the key."""

    __slots__ = ("path", "kids", "ends", "goes")

    def __init__(self, path: bytes = b"") -> None:
        self.path, self.kids, self.ends, self.goes = path, Kids(), [], []


def insert(root: Node, key: bytes, value: int, more: bool = False) -> None:
    """Add ``value`` at ``key``, to ``goes`` if there is more behind the key than the key tells."""
    node, at = root, 0
    while True:
        path = node.path
        if not key.startswith(path, at):
            same = 0
            while at + same < len(key) and key[at + same] == path[same]:
                same += 1
            below = Node(path[same + 1 :])
            below.kids, below.ends, below.goes = node.kids, node.ends, node.goes
            node.path, node.kids, node.ends, node.goes = path[:same], Kids(), [], []
            node.kids.put(path[same], below)
        at += len(node.path)
        if at == len(key):
            (node.goes if more else node.ends).append(value)
            return
        child = node.kids.find(key[at])
        if child is None:
            child = Node(key[at + 1 :])
            node.kids.put(key[at], child)
            (child.goes if more else child.ends).append(value)
            return
        node, at = child, at + 1


def bottom_up(root: Node) -> Iterator[tuple[Node, int, bytes]]:
    """Every node after all nodes below it, with the number of key bytes before its path and all of its bytes."""
    stack = [(root, 0, root.path, False)]
    while stack:
        node, start, whole, seen = stack.pop()
        if seen:
            yield node, start, whole
            continue
        stack.append((node, start, whole, True))
        for byte, child in node.kids.items():
            stack.append((child, len(whole), whole + bytes((byte,)) + child.path, False))
