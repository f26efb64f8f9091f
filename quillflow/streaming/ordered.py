"""Ordered sets of numbers in a keyed map state, which itself has no order.

A set is a tree of 64-bit maps of which numbers, or subtrees, there are: finding the least number, adding
and removing read at most LEVELS entries, whatever the set's size. Entries that a batch has read are kept
until flush, which writes those that changed; of more than KEPT none stay.
"""

from __future__ import annotations

NODES = "kind int, of bigint, level int, prefix bigint"
_WIDTH, _ALL = 6, (1 << 64) - 1
#: Levels of six bits that hold 64.
LEVELS = 11
#: Entries kept before they are flushed.
KEPT = 4096
#: Signed numbers in order are unsigned ones from here.
_ZERO = 1 << 63


class OrderedSets:
    """Sets of signed 64-bit numbers, each named by (kind, of)."""

    def __init__(self, state: object):
        self.state = state
        self.nodes: dict[tuple[int, int, int, int], int] = {}
        self.changed: set[tuple[int, int, int, int]] = set()
        self.reads = 0

    def _bits(self, node: tuple[int, int, int, int]) -> int:
        if node not in self.nodes:
            if len(self.nodes) >= KEPT:
                self.flush()
                self.nodes.clear()
            found = self.state.getValue(node)
            self.nodes[node] = found[0] & _ALL if found else 0
            self.reads += 1
        return self.nodes[node]

    def _put(self, node: tuple[int, int, int, int], bits: int) -> None:
        self.nodes[node] = bits
        self.changed.add(node)

    def add(self, kind: int, of: int, number: int) -> bool:
        """Whether the number is new."""
        u = number + _ZERO
        for level in range(LEVELS):
            node = (kind, of, level, u >> _WIDTH * (level + 1))
            bits, bit = self._bits(node), 1 << (u >> _WIDTH * level & 63)
            if bits & bit:
                return level > 0
            self._put(node, bits | bit)
            if bits:  # the way up to here is there already
                return True
        return True

    def remove(self, kind: int, of: int, number: int) -> bool:
        """Whether the number was there."""
        u = number + _ZERO
        for level in range(LEVELS):
            node = (kind, of, level, u >> _WIDTH * (level + 1))
            bits, bit = self._bits(node), 1 << (u >> _WIDTH * level & 63)
            if not bits & bit:
                return False
            self._put(node, bits ^ bit)
            if bits != bit:
                return True
        return True

    def least(self, kind: int, of: int) -> int | None:
        prefix = 0
        for level in reversed(range(LEVELS)):
            bits = self._bits((kind, of, level, prefix))
            if not bits:
                return None
            prefix = prefix << _WIDTH | (bits & -bits).bit_length() - 1
        return prefix - _ZERO

    def flush(self) -> None:
        for node in sorted(self.changed):
            bits = self.nodes[node]
            if bits:
                self.state.updateValue(node, (bits - (1 << 64) if bits >> 63 else bits,))
            else:
                self.state.removeKey(node)
        self.changed.clear()
