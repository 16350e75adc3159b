"""A finger B-tree of partial aggregates.

Keys are ordered; each leaf entry has a partial aggregate and each inner node the aggregate of all
below it. A finger stays on the newest leaf: keys in order are appended there without a descent,
and the nodes of the right spine leave their aggregates open until asked. A late key climbs from
the finger to the first node that spans it, goes down from there and is added to the aggregates of
its ancestors up to the spine. Everything below a bound is cut off as whole subtrees.

``advance`` moves two bounds forward: keys below the first belong to closed periods, so they are late;
keys below the second belong to subtrees that are cut off or about to be, so they are refused.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import Any


OPEN, CLOSED, REFUSED = 0, 1, 2


class _Node:
    __slots__ = ("agg", "keys", "leaf", "parent", "vals")

    def __init__(self, leaf: bool):
        self.leaf, self.keys, self.vals, self.agg, self.parent = leaf, [], [], None, None


class FingerTree:
    def __init__(self, merge: Callable[[Any, Any], Any], width: int = 32):
        self.merge, self.width = merge, width
        self.root = self.finger = _Node(True)
        self.late = 0
        self.closed = self.floor = None

    def advance(self, closed: Any, floor: Any) -> None:
        """Keys below ``closed`` are late from now on, keys below ``floor`` are refused. Bounds do not go back."""
        self.closed = closed if self.closed is None else max(self.closed, closed)
        self.floor = floor if self.floor is None else max(self.floor, floor)

    def lowest(self) -> Any:
        """The least key, None if there is none."""
        node = self.root
        while not node.leaf:
            node = node.vals[0]
        return node.keys[0] if node.keys else None

    def __len__(self) -> int:
        return sum(1 for _ in self.items())

    def insert(self, key: Any, part: Any, late_part: Any = None) -> int:
        """Take in ``part``, or ``late_part`` where the key's period is closed; OPEN, CLOSED, or REFUSED with nothing taken in."""
        state = OPEN
        if self.floor is not None:
            if key < self.floor:
                return REFUSED
            if key < self.closed:
                state = CLOSED
                part = part if late_part is None else late_part
        self._insert(key, part)
        return state

    def _insert(self, key: Any, part: Any) -> None:
        leaf = self.finger
        if leaf.parent is not None and key < leaf.keys[0]:
            self.late += 1
            node = leaf.parent
            while node.parent is not None and key < node.keys[0]:
                node = node.parent
            while not node.leaf:
                node = node.vals[max(0, bisect_right(node.keys, key) - 1)]
            leaf = node
        at = bisect_left(leaf.keys, key)
        if at < len(leaf.keys) and leaf.keys[at] == key:
            leaf.vals[at] = self.merge(leaf.vals[at], part)
        else:
            leaf.keys.insert(at, key)
            leaf.vals.insert(at, part)
        low, node = leaf.keys[0], leaf
        while node is not None and node.agg is not None:
            node.agg = self.merge(node.agg, part)
            node = node.parent
        node = leaf
        while (above := node.parent) is not None:
            at = above.vals.index(node)
            if above.keys[at] <= low:
                break
            above.keys[at] = low
            node = above
        if len(leaf.keys) > self.width:
            self._split(leaf)

    def _split(self, node: _Node) -> None:
        half = len(node.keys) // 2
        if node is self.finger and node.leaf:
            half = len(node.keys) - 1  # in-order keys leave full leaves behind
        new = _Node(node.leaf)
        new.keys, new.vals = node.keys[half:], node.vals[half:]
        del node.keys[half:], node.vals[half:]
        if not new.leaf:
            for child in new.vals:
                child.parent = new
        open_spine = node.agg is None
        node.agg = None
        if node.parent is None:
            self.root = _Node(False)
            self.root.keys, self.root.vals = [node.keys[0]], [node]
            node.parent = self.root
        above = new.parent = node.parent
        at = above.vals.index(node) + 1
        above.keys.insert(at, new.keys[0])
        above.vals.insert(at, new)
        if self.finger is node:
            self.finger = new
        node.agg = self.total(node)
        if not open_spine:
            new.agg = self.total(new)
        if len(above.keys) > self.width:
            self._split(above)

    def total(self, node: _Node | None = None) -> Any:
        """The aggregate of a subtree, of everything by default; None if it is empty."""
        node = node or self.root
        if node.agg is not None:
            return node.agg
        result = None
        for value in node.vals:
            part = value if node.leaf else self.total(value)
            result = part if result is None else self.merge(result, part)
        return result

    def range_total(self, low: Any, high: Any) -> Any:
        """The aggregate of low <= key < high; whole subtrees inside count by their aggregate."""

        def walk(node: _Node, below: Any) -> Any:
            result = None
            for i, key in enumerate(node.keys):
                following = node.keys[i + 1] if i + 1 < len(node.keys) else below
                if node.leaf:
                    part = node.vals[i] if low <= key < high else None
                elif key >= high or (following is not None and following <= low):
                    part = None
                elif key >= low and following is not None and following <= high:
                    part = self.total(node.vals[i])
                else:
                    part = walk(node.vals[i], following)
                if part is not None:
                    result = part if result is None else self.merge(result, part)
            return result

        return walk(self.root, None)

    def items(self, node: _Node | None = None) -> Iterator[tuple[Any, Any]]:
        node = node or self.root
        if node.leaf:
            yield from zip(node.keys, node.vals, strict=True)
        else:
            for child in node.vals:
                yield from self.items(child)

    def evict(self, bound: Any) -> list[tuple[Any, Any]]:
        """Cut off all keys below ``bound`` and return them in order."""
        gone: list[tuple[Any, Any]] = []
        node = self.root
        while True:
            if node.leaf:
                n = bisect_left(node.keys, bound)
                gone += zip(node.keys[:n], node.vals[:n], strict=True)
            else:
                n = max(0, bisect_right(node.keys, bound) - 1)
                for child in node.vals[:n]:
                    gone += self.items(child)
            del node.keys[:n], node.vals[:n]
            if node.leaf:
                break
            node = node.vals[0]
        if gone:
            while node is not None:  # the left spine lost entries; its aggregates are taken anew when asked
                node.agg = None
                node = node.parent
            while not self.root.leaf and len(self.root.vals) == 1:
                self.root = self.root.vals[0]
                self.root.parent = None
            self._tidy()
        return gone

    def _tidy(self) -> None:
        """No empty leaf stays on the left, unless it is the only one."""
        node = self.root
        while not node.leaf:
            node = node.vals[0]
        while not node.keys and node.parent is not None:
            above = node.parent
            above.vals.pop(0)
            above.keys.pop(0)
            node = above
            if node.vals and node is not self.root:
                break
        while not self.root.leaf and len(self.root.vals) == 1:
            self.root = self.root.vals[0]
            self.root.parent = None
        if not self.root.leaf and not self.root.vals:
            self.root = _Node(True)
        node = self.root
        while not node.leaf:
            node = node.vals[-1]
        self.finger = node
