"""Isolation forests in numpy: fitted on a bounded sample, scored over whole arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Documented bounds of the fit: readings a tree sees, trees, and readings a source's sample holds.
TREE_SAMPLE, TREES, SOURCE_SAMPLE = 64, 24, 512
#: A cut is drawn from a node's range, carried on by so many times its width beyond the greatest reading:
#: what lies far outside falls into empty ground within a few cuts, however the readings inside lie.
REACH = 2.0
_NODE = np.dtype([("feature", "i1"), ("cut", "<f4"), ("length", "<f4")])


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n readings."""
    n = np.maximum(np.asarray(n, dtype=np.float64), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, value, np.where(n > 1, 1.0, 0.0))


class Forest:
    """Trees as heap-shaped arrays: node i has children 2i+1 and 2i+2; feature -1 marks an end."""

    def __init__(self, nodes: np.ndarray, size: int):
        self.nodes, self.size = nodes, size

    @classmethod
    def fit(cls, sample: np.ndarray, seed: int, least_spread: float = 0.25, weights: Sequence[float] | None = None, trees: int = TREES, tree_sample: int = TREE_SAMPLE, reach: float = REACH) -> Forest:
        """All trees grow level by level together. A node reaches at least ``least_spread`` beyond its readings.

        ``weights``: how often each feature is cut; all alike by default.
        """
        rng = np.random.default_rng(seed)
        sample = np.asarray(sample, dtype=np.float32)
        size = min(tree_sample, len(sample))
        depth = 1 + max(1, int(np.ceil(np.log2(max(2, size)))))
        width = (1 << (depth + 1)) - 1
        nodes = np.zeros((trees, width), dtype=_NODE)
        feature, cut, length = (nodes[n].reshape(-1) for n in ("feature", "cut", "length"))
        feature[:] = -1
        rows = sample[np.argsort(rng.random((trees, len(sample))), axis=1)[:, :size]].reshape(trees * size, -1)
        tree = np.repeat(np.arange(trees), size)
        node = np.zeros(trees * size, dtype=np.int64)
        for level in range(depth + 1):
            if not len(rows):
                break
            places, group, counts = np.unique(tree * width + node, return_inverse=True, return_counts=True)
            order = np.argsort(group, kind="stable")
            starts = np.r_[0, np.cumsum(counts)[:-1]]
            low, high = (f.reduceat(rows[order], starts, axis=0) for f in (np.minimum, np.maximum))
            ends = (counts == 1) | (level == depth)
            length[places[ends]] = level + _expected(counts[ends])
            chosen = rng.choice(rows.shape[1], size=len(places), p=weights)
            at = np.arange(len(places))
            low, high = low[at, chosen], high[at, chosen]
            high = high + np.maximum(reach * (high - low), least_spread)
            where = (low + rng.random(len(places)) * (high - low)).astype(np.float32)
            inner = places[~ends]
            feature[inner], cut[inner] = chosen[~ends], where[~ends]
            below = inner // width * width + 2 * (inner % width)
            length[below + 1] = length[below + 2] = level + 1  # what no reading reaches ends there
            right = rows[np.arange(len(rows)), chosen[group]] > where[group]
            on = ~ends[group]
            node, tree, rows = (2 * node + 1 + right)[on], tree[on], rows[on]
        nodes["feature"], nodes["cut"], nodes["length"] = (x.reshape(trees, width) for x in (feature, cut, length))
        return cls(nodes, size)

    def packed(self) -> bytes:
        return np.array([self.size, len(self.nodes)], dtype="<i4").tobytes() + self.nodes.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Forest:
        size, trees = np.frombuffer(data, dtype="<i4", count=2)
        return cls(np.frombuffer(data, dtype=_NODE, offset=8).reshape(trees, -1), int(size))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; well above 0.5 for readings that are isolated early."""
        at_row = np.arange(len(rows))
        total = np.zeros(len(rows))
        for tree in self.nodes:
            feature, cut, length = (np.ascontiguousarray(tree[n]) for n in ("feature", "cut", "length"))
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(int(np.log2(len(tree) + 1)) - 1):
                f = feature[node]
                step = 2 * node + 1 + (rows[at_row, np.maximum(f, 0)] > cut[node])
                node = np.where(f >= 0, step, node)
            total += length[node]
        scale = max(float(_expected(self.size)), 1e-9)
        return 2.0 ** (-(total / len(self.nodes)) / scale)
