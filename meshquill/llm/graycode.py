"""Gray-order hierarchical index over 64-bit fingerprints.

Fingerprints sorted by Gray rank put those with shared bits together. A node
stands for a run of them and keeps the bits on which all agree; bits that its
parent already keeps are factored out of it. A search walks down level by
level for many queries at once, adds up the differences of the nodes it has
passed, and drops a whole run as soon as the sum exceeds the limit.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of x in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """An index of distinct fingerprints; ``values`` are in Gray order."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        n = len(self.values)
        ands, ors, masks, bits = self.values, self.values, [np.full(n, ALL)], [self.values]
        self.starts = [np.arange(n + 1)]  # of each level's nodes, in the level below
        self.last = [np.arange(n)]
        while len(ands) > 1:
            cut = np.arange(0, len(ands), FANOUT)
            self.starts.append(np.append(cut, len(ands)))
            self.last.append(self.last[-1][np.append(cut[1:], len(ands)) - 1])
            ands, ors = np.bitwise_and.reduceat(ands, cut), np.bitwise_or.reduceat(ors, cut)
            agree = ~(ands ^ ors)
            masks.append(agree)
            bits.append(ands & agree)
        self.bits, self.own = bits, []
        for level, mask in enumerate(masks):  # factor out what the parent keeps
            if level + 1 < len(masks):
                parent = np.repeat(masks[level + 1], np.diff(self.starts[level + 1]))
                mask = mask & ~parent
            self.own.append(mask)

    def pairs(self, limit: int, block: int = 512, max_frontier: int = 1 << 20):
        """Blocks of (i, j), i < j: positions of values that differ in limit bits at most."""
        n, top = len(self.values), len(self.bits) - 1
        lo = 0
        while lo < n:
            hi = min(n, lo + block)
            yield from self._walk(np.arange(lo, hi), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.uint8), top, limit, max_frontier)
            lo = hi

    def _walk(self, q, node, acc, level, limit, most):
        """q: queries' positions; node: nodes to test at level."""
        while len(q):
            acc = acc + np.bitwise_count((self.values[q] ^ self.bits[level][node]) & self.own[level][node])
            ok = (acc <= limit) & (self.last[level][node] > q)
            q, node, acc = q[ok], node[ok], acc[ok]
            if level == 0:
                if len(q):
                    yield q, node
                return
            first = self.starts[level][node]
            n = self.starts[level][node + 1] - first
            if n.sum() > most and len(q) > 1:  # bounded memory: halves one after the other
                h = len(q) // 2
                for part in (slice(None, h), slice(h, None)):
                    yield from self._down(q[part], first[part], n[part], acc[part], level, limit, most)
                return
            q, node, acc = self._children(q, first, n, acc)
            level -= 1

    @staticmethod
    def _children(q, first, n, acc):
        skip = np.repeat(np.cumsum(n) - n, n)
        return np.repeat(q, n), np.repeat(first, n) + np.arange(int(n.sum())) - skip, np.repeat(acc, n)

    def _down(self, q, first, n, acc, level, limit, most):
        if n.sum() > most and len(q) > 1:
            h = len(q) // 2
            for part in (slice(None, h), slice(h, None)):
                yield from self._down(q[part], first[part], n[part], acc[part], level, limit, most)
            return
        yield from self._walk(*self._children(q, first, n, acc), level - 1, limit, most)


def components(n: int, pair_blocks) -> np.ndarray:
    """Smallest position linked to each of n positions."""
    root = np.arange(n)
    for i, j in pair_blocks:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root
