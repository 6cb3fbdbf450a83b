"""A Gray-order hierarchical index over fingerprints, for Hamming neighbours within a radius.

Fingerprints of a group are sorted by Gray rank, so that neighbours share bits.  Runs of ``FAN``
entries form a node that keeps the bits all of them share (``ones`` = AND, ``some`` = OR); nodes
form higher nodes likewise.  Two nodes differ at least where one has only ones and the other only
zeros; whole groups are pruned as soon as these differences exceed the radius.

Defined results: no entries give no links; equal fingerprints are linked whatever the radius; entries
of different groups are never linked.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: Node pairs expanded at once.
FRONT = 1 << 18


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray sequence."""
    x = x.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join many pairs at once; the root of a set is its least member."""
    while len(a):
        a, b = find(parent, a), find(parent, b)
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class Tree:
    """Levels of nodes over sorted entries; entries of different groups are never in one node."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        """group: nondecreasing; prints: (n, words) of uint64."""
        self.ones, self.some, self.first, self.group = [prints], [prints], [np.arange(len(group) + 1)], [group]
        while True:
            g = self.group[-1]
            if len(g) == len(np.unique(g)):
                break
            begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            at = np.arange(len(g)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(g)]])))
            head = np.flatnonzero(at % FAN == 0)
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], head, axis=0))
            self.some.append(np.bitwise_or.reduceat(self.some[-1], head, axis=0))
            self.first.append(np.concatenate([head, [len(g)]]))
            self.group.append(g[head])

    def _near(self, level: int, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
        n = np.zeros(len(i), np.int64)
        for w in range(self.ones[0].shape[1]):
            oi, si, oj, sj = self.ones[level][i, w], self.some[level][i, w], self.ones[level][j, w], self.some[level][j, w]
            n += np.bitwise_count((oi & ~sj) | (oj & ~si))
        return n <= radius

    def pairs(self, radius: int, parent: np.ndarray | None = None):
        """Pairs of entries of one group within the radius, in batches.

        With ``parent`` (a union-find array that the caller updates between batches) pairs of nodes
        whose entries are all joined already are skipped, so that a dense group costs no more than
        its spanning links.
        """
        top = len(self.first) - 1
        roots = np.arange(len(self.group[top]))
        stack = [(top, roots, roots)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > FRONT:
                stack += [(level, i[k : k + FRONT], j[k : k + FRONT]) for k in range(0, len(i), FRONT)]
                continue
            if parent is not None and level:
                low, high = self._labels(level, parent)
                apart = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
                i, j = i[apart], j[apart]
            if not level:
                keep = i < j
                if len(i := i[keep]):
                    yield i, j[keep]
                continue
            ni, nj = self.first[level][i + 1] - self.first[level][i], self.first[level][j + 1] - self.first[level][j]
            each = ni * nj
            for a in _chunks(each, 8 * FRONT):
                e, fi, fj, m = each[a], self.first[level][i[a]], self.first[level][j[a]], nj[a]
                k = np.arange(int(e.sum())) - np.repeat(np.cumsum(e) - e, e)
                wide = np.repeat(m, e)
                ci, cj = np.repeat(fi, e) + k // wide, np.repeat(fj, e) + k % wide
                ok = ci <= cj
                ci, cj = ci[ok], cj[ok]
                ok = self._near(level - 1, ci, cj, radius)
                if ok.any():
                    stack.append((level - 1, ci[ok], cj[ok]))

    def _labels(self, level: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = find(parent, np.arange(len(parent)))
        low = high = x
        for up in range(1, level + 1):
            low, high = np.minimum.reduceat(low, self.first[up][:-1]), np.maximum.reduceat(high, self.first[up][:-1])
        return low, high


def _chunks(sizes: np.ndarray, most: int):
    if not len(sizes):
        return
    run = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield slice(a, b)


def spanning_links(group: np.ndarray, prints: np.ndarray, radius: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (entry, least entry of its set) that join all entries of a group connected within the radius.

    Entries must come sorted by (group, Gray rank).  Entries of a group with one ``label`` count as joined.
    """
    n = len(group)
    parent = np.arange(n)
    if n > 1:
        if label is not None:
            order = np.lexsort((label, group))
            same = (group[order][1:] == group[order][:-1]) & (label[order][1:] == label[order][:-1])
            union(parent, order[:-1][same], order[1:][same])
        a = np.flatnonzero(group[1:] == group[:-1])
        d = np.zeros(len(a), np.int64)
        for w in range(prints.shape[1]):
            d += np.bitwise_count(prints[a, w] ^ prints[a + 1, w])
        union(parent, a[d <= radius], a[d <= radius] + 1)
        for i, j in Tree(group, prints).pairs(radius, parent):
            union(parent, i, j)
    root = find(parent, np.arange(n))
    i = np.flatnonzero(root != np.arange(n))
    return i, root[i]
