"""Simple-8b word-aligned coding of unsigned integers, vectorised with numpy.

A word has a 4-bit selector in its top bits and 60 bits of payload, first value lowest.  Selectors
1 to 13 hold ``COUNT[s]`` values of ``WIDTH[s]`` bits; selector 0 is a run of 240 zeros.  Selector
15 is the escape: the next word is one raw 64-bit value (for values of 2**60 and more).
"""

from __future__ import annotations

import numpy as np

#: Values in a block.
BLOCK = 1024
#: Fixed values of the format: bits of a value, and values in a word, by selector.
WIDTH = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.int64)
COUNT = np.array([240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
_LIMIT = [np.uint64((1 << int(w)) - 1) if w < 64 else np.uint64(2**64 - 1) for w in WIDTH]


_SHORT = np.zeros(1 << 16, np.uint8)
for _k in range(16):
    _SHORT[1 << _k : 2 << _k] = _k + 1


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if int(v.max()) < len(_SHORT):
        return _SHORT[v]
    return np.searchsorted(np.array([1 << k for k in range(64)], np.uint64), v, side="right").astype(np.uint8)


def _widest(bits: np.ndarray, known: dict[int, np.ndarray], k: int) -> np.ndarray:
    """Most bits among the k values from each position of a block on; with fewer left in it, 255."""
    if k not in known:
        half = 1 << (k.bit_length() - 1)
        half = half if half < k else k // 2
        x, d = _widest(bits, known, half), k - half
        out = np.full(bits.shape, 255, np.uint8)
        np.maximum(x[:, :-d], x[:, d:], out=out[:, :-d])
        known[k] = out
    return known[k]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and where the words of each block of ``BLOCK`` values begin.

    At each position the selector that packs the most values wins; no word reaches over its block,
    so that all blocks are walked (and can be decoded) side by side.
    """
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = -(-n // BLOCK)
    bits = np.full(rows * BLOCK, 255, np.uint8)
    bits[:n] = _bits(v)
    grid = bits.reshape(rows, BLOCK)
    known = {1: grid}
    sel = np.where(grid <= 60, np.uint8(14), np.uint8(15))
    for s in range(13, -1, -1):  # denser selectors win
        np.putmask(sel, _widest(grid, known, int(COUNT[s])) <= WIDTH[s], np.uint8(s))
    sel = sel.reshape(-1)[:n]
    step = COUNT[sel]
    head = np.zeros(n, bool)
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    while len(at):
        head[at] = True
        at = at + step[at]
        more = at < end
        if not more.all():
            at, end = at[more], end[more]
    at = np.flatnonzero(head)
    chosen = sel[at].astype(np.int64)
    escaped = chosen == 15
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    out = np.zeros(len(at) + int(escaped.sum()), np.uint64)
    out[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        w, c = int(WIDTH[s]), int(COUNT[s])
        here = np.flatnonzero(chosen == s)
        if s == 15:
            out[place[here] + 1] = v[at[here]]
        elif s:
            to, body = at[here], np.full(len(here), s << 60, np.uint64)
            for k in range(c):
                body |= v[to + k] << np.uint64(w * k)
            out[place[here]] = body
    return out, place[np.searchsorted(at, np.arange(0, n, BLOCK))]


def decode(words: np.ndarray) -> np.ndarray:
    """The values of a block of words, selector by selector."""
    w = np.ascontiguousarray(words, np.uint64)
    if not len(w):
        return np.zeros(0, np.uint64)
    sel = (w >> np.uint64(60)).astype(np.int64)
    if (sel == 15).any():  # the word after an escape is raw
        raw = np.zeros(len(w), bool)
        for i in np.flatnonzero(sel == 15).tolist():
            if not raw[i]:
                raw[i + 1] = True
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(w))
    hs = sel[heads]
    n = COUNT[hs]
    start = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(start[-1]), np.uint64)
    for s in np.unique(hs).tolist():
        here = np.flatnonzero(hs == s)
        if s == 15:
            out[start[here]] = w[heads[here] + 1]
        elif s:
            body, mask = w[heads[here]], _LIMIT[s]
            for k in range(int(COUNT[s])):
                out[start[here] + k] = (body >> np.uint64(int(WIDTH[s]) * k)) & mask
    return out
