"""Suffix sort with hash-compared suffixes.

Prefix polynomial hashes of the whole block give the hash of any substring in constant time; a binary search over lengths finds how
far two suffixes agree, so one comparison takes O(log W) steps. A bottom-up mergesort on that comparison orders the suffixes of a
block; equal neighbours (W common bytes) are repeats. Every agreement that counts is verified on the bytes themselves, and a hash
collision sends its suffixes to a comparison of bytes.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0xD6E8FEB86659FD93)


class HashedBlock:
    """Bytes with prefix hashes; what is asked for must lie in the block."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        n = len(self.data)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.power[:n], dtype=np.uint64)])

    def eight(self, p: np.ndarray) -> np.ndarray:
        """The eight bytes from p on as a number, zeros after the end."""
        x = np.concatenate([self.data, np.zeros(8, np.uint8)]).astype(np.uint64)
        for n in (1, 2, 4):
            x = x[:-n] << np.uint64(8 * n) | x[n:]
        return x[p]

    def equal(self, p: np.ndarray, q: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[p + length] - self.prefix[p]) * self.power[q] == (self.prefix[q + length] - self.prefix[q]) * self.power[p]

    def common(self, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """Common bytes of the suffixes at p and q, up to `most`, by binary search."""
        out = np.full(len(p), most, np.int64)
        rest = np.flatnonzero(~self.equal(p, q, most))
        if len(rest):
            lo, hi, p, q = np.zeros(len(rest), np.int64), np.full(len(rest), most - 1, np.int64), p[rest], q[rest]
            while True:
                if (lo >= hi).all():
                    break
                mid = (lo + hi + 1) >> 1
                same = self.equal(p, q, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            out[rest] = lo
        return out

    def less(self, p: np.ndarray, q: np.ndarray, most: int, or_equal: bool) -> np.ndarray:
        n = self.common(p, q, most)
        end = len(self.data) - 1
        a, b = self.data[np.minimum(p + n, end)], self.data[np.minimum(q + n, end)]
        return np.where(n >= most, or_equal, a < b)


def merge_sort(block: HashedBlock, places: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of `places` by group (ascending as given) and then by the first `most` bytes of the suffix there."""
    n = len(places)
    order = np.arange(n)
    if most >= 8:  # the first eight bytes are compared as one number; what they leave equal is merged below
        head = block.eight(places)
        order = np.lexsort((head, group))
        group, head = group[order], head[order]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (head[1:] != head[:-1])])) if n else group
    begin = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1]) if n else np.empty(0, np.int64)
    size = np.diff(np.concatenate([begin, [n]]))
    start, count = np.repeat(begin, size), np.repeat(size, size)
    within = np.arange(n) - start
    run = 1
    while n and run < size.max():
        active = np.flatnonzero(count > run)
        r = within[active] // run
        left = r % 2 == 0
        sibling = start[active] + np.where(left, r + 1, r - 1) * run
        stop = np.minimum(sibling + run, start[active] + count[active])
        has = sibling < stop
        active, left, sibling, stop, r = active[has], left[has], sibling[has], stop[has], r[has]
        lo, hi = sibling.copy(), stop.copy()
        mine = places[order[active]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            theirs = places[order[mid]]
            # the left run's elements come first among equals
            goes = np.where(left[open_], block.less(theirs, mine[open_], most, False), block.less(theirs, mine[open_], most, True))
            lo[open_], hi[open_] = np.where(goes, mid + 1, lo[open_]), np.where(goes, hi[open_], mid)
        pair = start[active] + (r - r % 2) * run
        own = within[active] - r * run
        new = order.copy()
        new[pair + own + (lo - sibling)] = order[active]
        order = new
        run *= 2
    return order


def repeated(data: bytes, base: np.ndarray, group: np.ndarray, anchor: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Which windows have an equal one in another context of their group.

    Context i begins at base[i] of data, has `windows[i]` windows of `width` bytes and its anchor `anchor[i]` bytes after its begin.
    Only windows with the anchor at the same place in them can be equal. Returns a flag per window, contexts in a row.
    """
    block = HashedBlock(data)
    n = int(windows.sum())
    context = np.repeat(np.arange(len(base)), windows)
    t = np.arange(n) - np.repeat(np.cumsum(windows) - windows, windows)
    place, offset = base[context] + t, anchor[context] - t
    by = np.lexsort((offset, group[context]))
    g, o = group[context][by], offset[by]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])]) if n else np.empty(0, bool)
    key = np.cumsum(new)
    order = by[merge_sort(block, place[by], key, width)]
    flag = np.zeros(n, bool)
    if n < 2:
        return flag
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(key[1:] == key[:-1])
    a, b = a[near], b[near]
    same = block.equal(place[a], place[b], width)
    a, b = a[same], b[same]
    # neighbours of the same two contexts at successive starts are verified together
    by = np.lexsort((t[a], context[b], context[a]))
    a, b = a[by], b[by]
    if len(a):
        cut = np.flatnonzero((context[a][1:] != context[a][:-1]) | (context[b][1:] != context[b][:-1]) | (t[a][1:] != t[a][:-1] + 1)) + 1
        for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])):
            p, q, size = place[a[i]], place[b[i]], j - i - 1 + width
            if data[p : p + size] == data[q : q + size]:
                flag[a[i:j]] = flag[b[i:j]] = True
            else:
                _by_bytes(data, place, key, by=order, wanted={int(x) for x in key[np.isin(order, np.concatenate([a[i:j], b[i:j]]))]}, width=width, flag=flag)
    return flag


def _by_bytes(data: bytes, place: np.ndarray, key: np.ndarray, by: np.ndarray, wanted: set[int], width: int, flag: np.ndarray) -> None:
    """After a hash collision: the windows of the groups concerned, compared as bytes."""
    for k in wanted:
        met: dict[bytes, list[int]] = {}
        for x in by[key == k]:
            met.setdefault(data[place[x] : place[x] + width], []).append(int(x))
        for xs in met.values():
            flag[xs] = flag[xs] | (len(xs) > 1)
