"""Window anchors: where equal windows must meet.

Every window of W symbols owns one anchor, the gram of k symbols in it with the smallest hash (the first of equal ones). Equal
windows own equal grams at equal places in them, so windows need comparing only within an anchor's group. Successive windows
share anchors, about one anchor for (W - k + 2) / 2 symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix

#: Windows are taken in chunks of so many starts; an anchor's place fits the low bits of a key.
CHUNK, LOW = 1 << 20, np.uint64(22)
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Scrambled polynomial hashes of all k successive symbols, by doubling."""
    h, have, base = symbols.astype(np.uint64), 1, BASE
    out, out_len, out_base = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                if out is None:
                    out, out_len, out_base = h, have, base
                else:
                    n = min(len(out), len(h) - out_len)
                    if n <= 0:
                        return np.empty(0, np.uint64)
                    out = out[:n] * base + h[out_len : out_len + n]
                    out_len, out_base = out_len + have, out_base * base
            k >>= 1
            if k:
                if len(h) <= have:
                    return np.empty(0, np.uint64)
                h = h[:-have] * base + h[have:]
                have, base = have * 2, base * base
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, from running minima of blocks of w in both directions."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(symbols: np.ndarray, where: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(sequence, hash, place, first window start, last window start) of all anchors, in chunks; no window is in two of them.

    The sequences stand in a row and begin at `where` (n + 1 places); places and starts count from the row's begin."""
    n = len(symbols) - window + 1
    size = np.diff(where)
    stop = np.repeat(where[1:], size)  # where the sequence of each symbol ends
    for begin in range(0, max(n, 0), CHUNK):
        part = symbols[begin : min(begin + CHUNK, n) + window - 1]
        h = gram_hashes(part, k)
        key = (h >> LOW << LOW) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, window - k + 1) & np.uint64((1 << int(LOW)) - 1)).astype(np.int64)
        own = np.flatnonzero(np.arange(begin, begin + len(at)) + window <= stop[begin : begin + len(at)])
        if not len(own):
            continue
        at = at[own]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        lo, hi, place = own[first] + begin, own[last] + begin, at[first] + begin
        yield np.searchsorted(where, lo, "right") - 1, h[at[first]], place, lo, hi


def packed(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place and first and last window start of an anchor in one number; both starts are less than 2^16 before the place."""
    return place << 32 | (place - lo) << 16 | (place - hi)
