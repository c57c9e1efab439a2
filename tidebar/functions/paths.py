"""Searches along one series, for all queries at once with numpy."""

from __future__ import annotations

import numpy as np


def _table(x: np.ndarray) -> list[np.ndarray]:
    """Minima of blocks of 1, 2, 4, ... values from each place on; missing values never count."""
    rows = [np.where(np.isnan(x), np.inf, x)]
    while 2 * 2 ** (len(rows) - 1) <= len(x):
        last, half = rows[-1], 2 ** (len(rows) - 1)
        rows.append(np.minimum(last[:-half], last[half:]))
    return rows


def first_at_most(x: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each query the first place >= start where x <= level, len(x) where there is none; O(log n) steps for all queries."""
    table, n = _table(x), len(x)
    at = np.minimum(np.asarray(start, np.int64), n)
    bad = np.isnan(level)
    level = np.where(bad, -np.inf, level)
    for k in range(len(table) - 1, -1, -1):
        fits = at + 2**k <= n
        skip = np.zeros(len(at), bool)
        skip[fits] = table[k][at[fits]] > level[fits]
        at = at + skip * 2**k
    at = np.where((at < n) & ~bad, at, n)
    return at


def first_at_least(x: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    return first_at_most(-x, start, -np.asarray(level, float))


def next_event(mask: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place >= start where mask holds, len(mask) where there is none."""
    where = np.append(np.flatnonzero(mask), len(mask))
    return where[np.searchsorted(where[:-1], start)]


def first_profitable(close: np.ndarray, mask: np.ndarray, start: np.ndarray, price: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The first event at or after start whose close is beyond the entry price in the entry's direction."""
    events = np.flatnonzero(mask)
    if not len(events):
        return np.full(len(start), len(close))
    out = np.full(len(start), len(close), np.int64)
    at = np.searchsorted(events, start)
    for s in (1, -1):
        own = side == s
        x = -close[events] if s == 1 else close[events]
        edge = np.nextafter(-price[own] if s == 1 else price[own], -np.inf)
        found = first_at_most(x, at[own], edge)
        out[own] = np.append(events, len(close))[found]
    return out
