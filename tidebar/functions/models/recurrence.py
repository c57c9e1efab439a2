"""Determinism of a recurrence plot: the share of its points that lie on diagonals."""

from __future__ import annotations

import numpy as np


def determinism(window: np.ndarray, dimension: int = 3, near: float = 0.5, theiler: int = 2, line: int = 3) -> float:
    """The window, scaled to deviation 1, is embedded in `dimension` delays; two places recur when they are nearer than `near`. Pairs
    at most `theiler` apart do not count; of all others, the share in diagonal lines of at least `line` points."""
    spread = window.std()
    if not np.isfinite(spread) or spread <= 0:
        return np.nan
    x = (window - window.mean()) / spread
    v = np.lib.stride_tricks.sliding_window_view(x, dimension)
    n = len(v)
    total = on_lines = 0
    for apart in range(theiler + 1, n):
        recurs = ((v[apart:] - v[:-apart]) ** 2).sum(axis=1) < near * near
        edges = np.flatnonzero(np.diff(np.concatenate([[False], recurs, [False]]).astype(np.int8)))
        runs = edges[1::2] - edges[::2]
        total += runs.sum()
        on_lines += runs[runs >= line].sum()
    return on_lines / total if total else np.nan
