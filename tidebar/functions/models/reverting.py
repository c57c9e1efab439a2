"""A level that log prices return to: a discrete AR(1) by rolling sums, for many windows at once."""

from __future__ import annotations

import numpy as np

#: fixed values: half-lives in bars that count
HALF_LIFE = (3, 120)


def fits(x: np.ndarray, rows: int, at: np.ndarray, half_life: tuple[float, float] = HALF_LIFE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, stationary deviation, factor a bar) of the `rows` values before each place; NaN where values are missing, where they are
    not drawn back, or where half the way takes too few or too many bars."""
    whole = np.isfinite(x)
    x = np.where(whole, x, 0.0)
    middle = x[whole].mean() if whole.any() else 0.0
    u = np.where(whole, x - middle, 0.0)
    now, then = u[:-1], u[1:]
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (now, then, now * now, now * then, then * then, (~whole).astype(float))]
    over = lambda s, n: s[at - rows + n] - s[at - rows]
    n = rows - 1
    a, b, aa, ab, bb = (over(s, n) / n for s in sums[:5])
    missing = over(sums[5], rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread, shared = aa - a * a, ab - a * b
        phi = shared / spread
        level = (b - phi * a) / (1 - phi)
        noise = np.maximum(bb - b * b - phi * shared, 0)
        half = -np.log(2) / np.log(phi)
        deviation = np.sqrt(noise / (1 - phi * phi))
        good = (missing == 0) & (spread > 1e-18) & (phi > 0) & (phi < 1) & (half >= half_life[0]) & (half <= half_life[1])
    return tuple(np.where(good, v, np.nan) for v in (level + middle, deviation, phi))
