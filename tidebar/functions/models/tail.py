"""A generalised Pareto distribution of what exceeds a threshold, by maximum likelihood.

With t = shape / scale the best shape for a given t is the mean of log(1 + t x), so the likelihood is a function of t alone: it is
looked at on a grid on both sides of zero (zero is the exponential distribution), and the best place is refined by golden sections.
"""

from __future__ import annotations

import numpy as np

_GOLD = (np.sqrt(5) - 1) / 2


def likelihood(x: np.ndarray, shape: float, scale: float) -> float:
    if scale <= 0:
        return -np.inf
    if abs(shape) < 1e-12:
        return float(-len(x) * np.log(scale) - x.sum() / scale)
    inside = 1 + shape * x / scale
    return float(-len(x) * np.log(scale) - (1 + 1 / shape) * np.log(inside).sum()) if (inside > 0).all() else -np.inf


def _at(x: np.ndarray, t: float) -> tuple[float, float, float]:
    """(likelihood, shape, scale) of the best shape for t; below -1 the likelihood has no maximum, so -1 is the lowest."""
    if abs(t) * x.max() < 1e-9:
        scale = float(x.mean())
        return likelihood(x, 0.0, scale), 0.0, scale
    shape = float(np.log1p(t * x).mean())
    if shape < -1:
        return likelihood(x, -1.0, -1 / t), -1.0, -1 / t
    return -len(x) * (np.log(shape / t) + shape + 1), shape, shape / t


def fit(x: np.ndarray, points: int = 200) -> tuple[float, float] | None:
    """(shape, scale) of positive excesses; none where there is no spread."""
    if not len(x) or not (x > 0).all():
        return None
    top, mean = x.max(), x.mean()
    places = np.concatenate([-(1 - np.geomspace(1e-6, 1, points)) / top, [0.0], np.geomspace(1e-6, 1e3, points) / mean])
    places.sort()
    values = np.array([_at(x, t)[0] for t in places])
    k = int(values.argmax())
    low, high = places[max(0, k - 1)], places[min(len(places) - 1, k + 1)]
    for _ in range(80):
        a, b = high - _GOLD * (high - low), low + _GOLD * (high - low)
        if _at(x, a)[0] >= _at(x, b)[0]:
            high = b
        else:
            low = a
    best = max((_at(x, t) for t in ((low + high) / 2, places[k])), key=lambda v: v[0])
    return (best[1], best[2]) if np.isfinite(best[0]) else None


def survival(x: np.ndarray, shape: float, scale: float) -> np.ndarray:
    """The probability of more than x >= 0."""
    if abs(shape) < 1e-12:
        return np.exp(-x / scale)
    return np.maximum(1 + shape * x / scale, 0) ** (-1 / shape)
