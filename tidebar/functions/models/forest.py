"""An isolation forest: random partition trees on subsamples; what few cuts isolate is unusual."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Each tree is complete to its depth: feature (-1: leaf), threshold and path length by node."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    expected: float
    offset: float


def expected_path(n: float) -> float:
    """The mean number of steps of an unsuccessful search in a binary tree of n keys."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _tree(x: np.ndarray, depth: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 2 ** (depth + 1) - 1
    feature, threshold, path = np.full(size, -1), np.zeros(size), np.zeros(size)
    held = {0: np.arange(len(x))}
    for node in range(size):
        rows = held.pop(node, None)
        if rows is None:
            continue
        level = (node + 1).bit_length() - 1
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_to = np.flatnonzero(high > low)
        if level == depth or len(rows) <= 1 or not len(open_to):
            path[node] = level + expected_path(len(rows))
            continue
        j = open_to[r.integers(len(open_to))]
        at = r.uniform(low[j], high[j])
        left = part[:, j] <= at
        feature[node], threshold[node] = j, at
        held[2 * node + 1], held[2 * node + 2] = rows[left], rows[~left]
    return feature, threshold, path


def anomaly(model: Forest, x: np.ndarray) -> np.ndarray:
    """Between 0 and 1; the larger, the fewer cuts isolate the row."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, path in zip(model.feature, model.threshold, model.path):
        at = np.zeros(len(x), int)
        for _ in range(len(feature).bit_length() - 1):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > threshold[at]), at)
        total += path[at]
    return 2.0 ** (-total / len(model.feature) / model.expected)


def fit(x: np.ndarray, seed: int, trees: int = 100, sample: int = 256, contamination: float = 0.02) -> Forest:
    r = np.random.default_rng(seed)
    n = min(sample, len(x))
    depth = int(np.ceil(np.log2(max(n, 2))))
    parts = [_tree(x[r.choice(len(x), n, replace=False)], depth, r) for _ in range(trees)]
    model = Forest(*(np.stack(p) for p in zip(*parts)), expected_path(n), 0.0)
    return Forest(model.feature, model.threshold, model.path, model.expected, float(np.quantile(-anomaly(model, x), contamination)))


def decision(model: Forest, x: np.ndarray) -> np.ndarray:
    """Below 0 for rows more unusual than all but `contamination` of the training rows."""
    return -anomaly(model, x) - model.offset
