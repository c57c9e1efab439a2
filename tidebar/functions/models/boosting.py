"""Gradient-boosted trees for classes: softmax loss, Newton steps, splits found in histograms of at most 255 bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    edges: list[np.ndarray]
    base: np.ndarray
    #: for each round and class: (feature, bin, value) of a complete tree's nodes; feature -1 is a leaf
    nodes: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def bin_edges(x: np.ndarray, bins: int = 255) -> np.ndarray:
    """Cuts between neighbouring values, at most bins - 1 of them and then at even ranks."""
    values = np.unique(x)
    middle = (values[1:] + values[:-1]) / 2
    return middle if len(middle) < bins else np.unique(np.quantile(x, np.arange(1, bins) / bins, method="midpoint"))


def _tree(codes: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least_rows: int, least_hessian: float):
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
    at = np.zeros(len(g), int)
    for level in range(depth + 1):
        first, last = 2**level - 1, 2 ** (level + 1) - 1
        for node in range(first, last):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[node] = -rate * total_g / max(total_h, 1e-300)
            if level == depth or len(rows) < 2 * least_rows:
                continue
            best = 1e-12
            for j in range(codes.shape[1]):
                c = codes[rows, j]
                left_g = np.cumsum(np.bincount(c, g[rows], bins[j]))[:-1]
                left_h = np.cumsum(np.bincount(c, h[rows], bins[j]))[:-1]
                left_n = np.cumsum(np.bincount(c, minlength=bins[j]))[:-1]
                right_h = total_h - left_h
                fine = (left_n >= least_rows) & (len(rows) - left_n >= least_rows) & (left_h >= least_hessian) & (right_h >= least_hessian)
                if not fine.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(fine, left_g**2 / left_h + (total_g - left_g) ** 2 / right_h - total_g**2 / total_h, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, k
            if feature[node] >= 0:
                at[rows] = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
    return feature, cut, value


def _reach(tree, codes: np.ndarray) -> np.ndarray:
    feature, cut, value = tree
    at = np.zeros(len(codes), int)
    for _ in range(len(feature).bit_length() - 1):
        f = feature[at]
        inner = f >= 0
        at = np.where(inner, 2 * at + 1 + (codes[np.arange(len(codes)), np.maximum(f, 0)] > cut[at]), at)
    return value[at]


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 100, depth: int = 3, rate: float = 0.05, least_rows: int = 20, least_hessian: float = 1e-3) -> Trees:
    """y: class numbers. Scores begin with the logarithms of the classes' shares."""
    edges = [bin_edges(x[:, j]) for j in range(x.shape[1])]
    codes, bins = _codes(x, edges), np.array([len(e) + 1 for e in edges])
    base = np.log(np.maximum(np.bincount(y, minlength=classes), 1e-12) / len(y))
    score, hot, nodes = np.tile(base, (len(y), 1)), np.eye(classes)[y], []
    for _ in range(rounds):
        p = softmax(score)
        trees = [_tree(codes, bins, p[:, k] - hot[:, k], p[:, k] * (1 - p[:, k]), depth, rate, least_rows, least_hessian) for k in range(classes)]
        score += np.column_stack([_reach(t, codes) for t in trees])
        nodes.append(trees)
    return Trees(edges, base, nodes)


def probabilities(model: Trees, x: np.ndarray) -> np.ndarray:
    codes = _codes(x, model.edges)
    score = np.tile(model.base, (len(x), 1))
    for trees in model.nodes:
        score += np.column_stack([_reach(t, codes) for t in trees])
    return softmax(score)
