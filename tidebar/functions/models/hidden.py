"""A hidden Markov chain with Gaussian emissions, fitted by expectation maximisation.

Both passes of the forward-backward recursion are products of small matrices. They are taken in about sqrt(n) chunks side by side:
first each chunk's product, then the vectors that enter the chunks one after the other, then all chunks again from those vectors.
That is a few hundred numpy steps for ten thousand rows instead of ten thousand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    variances: np.ndarray


def scan(begin: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors v[t] = v[t-1] @ steps[t], each scaled to sum 1, and the logarithm of what it was divided by."""
    n, k, _ = steps.shape
    wide = int(np.ceil(np.sqrt(n)))
    long = -(-n // wide)
    full = np.concatenate([steps, np.broadcast_to(np.eye(k), (wide * long - n, k, k))]).reshape(wide, long, k, k)
    product = np.broadcast_to(np.eye(k), (wide, k, k))
    for j in range(long):
        product = product @ full[:, j]
        product = product / product.sum(axis=(1, 2), keepdims=True)
    enter = np.empty((wide, k))
    v = begin
    for c in range(wide):
        enter[c] = v
        v = v @ product[c]
        v = v / v.sum()
    out, logs = np.empty((wide, long, k)), np.empty((wide, long))
    v = enter
    for j in range(long):
        v = (v[:, None, :] @ full[:, j])[:, 0]
        total = v.sum(axis=1)
        v = v / total[:, None]
        out[:, j], logs[:, j] = v, np.log(total)
    return out.reshape(-1, k)[:n], logs.reshape(-1)[:n]


def emissions(x: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Densities of each value under each state relative to the largest of them, and the logarithm of that one."""
    logs = -0.5 * (np.log(2 * np.pi * chain.variances) + (x[:, None] - chain.means) ** 2 / chain.variances)
    top = logs.max(axis=1)
    return np.exp(logs - top[:, None]), top


def _steps(b: np.ndarray, chain: Chain, first: bool) -> np.ndarray:
    steps = chain.moves * b[:, None, :]
    if first:
        steps[0] = np.diag(b[0])
    return steps


def filtered(x: np.ndarray, chain: Chain, before: np.ndarray | None = None) -> np.ndarray:
    """State probabilities given the values up to and with each; `before` are those of the value before x, none where x is the first."""
    if not len(x):
        return np.empty((0, len(chain.means)))
    b, _ = emissions(x, chain)
    return scan(chain.start if before is None else before, _steps(b, chain, before is None))[0]


def split(x: np.ndarray) -> Chain:
    """Where the fit begins: the lower and the upper half of the values."""
    order = np.sort(x)
    half = len(x) // 2
    means = np.array([order[:half].mean(), order[half:].mean()])
    return Chain(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), means, np.full(2, x.var()))


def fit(x: np.ndarray, most: int = 200, tolerance: float = 1e-4, least_variance: float = 1e-6) -> Chain | None:
    """Two states in the order of their means, or none where the likelihood has not settled to the tolerance within `most` rounds."""
    if not np.isfinite(x).all() or x.var() <= 0:
        return None
    chain, last = split(x), -np.inf
    for _ in range(most):
        b, top = emissions(x, chain)
        alpha, logs = scan(chain.start, _steps(b, chain, True))
        likelihood = float(logs.sum() + top.sum())
        if 0 <= likelihood - last < tolerance:
            order = np.argsort(chain.means, kind="stable")
            return Chain(chain.start[order], chain.moves[np.ix_(order, order)], chain.means[order], chain.variances[order])
        last = likelihood
        back = np.swapaxes(chain.moves * b[1:][:, None, :], 1, 2)[::-1]
        beta = np.ones_like(alpha)
        if len(x) > 1:
            beta[:-1] = scan(np.full(2, 0.5), back)[0][::-1]
        state = alpha * beta
        state /= state.sum(axis=1, keepdims=True)
        pair = alpha[:-1, :, None] * chain.moves * (b[1:] * beta[1:])[:, None, :]
        moved = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        weight = state.sum(axis=0)
        if not (weight > 0).all() or not (moved.sum(axis=1) > 0).all():
            return None
        means = state.T @ x / weight
        variances = np.maximum((state * (x[:, None] - means) ** 2).sum(axis=0) / weight, least_variance)
        chain = Chain(state[0], moved / moved.sum(axis=1, keepdims=True), means, variances)
    return None
