"""Multinomial logistic regression with a quadratic penalty on the slopes, by Newton's method on the whole Hessian."""

from __future__ import annotations

import numpy as np

from .boosting import softmax


def objective(w: np.ndarray, x: np.ndarray, hot: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood and its gradient; w: (classes, 1 + columns), its first column the intercepts."""
    design = np.column_stack([np.ones(len(x)), x])
    p = softmax(design @ w.T)
    slope = w.copy()
    slope[:, 0] = 0
    return float(-(hot * np.log(np.maximum(p, 1e-300))).sum() + weight * (slope**2).sum() / 2), (p - hot).T @ design + weight * slope


def fit(x: np.ndarray, y: np.ndarray, classes: int, weight: float = 1.0, most: int = 100, tolerance: float = 1e-6) -> np.ndarray | None:
    """The coefficients, or none where Newton's steps do not bring the largest gradient below the tolerance."""
    design, hot, d = np.column_stack([np.ones(len(x)), x]), np.eye(classes)[y], x.shape[1] + 1
    w = np.zeros((classes, d))
    penalty = np.tile(np.append(0.0, np.full(d - 1, weight)), classes)
    value, gradient = objective(w, x, hot, weight)
    for _ in range(most):
        if np.abs(gradient).max() < tolerance * max(1, len(x)) ** 0.5:
            return w
        p = softmax(design @ w.T)
        hessian = np.empty((classes, d, classes, d))
        for a in range(classes):
            for b in range(classes):
                hessian[a, :, b, :] = (design * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ design
        full = hessian.reshape(classes * d, classes * d) + np.diag(penalty)
        # the intercepts may move together without effect; the least-squares step leaves that direction alone
        step = np.linalg.lstsq(full, gradient.ravel(), rcond=1e-12)[0].reshape(classes, d)
        scale = 1.0
        while scale > 1e-10:
            new = w - scale * step
            now, g = objective(new, x, hot, weight)
            if now <= value - 1e-4 * scale * float((gradient * step).sum()):
                break
            scale /= 2
        else:
            return w if np.abs(gradient).max() < 1e-3 else None
        w, value, gradient = new, now, g
    return None


def probabilities(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return softmax(np.column_stack([np.ones(len(x)), x]) @ w.T)
