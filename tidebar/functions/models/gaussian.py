"""Gaussian process regression with a squared-exponential kernel plus white noise; both scales by marginal likelihood."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bounds of the length and of the noise's variance, in units of the scaled columns and target.
BOUNDS = np.log(np.array([[1e-2, 1e2], [1e-6, 1e1]]))
BEGIN = np.log(np.array([1.0, 0.1]))
JITTER = 1e-10


@dataclass(frozen=True)
class Process:
    x: np.ndarray
    length: float
    noise: float
    lower: np.ndarray
    weights: np.ndarray
    mean: float
    scale: float


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def likelihood(theta: np.ndarray, d2: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log marginal likelihood and its gradient by (log length, log noise)."""
    length, noise = np.exp(theta)
    k = np.exp(-0.5 * d2 / length**2)
    try:
        lower = np.linalg.cholesky(k + (noise + JITTER) * np.eye(len(y)))
    except np.linalg.LinAlgError:
        return -np.inf, np.zeros(2)
    inverse_lower = np.linalg.inv(lower)
    alpha = inverse_lower.T @ (inverse_lower @ y)
    inverse = inverse_lower.T @ inverse_lower
    value = -0.5 * y @ alpha - np.log(np.diag(lower)).sum() - len(y) / 2 * np.log(2 * np.pi)
    by_length = k * d2 / length**2
    return float(value), 0.5 * np.array([alpha @ by_length @ alpha - (inverse * by_length).sum(), noise * (alpha @ alpha - np.trace(inverse))])


def fit(x: np.ndarray, y: np.ndarray, most: int = 60) -> Process:
    """x: scaled columns. A quasi-Newton ascent in two dimensions within the bounds."""
    mean, scale = y.mean(), y.std() or 1.0
    z, d2 = (y - mean) / scale, _squares(x, x)
    theta, h = BEGIN.copy(), np.eye(2)
    value, g = likelihood(theta, d2, z)
    for _ in range(most):
        free = ~(((theta <= BOUNDS[:, 0]) & (g < 0)) | ((theta >= BOUNDS[:, 1]) & (g > 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-5 * len(y):
            break
        step = np.where(free, h @ np.where(free, g, 0), 0)
        if step @ g <= 0:
            h, step = np.eye(2), np.where(free, g, 0)
        step *= min(1.0, 2.0 / np.abs(step).max())
        scale_step, moved = 1.0, False
        while scale_step > 1e-6:
            new = np.clip(theta + scale_step * step, BOUNDS[:, 0], BOUNDS[:, 1])
            now, g_new = likelihood(new, d2, z)
            if now > value:
                moved = True
                break
            scale_step /= 2
        if not moved:
            break
        s, d = new - theta, g - g_new
        if s @ d > 1e-12:
            rho, eye = 1 / (s @ d), np.eye(2)
            h = (eye - rho * np.outer(s, d)) @ h @ (eye - rho * np.outer(d, s)) + rho * np.outer(s, s)
        gained, theta, value, g = now - value, new, now, g_new
        if gained < 1e-9 * max(1.0, abs(value)):
            break
    length, noise = np.exp(theta)
    lower = np.linalg.cholesky(np.exp(-0.5 * d2 / length**2) + (noise + JITTER) * np.eye(len(z)))
    return Process(x, length, noise, lower, np.linalg.solve(lower.T, np.linalg.solve(lower, z)), mean, scale)


def predict(model: Process, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of new observations, noise included."""
    k = np.exp(-0.5 * _squares(x, model.x) / model.length**2)
    v = np.linalg.solve(model.lower, k.T)
    variance = np.maximum(1 + model.noise - (v * v).sum(axis=0), 0)
    return k @ model.weights * model.scale + model.mean, np.sqrt(variance) * model.scale
