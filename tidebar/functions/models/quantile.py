"""Linear quantile regression with an absolute penalty on the slopes, solved as a bounded linear program.

The penalty is n more observations of a kind: alpha n |w| is the check loss at one half of a row with response 0 and 2 alpha n in the
column of w. What remains is: minimise the sum of tau u+ + (1 - tau) u- with a tau for each row. Its dual has one number between 0
and 1 a row and as many equations as coefficients, and a primal-dual interior-point method with Mehrotra's corrector solves it in
some twenty steps, each of which solves a system as small as the number of coefficients. The answer then moves to the vertex it is
next to: the plane through as many rows as there are coefficients.
"""

from __future__ import annotations

import numpy as np


def rows_of_penalty(x: np.ndarray, y: np.ndarray, tau: float, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Design with intercept, responses and taus, the penalty's rows last."""
    n, d = x.shape
    design = np.vstack([np.column_stack([np.ones(n), x]), np.column_stack([np.zeros(d), 2 * alpha * n * np.eye(d)])])
    return design, np.append(y, np.zeros(d)), np.append(np.full(n, tau), np.full(d, 0.5))


def loss(b: np.ndarray, design: np.ndarray, y: np.ndarray, tau: np.ndarray) -> float:
    u = y - design @ b
    return float(np.maximum(tau * u, (tau - 1) * u).sum())


def fit(x: np.ndarray, y: np.ndarray, tau: float, alpha: float = 0.01, most: int = 80) -> np.ndarray:
    """Intercept and slopes."""
    keep = np.ones(x.shape[1], bool) if alpha > 0 else x.std(axis=0) > 0
    design, response, taus = rows_of_penalty(x[:, keep], y, tau, alpha)
    size = np.abs(y).max() or 1.0
    b = _interior(design, response / size, taus, most) * size
    b = _vertex(b, design, response, taus)
    out = np.zeros(x.shape[1] + 1)
    out[np.flatnonzero(np.append(True, keep))] = b
    return out


def _interior(design: np.ndarray, y: np.ndarray, tau: np.ndarray, most: int) -> np.ndarray:
    # dual: maximise y'a with design'a = design'(1 - tau), 0 <= a <= 1; s = 1 - a, z and w the multipliers of both bounds
    a, target = 1 - tau, design.T @ (1 - tau)
    s = 1 - a
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    r = y - design @ b
    z, w = np.maximum(-r, 0) + 0.1, np.maximum(r, 0) + 0.1
    for _ in range(most):
        gap = float(a @ z + s @ w)
        if gap < 1e-12 * len(y):
            break
        primal = target - design.T @ a
        dual = y - design @ b - w + z

        def direction(az: np.ndarray, sw: np.ndarray):
            # az, sw: what a z and s w shall change by
            q = 1 / (z / a + w / s)
            side = dual - sw / s + az / a
            db = np.linalg.solve((design * q[:, None]).T @ design + 1e-14 * np.eye(design.shape[1]), design.T @ (q * side) - primal)
            da = q * (side - design @ db)
            return da, db, (az - z * da) / a, (sw + w * da) / s

        def reach(v: np.ndarray, dv: np.ndarray) -> float:
            low = dv < 0
            return float(min(1.0, (-v[low] / dv[low]).min())) if low.any() else 1.0

        da, db, dz, dw = direction(-a * z, -s * w)
        p, d = min(reach(a, da), reach(s, -da)), min(reach(z, dz), reach(w, dw))
        after = float((a + p * da) @ (z + d * dz) + (s - p * da) @ (w + d * dw))
        mu = gap / (2 * len(y)) * (after / gap) ** 3
        da, db, dz, dw = direction(mu - a * z - da * dz, mu - s * w + da * dw)
        p, d = (min(1.0, 0.9995 * min(reach(a, da), reach(s, -da))), min(1.0, 0.9995 * min(reach(z, dz), reach(w, dw))))
        a, s, b, z, w = a + p * da, s - p * da, b + d * db, z + d * dz, w + d * dw
    return b


def _vertex(b: np.ndarray, design: np.ndarray, y: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """The plane through the rows with the smallest residuals that are independent, if that is no worse."""
    chosen: list[int] = []
    for i in np.argsort(np.abs(y - design @ b), kind="stable"):
        if np.linalg.matrix_rank(design[[*chosen, i]], tol=1e-10) > len(chosen):
            chosen.append(int(i))
        if len(chosen) == design.shape[1]:
            break
    if len(chosen) < design.shape[1]:
        return b
    there = np.linalg.solve(design[chosen], y[chosen])
    return there if loss(there, design, y, tau) <= loss(b, design, y, tau) else b
