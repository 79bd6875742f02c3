"""A linear support vector machine for samples that fit in memory."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300,
        weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; squared hinge, classes of equal total weight, accelerated gradient steps. y is +1 or -1."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale = np.where(scale > 1e-12, scale, np.inf) * np.sqrt(x.shape[1])
    z = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.divide(x - mean.astype(np.float32), scale.astype(np.float32), out=z[:, :-1], casting="unsafe")
    share = np.ones(len(y)) if weight is None else weight
    share = np.where(y > 0, share / max(1, share[y > 0].sum()), share / max(1, share[y < 0].sum())).astype(np.float32) / 2
    # w stays a sum of rows, z.T @ a: with fewer rows than columns the same steps are taken on a, by the rows' products
    few = len(z) < z.shape[1]
    product = z @ z.T if few else None
    times = (lambda a: product @ a) if few else (lambda w: z @ w)
    back = (lambda g: g) if few else (lambda g: z.T @ g)
    root = np.sqrt(share)
    v = np.ones(len(z), np.float32)
    for _ in range(21):
        v = root * (product @ (root * v) if few else z @ (z.T @ (root * v)))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-30)
    rate = 1 / (2 * top * 1.1 + penalty)
    w = ahead = np.zeros(len(z) if few else z.shape[1], np.float32)
    for i in range(steps):
        slack = np.maximum(0, 1 - y * times(ahead))
        new = ahead - rate * (penalty * ahead - 2 * back(share * y * slack))
        ahead = new + (i / (i + 3)) * (new - w)
        w = new
    w = z.T @ w if few else w
    weights = w[:-1] / scale
    return weights.astype(np.float64), float(w[-1] - weights @ mean)


def squash(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
