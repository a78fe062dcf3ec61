"""Tails and quantiles of weighted sums of chi-squares."""

from __future__ import annotations

import numpy as np

from .stats import chi2_tail


def weighted_chi2_tail(q: np.ndarray | float, weights: np.ndarray, most: int = 1 << 17) -> np.ndarray | None:
    """P(sum of weights * chi-square(1) > q) for each q, by inverting the characteristic function; weights are positive.

    The integral is a sum at midpoints, whose spacing keeps the error of aliasing under 1e-9 (the part of the sum
    that lies further out than one period); its last half fades out, so that cutting it off makes no ripples. None
    if the characteristic function is still too large after `most` terms.
    """
    q, w = np.atleast_1d(np.asarray(q, float)), np.asarray(weights, float)
    if len(w) == 1 or np.ptp(w) < 1e-9 * w.max():
        return np.array([chi2_tail(x / w.max(), len(w)) for x in q])
    mean, top = w.sum(), w.max()
    far = mean + 2 * np.sqrt(2 * (w**2).sum()) + 50 * top
    step = 2 * np.pi / (max(q.max(), far) + far)
    terms = 1 << 9
    size = lambda u: np.exp(-0.25 * np.log1p(4 * np.multiply.outer(u, w) ** 2).sum(-1))
    while size(np.array([terms / 2 * step]))[0] / (terms / 2 * step * max(q.min(), top)) > 1e-7:
        terms *= 2
        if terms > most:
            return None
    total = np.zeros(len(q))
    for a in range(0, terms, 1 << 12):
        k = np.arange(a, min(a + (1 << 12), terms)) + 0.5
        u = k * step
        fade = np.where(2 * k < terms, 1.0, np.cos(np.pi * (k / terms - 0.5)) ** 2)
        phase = 0.5 * np.arctan(2 * np.multiply.outer(u, w)).sum(-1)
        total += np.sin(phase - np.multiply.outer(q, u)) @ (size(u) * fade / k)
    return np.where(q <= 0, 1.0, np.clip(0.5 + total / np.pi, 0, 1))


def chi2_quantile(tail: float, df: float) -> float:
    """The value that a chi-square exceeds with probability `tail`."""
    low, high = 0.0, max(df, 1.0)
    while chi2_tail(high, df) > tail:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_tail(middle, df) > tail else (low, middle)
    return (low + high) / 2
