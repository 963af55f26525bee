"""Seasonal-trend decomposition by loess (Cleveland, Cleveland, McRae and Terpenning, 1990)."""

from __future__ import annotations

import numpy as np


def _weights(n: int, span: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point of ``at``: the indices of its ``span`` nearest of 0..n-1 and their tricube weights."""
    q = min(span, n)
    first = np.clip(np.floor(at - (q - 1) / 2 + 0.5).astype(int), 0, n - q)
    index = first[:, None] + np.arange(q)
    away = np.abs(index - at[:, None])
    reach = away.max(1, keepdims=True) + (span - n) / 2 * (span > n)
    return index, np.where(away <= 0.999 * reach, (1 - np.clip(away / np.maximum(reach, 1e-12), 0, 1) ** 3) ** 3, 0)


def loess(y: np.ndarray, span: int, at: np.ndarray | None = None, robust: np.ndarray | None = None) -> np.ndarray:
    """Local straight lines through equally spaced y, evaluated at points of their index."""
    at = np.arange(len(y), dtype=float) if at is None else at
    index, w = _weights(len(y), span, at)
    if robust is not None:
        w = w * robust[index]
    total = w.sum(1, keepdims=True)
    w = np.where(total > 0, w / np.where(total > 0, total, 1), 1 / w.shape[1])
    centre = (w * index).sum(1, keepdims=True)
    off = index - centre
    spread = (w * off**2).sum(1, keepdims=True)
    line = np.where(spread > 1e-6 * len(y) ** 2 / 1e3, 1 + (at[:, None] - centre) * off / np.where(spread > 0, spread, 1), 1)
    return (w * line * y[index]).sum(1)


def _average(y: np.ndarray, width: int) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(y)))
    return (sums[width:] - sums[:-width]) / width


def odd(x: float) -> int:
    k = int(np.ceil(x))
    return k + 1 - k % 2


def decompose(y: np.ndarray, period: int = 12, seasonal: int = 11, trend: int | None = None, outer: int = 15, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seasonal, trend, residual), which add up to y exactly."""
    n, low = len(y), odd(period)
    trend = trend or odd(max(13, 1.5 * period / (1 - 1.5 / seasonal)))
    if n < 2 * period:
        raise ValueError("a series of two periods at least is needed")
    t, s, robust = np.zeros(n), np.zeros(n), None
    for round_ in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                part = (y - t)[k::period]
                weights = None if robust is None else robust[k::period]
                cycle[k::period][: len(part) + 2] = loess(part, seasonal, np.arange(-1, len(part) + 1, dtype=float), weights)
            smooth = loess(_average(_average(_average(cycle, period), period), 3), low)
            s = cycle[period : period + n] - smooth[:n]
            t = loess(y - s, trend, robust=robust)
        if round_ == outer:
            break
        away = np.abs(y - s - t)
        scale = 6 * np.median(away)
        if scale <= 0:
            break
        u = np.clip(away / scale, 0, 1)
        robust = np.where(u <= 0.001, 1, np.where(u >= 0.999, 0, (1 - u**2) ** 2))
    return s, t, y - s - t
