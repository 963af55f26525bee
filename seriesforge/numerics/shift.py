"""Structural shifts of a series: scans for breaks of the mean with autocorrelation-robust variance."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .special import f_tail

# Results must agree on them.
LEVEL = 0.05
LAG = 12
LEAST_SEGMENT = 24
DOMINANCE = 0.3
FIRST_CRITICAL = 8.88
SECOND_CRITICAL = 9.91


class Break(NamedTuple):
    index: int | None
    stat: float
    p: float

    def found(self, critical: float) -> bool:
        return self.index is not None and (self.stat >= critical or self.p <= LEVEL)


NONE = Break(None, 0.0, 1.0)


def long_run_variance(rest: np.ndarray, lag: int) -> np.ndarray:
    """Bartlett-weighted variance of each row of residuals."""
    rest = rest - rest.mean(1, keepdims=True)
    n = rest.shape[1]
    total = (rest * rest).mean(1)
    if lag <= 0:
        return total
    lag = min(lag, n - 1)
    for k in range(1, lag + 1):
        total = total + 2 * (1 - k / (lag + 1)) * (rest[:, k:] * rest[:, :-k]).mean(1)
    return np.maximum(total, 1e-12)


def break_scan(v: np.ndarray, segment: int, lag: int) -> Break:
    """The split into two means, each of ``segment`` values at least, with the largest gain over the robust variance."""
    n = len(v)
    if n < 2 * segment + 1:
        return NONE
    split = np.arange(segment, n - segment + 1)
    sums = np.cumsum(v)
    before, after = sums[split - 1] / split, (sums[-1] - sums[split - 1]) / (n - split)
    gain = np.maximum((before - after) ** 2 * split * (n - split) / n, 0.0)
    rest = v - np.where(np.arange(n) < split[:, None], before[:, None], after[:, None])
    stats = gain / np.maximum(long_run_variance(rest, lag) * n, 1e-12)
    best = int(np.argmax(stats))
    if not stats[best] > 0:
        return NONE
    return Break(int(split[best]), float(stats[best]), f_tail(float(stats[best]), 1, max(n - 2 * segment - 1, 1)))


def second_break(v: np.ndarray, at: int, segment: int, lag: int) -> Break:
    """The stronger of the breaks on both sides of a first one; of equal ones that on the left."""
    left, right = break_scan(v[:at], segment, lag), break_scan(v[at:], segment, lag)
    if left.stat >= right.stat:
        return left
    return right._replace(index=right.index + at)


def alternates(v: np.ndarray, segment: int) -> bool:
    """Whether the series crosses its median twice or more, with enough values on both sides of it."""
    if len(v) < 2 * segment + 1:
        return False
    high = v >= np.median(v)
    return int((high[1:] != high[:-1]).sum()) >= 2 and min(int(high.sum()), int((~high).sum())) >= segment


def seasonal_part(v: np.ndarray, months: np.ndarray) -> tuple[np.ndarray, float]:
    """(means of the calendar months less the mean of all, their share of the variance: 0 where a month is there once)."""
    which, counts = np.unique(months, return_inverse=True, return_counts=True)[1:]
    part = (np.bincount(which, v) / counts)[which] - v.mean()
    return part, float(part.var() / v.var()) if counts.min() >= 2 and v.var() > 0 else 0.0


def classify(v: np.ndarray, months: np.ndarray) -> dict:
    """stable, degraded (one break) or intermittent (a second one beside it, or a series that keeps crossing its median)."""
    part, dominance = seasonal_part(v, months)
    working = v - part if dominance > DOMINANCE else v
    lag, segment = max(0, min(LAG, len(v) // 4)), max(1, min(LEAST_SEGMENT, len(v) // 2))
    first, second, label = break_scan(working, segment, lag), NONE, "stable"
    if first.found(FIRST_CRITICAL):
        second = second_break(working, first.index, segment, lag)
        label = "intermittent" if second.stat >= SECOND_CRITICAL or second.p <= LEVEL else "degraded"
    elif alternates(working, segment):
        label = "intermittent"
    return {"label": label, "first": first, "second": second, "dominance": dominance}
