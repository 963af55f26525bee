"""Tails and small solvers that the standard library lacks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail_1(x: float) -> float:
    """P(chi-squared with one degree of freedom > x)."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, 1 - (a + b) * x / (a + 1), key=abs)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1 - front * beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, n: float, m: float) -> float:
    """P(F with n and m degrees of freedom > f)."""
    return incomplete_beta(m / 2, n / 2, m / (m + n * f)) if f > 0 else 1.0


def minimise_many(fun: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], starts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, values, whether each gradient got small) of many functions at once, by quasi-Newton steps with backtracking.

    fun takes points, a row each, and which functions they are for, and gives values and gradients.
    """
    m, n = starts.shape
    x, going = np.array(starts, dtype=float), np.arange(m)
    value, g = fun(x, going)
    inverse, step, slope, t, done = np.tile(np.eye(n), (m, 1, 1)), np.zeros((m, n)), np.zeros(m), np.ones(m), np.zeros(m, dtype=int)

    def aimed(at: np.ndarray) -> np.ndarray:
        """Of these functions those that go on, each with its next step; its own step is halved while others go on."""
        at = at[np.isfinite(value[at]) & ~(np.abs(g[at]).max(1) < 1e-5 * np.maximum(1, np.abs(value[at]))) & (done[at] < rounds)]
        way = -(inverse[at] @ g[at][..., None])[..., 0]
        along = (way * g[at]).sum(1)
        if (up := ~(along < 0)).any():
            inverse[at[up]], way[up] = np.eye(n), -g[at[up]]
            along[up] = (way[up] * g[at[up]]).sum(1)
        step[at], slope[at], t[at] = way, along, 1.0
        return at

    going = aimed(going)
    while len(going):
        move = t[going, None] * step[going]
        got, slopes = fun(x[going] + move, going)
        fine = got <= value[going] + 1e-4 * t[going] * slope[going]
        short, at = going[~fine], going[fine]
        t[short] /= 2
        s, c = move[fine], slopes[fine] - g[at]
        x[at] += s
        value[at], g[at], done[at] = got[fine], slopes[fine], done[at] + 1
        scale = (s * c).sum(1)
        if (curved := scale > 1e-12).any():
            s, c, k, old = s[curved], c[curved], scale[curved][:, None, None], inverse[at[curved]]
            h = (old @ c[..., None])[..., 0]
            both = s[:, :, None] * h[:, None]
            inverse[at[curved]] = old - (both + both.transpose(0, 2, 1)) / k + (1 + (c * h).sum(1)[:, None, None] / k) * (s[:, :, None] * s[:, None]) / k
        going = np.sort(np.concatenate((short[t[short] > 1e-10], aimed(at))))
    return x, value, np.isfinite(value) & (np.abs(g).max(1) < 1e-3 * np.maximum(1, np.abs(value)))


def simplex_many(fun: Callable[[np.ndarray, np.ndarray], np.ndarray], starts: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Nelder and Mead's search, for where gradients fail, on many functions at once; fun as in minimise_many, without gradients."""
    m, n = starts.shape
    points = np.repeat(starts[:, None], n + 1, axis=1)
    points[:, 1:] += 0.1 * np.maximum(1, np.abs(starts))[:, :, None] * np.eye(n)
    values = np.stack([fun(points[:, k], np.arange(m)) for k in range(n + 1)], axis=1)
    going = np.arange(m)
    for _ in range(rounds):
        order = np.argsort(values[going], axis=1, kind="stable")
        points[going], values[going] = np.take_along_axis(points[going], order[..., None], 1), np.take_along_axis(values[going], order, 1)
        going = going[~(values[going, -1] - values[going, 0] < 1e-10 * (1 + np.abs(values[going, 0])))]
        if not len(going):
            break
        centre, worst = points[going, :-1].mean(1), points[going, -1]
        at = 2 * centre - worst
        got = fun(at, going)
        best, poor = got < values[going, 0], ~(got < values[going, -2])
        if best.any():
            further = 3 * centre[best] - 2 * worst[best]
            more = fun(further, going[best])
            better = more < got[best]
            at[np.flatnonzero(best)[better]], got[np.flatnonzero(best)[better]] = further[better], more[better]
        shrunk = np.zeros(len(going), dtype=bool)
        if poor.any():
            inner = (centre[poor] + worst[poor]) / 2
            less = fun(inner, going[poor])
            fine = less < values[going[poor], -1]
            at[poor], got[poor], shrunk[poor] = inner, less, ~fine
        kept = going[~shrunk]
        points[kept, -1], values[kept, -1] = at[~shrunk], got[~shrunk]
        if shrunk.any():
            small = going[shrunk]
            points[small, 1:] = (points[small, 1:] + points[small, :1]) / 2
            for k in range(1, n + 1):
                values[small, k] = fun(points[small, k], small)
    least = values.argmin(1)
    return points[np.arange(m), least], values[np.arange(m), least]
