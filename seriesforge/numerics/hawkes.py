"""Two kinds of events that excite themselves and each other with exponential memory."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .special import chi2_tail_1, minimise_many


def radius(alpha: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(alpha)).max())


def loss(mu: np.ndarray, alpha: np.ndarray, beta: np.ndarray, t: np.ndarray, kind: np.ndarray, start: float, end: float) -> float:
    """Negative log-likelihood. An entity's events are few, so all earlier ones are summed at once."""
    since = t[:, None] - t[None]
    a, b = alpha[kind[:, None], kind[None]], beta[kind[:, None], kind[None]]
    earlier = since > 0  # events at one time don't excite each other
    excited = (a * b * np.exp(-b * np.where(earlier, since, 0)) * earlier).sum(1)
    left = end - t
    integral = mu.sum() * (end - start) + float((alpha[:, kind] * (1 - np.exp(-beta[:, kind] * left))).sum())
    return float(integral - np.log(np.maximum(mu[kind] + excited, 1e-12)).sum())


class Events:
    """Events of many entities by their distinct times: counts of both kinds, padded with times without any at the end."""

    def __init__(self, times: Sequence[np.ndarray], kinds: Sequence[np.ndarray], starts: Sequence[float], ends: Sequence[float]):
        each = [np.unique(t, return_inverse=True) for t in times]
        size, m = max(len(u) for u, _ in each), len(each)
        self.counts, at = np.zeros((size, 2, m)), np.empty((size + 1, m))
        for k, ((u, place), kind) in enumerate(zip(each, kinds)):
            np.add.at(self.counts[:, :, k], (place, kind), 1.0)
            at[: len(u), k], at[len(u) :, k] = u, ends[k]
        self.gaps, self.span = np.diff(at, axis=0), np.asarray(ends, dtype=float) - np.asarray(starts, dtype=float)
        self.totals = self.counts.sum(0)

    def loss(self, p: np.ndarray, which: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(negative log-likelihoods, their slopes in base rates, excitation and decay); p: rows of the ten parameters of entity which.

        Sums over earlier events come from one time to the next, as their memory is exponential; events at one time don't
        excite each other.  Sums and slopes are [target, source, entity].
        """
        mu, alpha, beta = unpack_many(p, free)
        counts, gaps, totals, span = self.counts[:, :, which], self.gaps[:, which], self.totals[:, which], self.span[which]
        weight, kept, aged = alpha * beta, np.zeros(alpha.shape), np.zeros(alpha.shape)
        log_sum, to_mu, to_alpha, to_beta = np.zeros(len(p)), np.zeros(mu.shape), np.zeros(alpha.shape), np.zeros(alpha.shape)
        for now, gap in zip(counts, gaps):
            rate = mu + (weight * kept).sum(1)
            seen = rate > 1e-12
            share = np.where(seen, now / np.maximum(rate, 1e-12), 0.0)
            log_sum += (now * np.log(np.maximum(rate, 1e-12))).sum(0)
            to_mu += share
            to_alpha += share[:, None] * beta * kept
            to_beta += share[:, None] * alpha * (kept - beta * aged)
            kept = kept + now[None]
            fade = np.exp(-beta * gap)
            aged, kept = fade * (aged + gap * kept), fade * kept
        spent = totals[None] - kept  # of each source's events, by the end
        value = mu.sum(0) * span + (alpha * spent).sum((0, 1)) - log_sum
        return value, span - to_mu, spent - to_alpha, alpha * aged - to_beta


def unpack_many(p: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base rates, excitation, decay) from rows of unbounded parameters; excitation and decay are [target, source, row], excitation 0 where not free."""
    positive = np.logaddexp(0, p).T
    return positive[:2], positive[2:6].reshape(2, 2, -1) * free, positive[6:10].reshape(2, 2, -1) + 1e-3


def radii(alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectral radii of [target, source, row], which has no negative entries, and their slopes in it."""
    (a, b), (c, d) = alpha
    half = (a - d) / 2
    spread = np.sqrt(half * half + b * c)
    twice = 2 * np.maximum(spread, 1e-12)
    return (a + d) / 2 + spread, np.array([[0.5 + half / twice, c / twice], [b / twice, 0.5 - half / twice]])


#: What a fit may not have: one way of excitation (target, source), or nothing.
CLOSED = (None, (1, 0), (0, 1))


def fit_many(times: Sequence[np.ndarray], kinds: Sequence[np.ndarray], starts: Sequence[float], ends: Sequence[float], closed: Sequence[tuple[int, int] | None] = CLOSED) -> list[list[dict]]:
    """For each entity the likeliest process with each way of excitation closed that is asked for.

    Entities with about as many events, within a factor of two, are searched at once.  The search pays for excitation
    that feeds itself, which is no part of the likelihood.
    """
    alike: dict[int, list[int]] = {}
    for k, t in enumerate(times):
        alike.setdefault(len(t).bit_length(), []).append(k)
    out: list = [None] * len(times)
    for members in alike.values():
        for k, found in zip(members, _fit_alike(*([x[k] for k in members] for x in (times, kinds, starts, ends)), closed)):
            out[k] = found
    return out


def _fit_alike(times: list, kinds: list, starts: list, ends: list, closed: Sequence[tuple[int, int] | None]) -> list[list[dict]]:
    events, m = Events(times, kinds, starts, ends), len(times)
    free = np.ones((2, 2, len(closed), m))
    for k, way in enumerate(closed):
        if way is not None:
            free[way][k] = 0.0
    free, entity = free.reshape(2, 2, -1), np.tile(np.arange(m), len(closed))
    inverse = lambda x: np.log(np.expm1(np.maximum(x, 1e-3)))
    base = events.totals / np.maximum(events.span, 1e-9)
    p = np.concatenate((inverse(base * 0.7).T[entity], np.full((len(entity), 4), inverse(0.1)), np.full((len(entity), 4), inverse(2.0))), axis=1)

    def fun(p: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, to_mu, to_alpha, to_beta = events.loss(p, entity[which], free[:, :, which])
        r, slope = radii(unpack_many(p, free[:, :, which])[1])
        over = np.maximum(0.0, r - 0.98)
        to_alpha = (to_alpha + 2e3 * over * slope) * free[:, :, which]
        slopes = np.concatenate((to_mu, to_alpha.reshape(4, -1), to_beta.reshape(4, -1))).T
        return value + 1e3 * over**2, slopes * np.exp(-np.logaddexp(0, -p))

    p, _, fine = minimise_many(fun, p, 60)
    (mu, alpha, beta), value = unpack_many(p, free), events.loss(p, entity, free)[0]
    found = [{"mu": mu[:, k], "alpha": alpha[:, :, k], "beta": beta[:, :, k], "loss": float(value[k]), "converged": bool(fine[k]), "radius": radius(alpha[:, :, k])} for k in range(len(entity))]
    return [found[k::m] for k in range(m)]


def fit(t: np.ndarray, kind: np.ndarray, start: float, end: float, closed: tuple[int, int] | None = None) -> dict:
    """The likeliest process; with one way of excitation (target, source) closed if asked."""
    return fit_many([t], [kind], [start], [end], [closed])[0][0]


def likelihood_ratio(full: dict, restricted: dict) -> tuple[float, float]:
    """(statistic, p) for one way of excitation."""
    statistic = max(0.0, 2 * (restricted["loss"] - full["loss"]))
    return statistic, chi2_tail_1(statistic)


def intensities(model: dict, t: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, self-excited, cross-excited) rates of both kinds at times; events at a time don't count for it."""
    own, cross = np.zeros((len(at), 2)), np.zeros((len(at), 2))
    since = at[:, None] - t[None]
    for target in (0, 1):
        for source in (0, 1):
            a, b = model["alpha"][target, source], model["beta"][target, source]
            seen = (since > 0) & (kind == source)[None]
            part = (a * b * np.exp(-b * np.where(seen, since, 0)) * seen).sum(1)
            (own if target == source else cross)[:, target] += part
    return np.tile(model["mu"], (len(at), 1)), own, cross
