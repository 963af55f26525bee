"""Extreme-value fits: generalised Pareto tails, probability-weighted moments with maximum cross-entropy
quantiles, seasonal point processes of exceedances, and their return levels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from .special import minimise_many

#: Processes whose grids are worked on at a time: their intermediate results stay in a core's cache.
BLOCK = 128
#: Processes of a grid from which on they are worked on as one matrix.
SHARED = 32
#: Largest shape of a process, either way.
WIDEST = 0.95
#: Mean excess, over the values' deviation, up to which a threshold goes through the events: a searched line is not exact.
ON_LINE = 1e-6

# -- generalised Pareto --------------------------------------------------------------------


def pareto_fits(excesses: Sequence[np.ndarray]) -> list[tuple[float, float, bool]]:
    """(shape, scale, converged) of the likeliest Pareto tail of each: Grimshaw's profile over one parameter."""
    samples = [np.asarray(x, dtype=float) for x in excesses]
    samples = [x[np.isfinite(x)] for x in samples]
    out: list = [(math.nan, math.nan, False)] * len(samples)
    alike: dict[int, list[int]] = {}
    for k, x in enumerate(samples):
        if not (len(x) < 3 or x.min() < 0 or x.max() <= 0):
            alike.setdefault(len(x), []).append(k)
    for size, members in alike.items():
        together = max(1, 8192 // size)
        for k in range(0, len(members), together):
            some = members[k : k + together]
            for j, fit in zip(some, _pareto_fits(np.stack([samples[j] for j in some]))):
                out[j] = fit
    return out


def _pareto_fits(x: np.ndarray) -> list[tuple[float, float, bool]]:
    n, every = x.shape[1], np.arange(len(x))

    def profile(theta: np.ndarray) -> np.ndarray:
        inside = 1 + theta[..., None] * x[:, None]
        shape = np.log(np.maximum(inside, 1e-300)).mean(2)
        with np.errstate(all="ignore"):
            value = -n * (np.log(np.maximum(shape / theta, 1e-300)) + shape + 1)
            return np.where((inside.min(2) > 0) & (shape / theta > 0) & (np.abs(theta) > 1e-12), value, -np.inf)

    low, mean = -1 / x.max(1)[:, None], x.mean(1)
    grid = np.concatenate((low + np.geomspace(1e-6, 0.99, 200) * -low, np.geomspace(1e-6, 50, 200) / mean[:, None]), axis=1)
    for _ in range(4):
        best = profile(grid).argmax(1)
        grid = np.linspace(grid[every, np.maximum(0, best - 1)], grid[every, np.minimum(grid.shape[1] - 1, best + 1)], 201, axis=1)
    values = profile(grid)
    best = values.argmax(1)
    theta = grid[every, best]
    better = values[every, best] > -n * (np.log(mean) + 1)
    shape = np.where(better, np.log1p(np.where(better, theta, 0.0)[:, None] * x).mean(1), 0.0)
    scale = np.where(better, shape / np.where(better, theta, 1.0), mean)
    return [(float(a), float(b), True) for a, b in zip(shape, scale)]


def pareto_fit(excess: np.ndarray) -> tuple[float, float, bool]:
    """One sample's tail."""
    return pareto_fits([excess])[0]


def return_level(u: float, scale: float, shape: float, period: float, exceedances: int, n: int) -> float:
    rate = period * exceedances / n
    if rate <= 1:
        return u
    return u + scale * math.log(rate) if abs(shape) < 1e-8 else u + scale / shape * (rate**shape - 1)


# -- probability-weighted moments and cross-entropy ----------------------------------------


def moments(z: np.ndarray, k: int = 4) -> np.ndarray:
    """b_0..b_k of a sample, unbiased."""
    z, n = np.sort(z), len(z)
    i, w, out = np.arange(n, dtype=float), np.ones(n), []
    for j in range(k + 1):
        out.append(float((w * z).mean()))
        w = w * (i - j) / max(1, n - 1 - j)
    return np.array(out)


def _nodes(n: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre on (0, 1) after u = 1 - exp(-s), s in (0, 23): the quantile has a logarithm at 1."""
    x, w = np.polynomial.legendre.leggauss(n)
    s = (x + 1) / 2 * 23.0
    return 1 - np.exp(-s), w / 2 * 23.0 * np.exp(-s)


_U, _W = _nodes()


def prior(u: np.ndarray, epsilon: float) -> np.ndarray:
    """Quantile of the shifted exponential of mean 1 that serves as prior."""
    return epsilon - (1 - epsilon) * np.log(np.maximum(1 - u, 1e-300))


def cross_entropy_quantile(u: np.ndarray, epsilon: float, lambdas: np.ndarray) -> np.ndarray:
    return prior(u, epsilon) * np.exp(-np.polynomial.polynomial.polyval(u, lambdas))


def cross_entropy_fit(b: np.ndarray, epsilon: float, bound: float = 100.0, rounds: int = 200) -> tuple[np.ndarray, float, bool]:
    """(multipliers, objective, converged): damped Gauss-Newton on the moments' residuals with a small ridge."""
    k = len(b)
    powers = _U[None] ** np.arange(k)[:, None]
    base, lam, damp = prior(_U, epsilon) * _W, np.zeros(k), 1e-2

    def state(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        x = base * np.exp(np.clip(-(lam @ powers), -60, 60))
        r = powers @ x - b
        return r, x, float(r @ r + 1e-6 * lam @ lam)

    r, x, value = state(lam)
    for _ in range(rounds):
        jacobian = -(powers * x) @ powers.T
        left = jacobian.T @ jacobian + 1e-6 * np.eye(k)
        step = -np.linalg.solve(left + damp * np.diag(np.diag(left)), jacobian.T @ r + 1e-6 * lam)
        new = np.clip(lam + step, -bound, bound)
        found = state(new)
        if found[2] < value:
            done = value - found[2] < 1e-14 * (1 + value)
            lam, (r, x, value), damp = new, found, max(damp / 4, 1e-12)
            if done:
                break
        elif (damp := damp * 4) > 1e10:
            break
    slope = -(powers * x) @ powers.T @ r * 2 + 2e-6 * lam
    return lam, value, bool(np.isfinite(value) and np.abs(slope).max() < 1e-4)


def cross_entropy_moments(lam: np.ndarray, epsilon: float, k: int) -> np.ndarray:
    """The first k moments, integrals of u**j x(u), that a fit holds."""
    return (_U[None] ** np.arange(k)[:, None]) @ (cross_entropy_quantile(_U, epsilon, lam) * _W)


# -- seasonal point process of exceedances -------------------------------------------------


def design(t: np.ndarray, harmonics: int = 1) -> np.ndarray:
    """Columns 1, t, sin, cos, ... of a seasonal line; t in years."""
    waves = [f(2 * np.pi * h * t) for h in range(1, harmonics + 1) for f in (np.sin, np.cos)]
    return np.stack([np.ones_like(t), t, *waves], axis=1)


def choose_harmonics(t: np.ndarray, v: np.ndarray, criterion: str = "aic", most: int = 3) -> tuple[int, float]:
    """(harmonics of the seasonal line with the least information criterion, its error over the values' deviation)."""
    n, found = len(v), []
    if n < 3:
        raise ValueError("too few observations to choose a seasonal line")
    for h in range(1, most + 1):
        x = design(t, h)
        if n <= x.shape[1]:
            break
        rest = v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
        error = max(float(rest @ rest) / n, np.finfo(float).tiny)
        found.append((n * math.log(error) + x.shape[1] * {"aic": 2.0, "bic": math.log(n)}[criterion], h, math.sqrt(error)))
    if not found:
        raise ValueError("too few observations for one harmonic")
    _, h, error = min(found)
    return h, error / (float(np.std(v, ddof=1)) or 1.0)


def held(t: np.ndarray, runs: Sequence[tuple[float, float]]) -> np.ndarray:
    """Times inside a run (start, end) moved to its start: a line evaluated there is constant over the run."""
    t = np.asarray(t, dtype=float)
    out = t.copy()
    for start, end in runs:
        out[(t >= start - 1e-10) & (t < end - 1e-10)] = start
    return out


def quantile_lines(x: np.ndarray, v: np.ndarray, known: np.ndarray, q: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Coefficients of the lines with shares q of the known values below them: least pinball loss by reweighted squares.

    x: [series, value, column]; v and known: [series, value].
    """
    # on uncorrelated columns, with one correction of each solution; what depends on other columns is left out
    _, size, turn = np.linalg.svd(x * known[..., None], full_matrices=False)
    dead = size <= size[:, :1] * np.finfo(float).eps * max(x.shape[1:])
    mixed = turn.transpose(0, 2, 1) * np.where(dead, 0.0, 1 / np.where(dead, 1.0, size))[:, None]
    x, n = (x * known[..., None]) @ mixed, known.sum(1)
    v = np.where(known, v, 0.0)
    mean = v.sum(1) / n
    scale = np.maximum(np.sqrt((known * (v - mean[:, None]) ** 2).sum(1) / n), 1e-12)
    q, beta = q[:, None], (x.transpose(0, 2, 1) @ v[..., None])[..., 0]
    for k in range(rounds):
        rest = v - (x @ beta[..., None])[..., 0]
        w = known * np.where(rest >= 0, q, 1 - q) / np.maximum(np.abs(rest), scale[:, None] * 10 ** (-1 - 5 * k / rounds))
        across = (x * w[..., None]).transpose(0, 2, 1)
        square = np.linalg.inv(across @ x + dead[..., None] * np.eye(x.shape[2]))
        for _ in range(2):
            beta = beta + (square @ (across @ (v - (x @ beta[..., None])[..., 0])[..., None]))[..., 0]
    return (mixed @ beta[..., None])[..., 0]


def quantile_line(t: np.ndarray, v: np.ndarray, q: float, harmonics: int = 1, rounds: int = 60) -> np.ndarray:
    """Coefficients of the seasonal line with a share q below it."""
    return quantile_lines(design(t, harmonics)[None], v[None], np.ones((1, len(v))), np.array([q]), rounds)[0]


class Processes:
    """Negative log-likelihoods of many series' exceedances and their slopes; location design @ beta, scale exp, shape.

    A point is a row beta..., logarithm of scale, shape.  grid, u_grid and width: an even grid's design, threshold and
    trapezoid weights; events, v and there: the exceedances' design and values, and which of the padded ones there are.
    Grids are one for each place, which series share.
    """

    def __init__(self, grid: np.ndarray, place: np.ndarray, u_grid: np.ndarray, width: np.ndarray, events: np.ndarray, v: np.ndarray, there: np.ndarray):
        self.grid, self.place, self.u_grid, self.width, self.events, self.v, self.there = grid, place, u_grid, width, events, v, there

    def loss(self, p: np.ndarray, which: np.ndarray, slopes: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Values, 1e10 where an exceedance or a level is impossible, and slopes (0 there)."""
        held = np.flatnonzero(self._held(p, which))
        if len(held) < len(p):  # half of a search's points: their grids needn't be looked at
            value, slope = np.full(len(p), 1e10), np.zeros(p.shape if slopes else len(p))
            if len(held):
                value[held], some = self._values(p[held], which[held], slopes)
                slope[held] = some
        else:
            value, slope = self._values(p, which, slopes)
        return value, slope if slopes else value

    def _held(self, p: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether no exceedance is impossible."""
        with np.errstate(all="ignore"):
            z = self.there[which] * (self.v[which] - (self.events[which] @ p[:, :-2, None])[..., 0]) / np.exp(np.clip(p[:, -2:-1], -50, 50))
            return (np.abs(p[:, -1]) < 1e-6) | ((1 + p[:, -1:] * z).min(1) > 0)

    def _values(self, p: np.ndarray, which: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray]:
        place = self.place[which]
        cuts = np.flatnonzero(np.diff(place)) + 1
        if SHARED * len(cuts) >= len(p):  # few of them share a grid
            cuts = np.empty(0, dtype=int)
        ends = [0, *cuts.tolist(), len(p)]
        value, slope = np.empty(len(p)), np.empty(p.shape if slopes else len(p))
        with np.errstate(all="ignore"):
            for begin, end in zip(ends, ends[1:]):
                for k in range(begin, end, BLOCK):
                    block = slice(k, min(k + BLOCK, end))
                    grid = self.grid[place[block]] if not len(cuts) and len(ends) == 2 and place[0] != place[-1] else self.grid[place[k]]
                    self._loss(p[block], which[block], grid, value[block], slope[block] if slopes else None)
        return value, slope if slopes else value

    def _loss(self, p: np.ndarray, which: np.ndarray, grid: np.ndarray, value: np.ndarray, slope: np.ndarray | None) -> None:
        """Puts both in; grid: of each, or of all.  Sums over a grid are of powers w of a = 1 + shape z; w z / a is (w - w / a) / shape."""
        level = np.abs(p[:, -1]) < 1e-6
        if level.any() and not level.all():
            for some in (np.flatnonzero(level), np.flatnonzero(~level)):
                v, g = np.empty(len(some)), None if slope is None else np.empty((len(some), p.shape[1]))
                self._loss(p[some], which[some], grid[some] if grid.ndim == 3 else grid, v, g)
                value[some] = v
                if slope is not None:
                    slope[some] = g
            return
        level, events, width, there = level.all(), self.events[which], self.width[which], self.there[which]
        beta, log, shape = p[:, :-2], np.clip(p[:, -2], -50, 50), p[:, -1]
        sigma, n = np.exp(log), there.sum(1)
        across = (lambda w: w @ grid) if grid.ndim == 2 else (lambda w: (w[:, None] @ grid)[:, 0])
        z = there * (self.v[which] - (events @ beta[..., None])[..., 0]) / sigma[:, None]
        w = beta @ grid.T if grid.ndim == 2 else (grid @ beta[..., None])[..., 0]
        np.subtract(self.u_grid[which], w, out=w)
        possible = None
        if level:
            w *= (-1 / sigma)[:, None]
            np.clip(w, -700, 700, out=w)
            power = np.exp(w)
        else:
            w *= (shape / sigma)[:, None]
            w += 1
            b = 1 + shape[:, None] * z
            possible = (w.min(1) > 0) & (b.min(1) > 0)
            lines = np.log(w)
            power = lines * (-1 / shape)[:, None]
            np.exp(power, out=power)
        power[:, [0, -1]] /= 2
        total = power.sum(1) * width
        if level:
            out = total + z.sum(1) + n * log
        else:
            log_b = np.log(b)
            out = total + (1 + 1 / shape) * log_b.sum(1) + n * log
        possible = np.isfinite(out) if possible is None else possible & np.isfinite(out)
        value[:] = np.where(possible, out, 1e10)
        if slope is None:
            return
        if level:
            by_z = there
            slope[:, :-2] = across(power) * width[:, None]
            power *= w
            slope[:, -2] = -power.sum(1) * width - z.sum(1) + n
            slope[:, -1] = (power * w).sum(1) * width / 2 + (z - z**2 / 2).sum(1)
        else:
            bent = np.einsum("ij,ij->i", power, lines) * width
            power /= w
            less = (total - power.sum(1) * width) / shape
            by_z = there * (1 + shape[:, None]) / b
            slope[:, :-2] = across(power) * width[:, None]
            slope[:, -2] = less - (by_z * z).sum(1) + n
            slope[:, -1] = bent / shape**2 - less / shape + ((1 + 1 / shape)[:, None] * z / b - log_b / (shape**2)[:, None]).sum(1)
        slope[:, :-2] -= (by_z[:, None] @ events)[:, 0]
        slope[:, :-2] /= sigma[:, None]
        slope[~(possible[:, None] & np.isfinite(slope))] = 0.0


def rate_lines(grids: np.ndarray, place: np.ndarray, width: np.ndarray, sums: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Coefficients of the lines of a rate's logarithm that are likeliest for n events whose design rows have these sums: Newton's steps, halved where they don't lower the loss.

    The loss is convex.  Where it has no least value but falls towards one without end, a line far enough out to be level.
    """

    def state(gamma: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, slope, curve = np.empty(len(which)), np.empty(gamma.shape), np.empty((*gamma.shape, gamma.shape[1]))
        for k in range(0, len(which), BLOCK):
            some = which[k : k + BLOCK]
            x = grids[place[some]]
            power = np.exp(np.clip((x @ gamma[k : k + BLOCK, :, None])[..., 0], -700, 700)) * width[some, None]
            power[:, [0, -1]] /= 2
            weighted = x * power[..., None]
            value[k : k + BLOCK] = power.sum(1) - (gamma[k : k + BLOCK] * sums[some]).sum(1)
            slope[k : k + BLOCK] = weighted.sum(1) - sums[some]
            curve[k : k + BLOCK] = weighted.transpose(0, 2, 1) @ x
        return value, slope, curve

    gamma, left = np.zeros(sums.shape), np.arange(len(sums))
    gamma[:, 0] = np.log(n / (width * (grids.shape[1] - 1))) / grids[place, 0, 0]  # a constant rate
    value, slope, curve = state(gamma, left)
    t, ridge = np.ones(len(sums)), 1e-12 * np.eye(sums.shape[1])
    for _ in range(rounds):
        left = left[(np.abs(slope[left]).max(1) > 1e-11 * np.maximum(1, n[left])) & (t[left] > 1e-10)]
        if not len(left):
            break
        step = -np.linalg.solve(curve[left] + ridge * n[left, None, None], slope[left][..., None])[..., 0]
        new = gamma[left] + t[left, None] * step
        got, slopes, curves = state(new, left)
        lower = got <= value[left] + 1e-4 * t[left] * (step * slope[left]).sum(1) + 1e-13 * np.abs(value[left])
        at = left[lower]
        gamma[at], value[at], slope[at], curve[at] = new[lower], got[lower], slopes[lower], curves[lower]
        t[left] = np.where(lower, 1.0, t[left] / 2)
    return gamma


def process_fits(times: Sequence[np.ndarray], values: Sequence[np.ndarray], event_times: Sequence[np.ndarray], event_values: Sequence[np.ndarray], lines: Sequence[np.ndarray], points: int = 256, harmonics: int = 1, runs: Sequence[Sequence[tuple[float, float]]] | None = None, spreads: bool = True) -> list[dict | None]:
    """Location line, scale and shape of each series' likeliest process, None where no start has a likelihood; t is in years from the January of the first year.

    The fit of shape 0 comes first, which has no ends of its range; fits of a free shape start from it.  Over a threshold
    that is a line as well, its scale is the mean excess, and its location is a line of the rate's logarithm, whose loss is
    convex; there is none if the threshold goes through the events.  With few
    events these may have no maximum (a line through the events with their range's end just below it has any
    likelihood); then the fit of shape 0 stands.  Location and threshold are constant over each of the runs.
    Unless spreads is false, the covariance is the inverse of the loss's curvature, None where that isn't positive definite; a shape of 0 is
    held there.  All series are searched at once.
    """
    m, d = len(times), 2 + 2 * harmonics
    runs = runs or [()] * m
    kinds: dict[tuple, int] = {}  # series with the same months share a grid, and stand together
    duration = np.array([float(t.max() - t.min()) + 1 / 12 for t in times])
    place = np.array([kinds.setdefault((x, tuple(r)), len(kinds)) for x, r in zip(duration.tolist(), runs)])
    order = np.argsort(place, kind="stable")
    place, duration = place[order], duration[order]
    times, values, event_times, event_values, lines, runs = ([x[k] for k in order] for x in (times, values, event_times, event_values, lines, runs))
    grids = np.stack([design(held(np.linspace(0, x, points), r), harmonics) for x, r in kinds])
    # in units of the values' deviation, and on uncorrelated columns: one step size fits all parameters
    mean, unit = np.array([float(np.mean(v)) for v in values]), np.array([float(np.std(v)) or 1.0 for v in values])
    mixes = np.linalg.inv(np.linalg.qr(grids, mode="r")) * math.sqrt(points)
    grids, mixed = grids @ mixes, mixes[place]
    most = max(len(t) for t in event_times)
    there, x_events, v_events = np.zeros((m, most)), np.zeros((m, most, d)), np.zeros((m, most))
    for k, (t, v, r) in enumerate(zip(event_times, event_values, runs)):
        there[k, : len(t)], x_events[k, : len(t)], v_events[k, : len(t)] = 1.0, design(held(t, r), harmonics) @ mixed[k], (v - mean[k]) / unit[k]
    first = np.eye(d)[0]
    line = np.linalg.solve(mixed, ((np.stack(lines) - mean[:, None] * first) / unit[:, None])[..., None])[..., 0]
    model = Processes(grids, place, (grids[place] @ line[..., None])[..., 0], duration / (points - 1), x_events, v_events, there)

    def level(p: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # of shape 0
        value, slope = model.loss(np.pad(p, ((0, 0), (0, 1))), which)
        return value, slope[:, :-1]

    def free(p: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # the shape as a hyperbolic tangent stays within its bounds
        bent = np.tanh(p[:, -1:])
        value, slope = model.loss(np.concatenate((p[:, :-1], WIDEST * bent), axis=1), which)
        slope[:, -1:] *= WIDEST * (1 - bent**2)
        return value, slope

    excess = there * (v_events - (x_events @ line[..., None])[..., 0])
    tail = pareto_fits([np.maximum(excess[k, : len(t)], 0.0) for k, t in enumerate(event_times)])
    mean_excess, rate = excess.sum(1) / there.sum(1), rate_lines(grids, place, duration / (points - 1), (there[..., None] * x_events).sum(1), there.sum(1))
    known, sigma = mean_excess > ON_LINE, np.where(mean_excess > 1e-12, mean_excess, 0.5)
    flat = np.concatenate((line + sigma[:, None] * rate, np.log(sigma)[:, None]), axis=1)
    value, slope = level(flat, np.arange(m))
    fine = known & (np.abs(slope).max(1) < 1e-3 * np.maximum(1, np.abs(value)))
    able = value < 1e9
    point, left = np.pad(flat, ((0, 0), (0, 1))), np.flatnonzero(able)
    for begin in (np.array([min(max(shape, -0.5), 0.5) if known else 0.1 for shape, _, known in tail]), np.full(m, -0.1), np.full(m, 0.1)):
        if not len(left):
            break
        found, lower, done = minimise_many(lambda p, which: free(p, left[which]), np.concatenate((flat[left], np.arctanh(begin[left] / WIDEST)[:, None]), axis=1), 80)
        better = done & (lower < 1e9) & ((lower < value[left]) | ~fine[left])
        taken = left[better]
        point[taken], value[taken], fine[taken] = found[better], lower[better], True
        left = left[~(done & (np.abs(lower - value[left]) < 1e-5 * (1 + np.abs(value[left]))))]
    natural = np.concatenate((point[:, :-2], np.exp(np.clip(point[:, -2:-1], -50, 50)), WIDEST * np.tanh(point[:, -1:])), axis=1)
    spread = covariances(model, natural) if spreads else [None] * m
    back = np.zeros((m, d + 2, d + 2))
    back[:, :d, :d], back[:, d, d], back[:, -1, -1] = mixed * unit[:, None, None], unit, 1.0
    theta = (back @ natural[..., None])[..., 0]
    theta[:, 0] += mean
    loss = value + there.sum(1) * np.log(unit)
    found = [{"beta": theta[k, :-2], "sigma": float(theta[k, -2]), "shape": float(theta[k, -1]), "loss": float(loss[k]), "converged": bool(fine[k]), "duration": float(duration[k]), "harmonics": harmonics, "covariance": None if spread[k] is None else back[k] @ spread[k] @ back[k].T} if able[k] else None for k in range(m)]
    return [found[k] for k in np.argsort(order)]


def process_fit(t: np.ndarray, v: np.ndarray, event_t: np.ndarray, event_v: np.ndarray, u_beta: np.ndarray, points: int = 256, harmonics: int = 1, runs: Sequence[tuple[float, float]] = ()) -> dict:
    """One series' process."""
    found = process_fits([t], [v], [event_t], [event_v], [u_beta], points, harmonics, [runs])[0]
    if found is None:
        raise ValueError("no start has a likelihood")
    return found


def covariances(model: Processes, points: np.ndarray) -> list[np.ndarray | None]:
    """The inverse of the loss's curvature in location, scale and shape, from differences of its slopes, where that is positive definite; a shape of 0 is held."""
    m, n = points.shape
    every, steps, curve, able = np.arange(m), 1e-4 * np.maximum(np.abs(points), 1e-2), np.empty((m, n, n)), np.ones(m, dtype=bool)

    def slope(p: np.ndarray) -> np.ndarray:
        scale = np.maximum(p[:, -2], 1e-20)
        value, out = model.loss(np.concatenate((p[:, :-2], np.log(scale)[:, None], p[:, -1:]), axis=1), every)
        able[value > 1e9] = False
        with np.errstate(all="ignore"):
            out[:, -2] /= scale
        return out

    bent = points[:, -1] != 0
    for k in range(n):
        move = np.zeros((m, n))
        move[:, k] = steps[:, k] * (bent if k == n - 1 else 1)
        with np.errstate(all="ignore"):
            curve[:, k] = (slope(points + move) - slope(points - move)) / (2 * steps[:, k, None])
    curve = (curve + curve.transpose(0, 2, 1)) / 2
    curve[~bent, -1], curve[~bent, :, -1], curve[~bent, -1, -1] = 0.0, 0.0, 1.0
    able &= np.isfinite(curve).all((1, 2))
    able[able] = np.linalg.eigvalsh(curve[able]).min(1) > 0
    out: list = [None] * m
    for k, spread in zip(np.flatnonzero(able), np.linalg.inv(curve[able])):
        if not bent[k]:
            spread[-1, -1] = 0.0
        out[k] = spread if (np.diag(spread) >= 0).all() else None
    return out


def yearly_rates(theta: np.ndarray, level: np.ndarray, x: np.ndarray, slopes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often a year each process passes its level, on average over the rows of an even grid's design; its slopes in level and parameters."""
    sigma, shape = theta[:, -2:-1], theta[:, -1:]
    flat = np.abs(shape) < 1e-6
    z = (level[:, None] - (x @ theta[:, :-2, None])[..., 0]) / sigma
    a, safe = np.where(flat, 1.0, 1 + shape * z), np.where(flat, 1.0, shape)
    inside = a > 0
    log_a = np.log(np.where(inside, np.maximum(a, 1e-12), 1.0))
    per = np.where(inside, np.exp(np.where(flat, np.clip(-z, -700, 700), -log_a / safe)), np.where(shape < 0, 0.0, 1e6)) / (x.shape[1] - 1)
    per[:, [0, -1]] /= 2
    by_z = np.where(inside, -per / np.where(inside, np.maximum(a, 1e-12), 1.0), 0.0)
    to_level = by_z.sum(1) / sigma[:, 0]
    if not slopes:
        return per.sum(1), to_level, to_level
    curved = np.where(inside, per * np.where(flat, z**2 / 2, log_a / safe**2 - z / (safe * np.where(inside, np.maximum(a, 1e-12), 1.0))), 0.0)
    to_theta = np.concatenate((-(by_z[:, None] @ x)[:, 0] / sigma, -(by_z * z).sum(1)[:, None] / sigma, curved.sum(1)[:, None]), axis=1)
    return per.sum(1), to_level, to_theta


def process_levels(fits: Sequence[dict], period: float, points: int = 512) -> list[tuple[float | None, float | None]]:
    """(the level that each process passes once in ``period`` years, on average over the observed time; its standard error by the delta method); None if none is found."""
    if not fits:
        return []
    with np.errstate(all="ignore"):
        return _levels(fits, period, points)


def _levels(fits: Sequence[dict], period: float, points: int) -> list[tuple[float | None, float | None]]:
    axes = {(f["duration"], f["harmonics"]): None for f in fits}
    axes = {key: design(np.linspace(0, key[0], points), key[1]) for key in axes}
    x = np.stack([axes[f["duration"], f["harmonics"]] for f in fits])
    theta = np.stack([np.concatenate((f["beta"], [f["sigma"], f["shape"]])) for f in fits])
    location, sigma = (x @ theta[:, :-2, None])[..., 0], theta[:, -2]
    low, high = location.min(1) - 10 * sigma, location.max(1) + sigma

    def over(level: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
        parts = [yearly_rates(theta[which[k : k + BLOCK]], level[k : k + BLOCK], x[which[k : k + BLOCK]]) for k in range(0, len(which), BLOCK)]
        return [np.concatenate(part) for part in zip(*parts)]

    left = np.arange(len(fits))
    for _ in range(60):
        left = left[over(high[left], left)[0] - 1 / period > 0]
        if not len(left):
            break
        high[left] += (high[left] - low[left]) * 0.5
    every = np.arange(len(fits))
    good = (over(low, every)[0] > 1 / period) & (over(high, every)[0] <= 1 / period)
    level, left = (low + high) / 2, np.flatnonzero(good)
    for k in range(200):  # Newton's steps on the rate's logarithm, halving where they leave the bracket, and for slow ones
        if not len(left):
            break
        at = level[left]
        rate, slope, _ = over(at, left)
        above = rate > 1 / period
        low[left], high[left] = np.where(above, at, low[left]), np.where(above, high[left], at)
        new = at - np.log(rate * period) * rate / slope
        inside = (new > low[left]) & (new < high[left]) & (k < 8 or k % 4 == 0)
        level[left] = np.where(inside, new, (low[left] + high[left]) / 2)
        tolerance = 1e-12 * np.maximum(1, np.abs(high[left]))
        close = np.abs(new - at) < tolerance
        level[left[close]] = at[close]
        left = left[~(close | (high[left] - low[left] < tolerance))]
    _, slope, moved = yearly_rates(theta, level, x, True)
    out: list = [(None, None)] * len(fits)
    for k in np.flatnonzero(good):
        error = None
        if fits[k]["covariance"] is not None and slope[k] < 0:
            by = moved[k] / -slope[k]
            variance = float(by @ fits[k]["covariance"] @ by)
            error = math.sqrt(variance) if variance >= 0 else None
        out[k] = float(level[k]), error
    return out


def process_level(fit: dict, period: float, points: int = 512) -> tuple[float, float | None]:
    """One process's level and its standard error."""
    level, error = process_levels([fit], period, points)[0]
    if level is None:
        raise ValueError("no level has this period")
    return level, error


def threshold_stability(v: np.ndarray, lower: float = 0.70, upper: float = 0.98, steps: int = 25, least: int = 8) -> list[dict]:
    """At evenly spaced quantiles: mean excess, Pareto shape and scale, and the scale that doesn't change with a right threshold; None below ``least``."""
    out = []
    for u in np.unique(np.quantile(v, np.linspace(lower, upper, steps))):
        excess = v[v > u] - u
        row = {"threshold": float(u), "n_exceedances": len(excess), "mean_excess": None, "shape": None, "scale": None, "modified_scale": None}
        if len(excess) >= least:
            row["mean_excess"] = float(excess.mean())
            shape, scale, fine = pareto_fit(excess)
            if fine:
                row |= {"shape": shape, "scale": scale, "modified_scale": scale - shape * float(u)}
        out.append(row)
    return out


def mean_residual_life(v: np.ndarray, candidates: np.ndarray, least: int = 8) -> list[tuple[float, float, int]]:
    """(threshold, mean excess, exceedances) where there are enough."""
    return [(float(u), float((v[v > u] - u).mean()), int((v > u).sum())) for u in candidates if (v > u).sum() >= least]
