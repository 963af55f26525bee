"""Numerical fits against known parameters and invariants, and the catalog's upkeep."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from seriesforge.numerics import hawkes, shift, stl, tails
from seriesforge.operators import calculators, fits
from seriesforge.operators import series as S
from seriesforge.sources import catalog


def seasonal(years=23, seed=42, trend=0.0):
    rng = np.random.default_rng(seed)
    t = np.arange(years * 12)
    return 100 + 20 * np.sin(2 * np.pi * t / 12) + trend * t + rng.normal(0, 5, len(t)), t % 12 + 1


# -- shifts --------------------------------------------------------------------------------


def test_shift_labels():
    values, months = seasonal()
    assert shift.classify(np.full(12, 10.0), np.arange(12) % 12 + 1)["label"] == "stable"
    assert shift.classify(np.full(276, 10.0), months)["label"] == "stable"
    assert shift.classify(values, months)["label"] == "intermittent"  # noise keeps crossing its median
    broken = values.copy()
    broken[138:] += 400
    found = shift.classify(broken, months)
    assert abs(found["first"].index - 138) <= 1 and found["first"].stat > 0
    assert shift.seasonal_part(values, months)[1] > shift.DOMINANCE
    assert shift.seasonal_part(values[:12], months[:12])[1] == 0.0  # each month is there once


def test_break_scan_equals_every_split():
    """The scan from prefix sums against sums of squares of each split."""
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, 90) + np.where(np.arange(90) < 40, 0, 2)
    lag, segment, best = 12, 24, (0.0, None)
    for k in range(segment, len(v) - segment + 1):
        rest = np.concatenate((v[:k] - v[:k].mean(), v[k:] - v[k:].mean()))
        gain = ((v - v.mean()) ** 2).sum() - (rest**2).sum()
        long_run = (rest**2).mean() + sum(2 * (1 - j / (lag + 1)) * (rest[j:] * rest[:-j]).mean() for j in range(1, lag + 1))
        stat = gain / max(max(long_run, 1e-12) * len(v), 1e-12)
        best = max(best, (stat, k), key=lambda x: x[0])
    found = shift.break_scan(v, segment, lag)
    assert found.index == best[1] and abs(found.stat - best[0]) < 1e-9


# -- thresholds and tails ------------------------------------------------------------------


def test_weighted_moments_begin_with_the_mean():
    z = np.random.default_rng(1).gamma(2, 1, 200)
    b = tails.moments(z)
    assert abs(b[0] - z.mean()) < 1e-12 and (np.diff(b) < 0).all()


def test_cross_entropy_holds_its_moments_and_orders_thresholds():
    z = np.random.default_rng(2).gamma(3, 1, 276)
    z /= z.mean()
    b, epsilon = tails.moments(z), float(z.min())
    lam, value, fine = tails.cross_entropy_fit(b, epsilon)
    assert fine and abs(tails.cross_entropy_moments(lam, epsilon, len(b)) - b).max() < 1e-2
    levels = tails.cross_entropy_quantile(np.array([0.05, 0.5, 0.95]), epsilon, lam)
    assert (np.diff(levels) > 0).all() and abs(levels[1] - np.median(z)) < 0.15
    # without multipliers the prior itself is left: it starts at epsilon and has mean 1
    assert tails.cross_entropy_quantile(np.array([0.0]), 0.3, np.zeros(3))[0] == pytest.approx(0.3)


@pytest.mark.parametrize("shape", [-0.2, 0.0, 0.25])
def test_pareto_fit_finds_known_parameters(shape):
    u = np.random.default_rng(3).random(20_000)
    excess = -2.0 * np.log(u) if shape == 0 else 2.0 / shape * (u**-shape - 1)
    found, scale, fine = tails.pareto_fit(excess)
    assert fine and abs(found - shape) < 0.03 and abs(scale - 2.0) < 0.1


def test_quantile_line_has_its_share_below():
    values, months = seasonal(trend=0.1)
    t = np.arange(len(values)) / 12
    for q in (0.5, 0.9):
        below = (values < tails.design(t) @ tails.quantile_line(t, values, q)).mean()
        assert abs(below - q) < 0.03


def test_process_levels_are_passed_once_in_their_period():
    values, _ = seasonal()
    t = np.arange(len(values)) / 12
    u = tails.quantile_line(t, values, 0.9)
    over = np.flatnonzero(values > tails.design(t) @ u)
    fit = tails.process_fit(t, values, t[over], values[over], u)
    found = [tails.process_level(fit, p) for p in (2.0, 10.0, 50.0)]
    levels = [level for level, _ in found]
    assert fit["converged"] and levels == sorted(levels)
    x = tails.design(np.linspace(0, fit["duration"], 512))
    z = 1 + fit["shape"] * (levels[1] - x @ fit["beta"]) / fit["sigma"]
    assert np.mean(np.maximum(z, 1e-12) ** (-1 / fit["shape"])) == pytest.approx(0.1, rel=1e-2)
    theta, errors = np.concatenate((fit["beta"], [fit["sigma"], fit["shape"]])), []
    for p in (2.0, 10.0, 50.0):  # the level's slopes by solving again for moved parameters

        def again(moved):
            return tails.process_level(fit | {"beta": moved[:-2], "sigma": moved[-2], "shape": moved[-1], "covariance": None}, p)[0]

        slopes = np.array([(again(theta + s) - again(theta - s)) / (2 * s.max()) for s in np.diag(1e-4 * np.maximum(np.abs(theta), 1e-2))])
        errors.append(np.sqrt(slopes @ fit["covariance"] @ slopes))
    assert [e for _, e in found] == pytest.approx(errors, rel=1e-2)


def test_level_errors_are_those_of_repeated_samples():
    """Of peaks drawn again and again from one process, levels scatter as the delta method says."""
    rng, levels, errors = np.random.default_rng(42), [], []
    t = np.arange(480) / 12
    for _ in range(60):
        n = rng.poisson(80)
        when, size = np.sort(rng.choice(480, n, replace=False)), rng.exponential(2.0, n)
        v = np.full(480, 9.0)
        v[when] = 10 + size
        fit = tails.process_fit(t, v, t[when], v[when], np.array([10.0, 0, 0, 0]))
        level, error = tails.process_level(fit, 20.0)
        levels.append(level)
        errors.append(np.nan if error is None else error)
    assert np.isfinite(errors).mean() > 0.8
    assert np.median(levels) == pytest.approx(10 + 2 * np.log(40), rel=0.1)
    spread = np.subtract(*np.quantile(levels, [0.84, 0.16])) / 2
    assert 0.5 < np.nanmedian(errors) / spread < 2


def test_frozen_runs_hold_location_and_threshold():
    t = np.arange(36) / 12
    moved = tails.held(t, [(3 / 12, 6 / 12), (30 / 12, 31 / 12)])
    assert np.allclose(moved[[2, 3, 4, 5, 6, 30, 31]] * 12, [2, 3, 3, 3, 6, 30, 31])
    values, _ = seasonal()
    t = np.arange(len(values)) / 12
    u = tails.quantile_line(t, values, 0.9)
    over = np.flatnonzero(values > tails.design(t) @ u)
    plain = tails.process_fit(t, values, t[over], values[over], u)
    still = tails.process_fit(t, values, t[over], values[over], u, runs=[(k + 0.0, k + 4 / 12) for k in range(int(t.max()))])
    assert plain["loss"] != pytest.approx(still["loss"], rel=1e-6)


def test_harmonics_are_those_of_the_series():
    rng, t = np.random.default_rng(42), np.arange(360) / 12
    for count in (1, 2, 3):
        v = sum(np.sin(2 * np.pi * h * t) for h in range(1, count + 1)) + rng.normal(0, 0.1, 360)
        found, error = tails.choose_harmonics(t, v, "bic")
        assert found == count and error < 0.3
    with pytest.raises(ValueError):
        tails.choose_harmonics(t[:4], t[:4])


def test_stable_thresholds_of_a_pareto_tail():
    rng = np.random.default_rng(42)
    v = 2.0 / 0.2 * (rng.uniform(size=20000) ** -0.2 - 1)  # shape 0.2, scale 2
    rows = tails.threshold_stability(v)
    assert len(rows) == 25 and all(abs(r["shape"] - 0.2) < 0.15 and abs(r["modified_scale"] - 2) < 1.2 for r in rows)
    few = tails.threshold_stability(np.arange(40.0))
    assert few[-1]["n_exceedances"] < 8 and few[-1]["mean_excess"] is None and few[0]["mean_excess"] is not None


def test_seasonal_decomposition_adds_up():
    values, _ = seasonal(trend=0.2)
    season, trend, rest = stl.decompose(np.log(values))
    assert np.allclose(season + trend + rest, np.log(values)) and rest.std() < 0.5 * season.std()


# -- processes -----------------------------------------------------------------------------


def test_process_likelihood_equals_its_definition():
    rng = np.random.default_rng(42)
    t, kind = np.sort(rng.uniform(0, 10, 30)), rng.integers(0, 2, 30)
    mu, alpha, beta = np.array([0.5, 0.8]), np.array([[0.2, 0.1], [0.3, 0.15]]), np.array([[1.0, 2.0], [1.5, 0.7]])
    want = 0.0
    for i in range(30):
        rate = mu[kind[i]] + sum(alpha[kind[i], kind[j]] * beta[kind[i], kind[j]] * np.exp(-beta[kind[i], kind[j]] * (t[i] - t[j])) for j in range(i))
        want += np.log(rate)
    want -= mu.sum() * 10 + sum(alpha[a, kind[j]] * (1 - np.exp(-beta[a, kind[j]] * (10 - t[j]))) for a in (0, 1) for j in range(30))
    assert hawkes.loss(mu, alpha, beta, t, kind, 0.0, 10.0) == pytest.approx(-want)


def test_a_closed_way_is_never_likelier():
    rng = np.random.default_rng(42)
    t, kind = np.sort(rng.uniform(0, 20, 40)), rng.integers(0, 2, 40)
    full = hawkes.fit(t, kind, 0.0, 20.0)
    for closed in ((0, 1), (1, 0)):
        less = hawkes.fit(t, kind, 0.0, 20.0, closed)
        statistic, p = hawkes.likelihood_ratio(full, less)
        assert less["alpha"][closed] == 0 and statistic >= 0 and 0 <= p <= 1
    assert full["radius"] < 1.0 and full["loss"] <= hawkes.loss(np.array([1.0, 1.0]), np.zeros((2, 2)), np.ones((2, 2)), t, kind, 0.0, 20.0) + 1e-6


def test_many_processes_are_searched_at_once():
    """Losses and slopes equal the definition's, with events at one time and of other entities beside them; 300 entities take seconds."""
    rng = np.random.default_rng(7)
    times = [np.sort(rng.integers(0, 84, n)) / 12 for n in rng.integers(4, 40, 300)]
    kinds = [np.concatenate(([0, 1], rng.integers(0, 2, len(t) - 2))) for t in times]
    events, p, free = hawkes.Events(times[:5], kinds[:5], [0.0] * 5, [7.0] * 5), rng.normal(0, 1, (5, 10)), np.ones((2, 2, 5))
    free[1, 0, 2] = 0.0
    value, *slopes = events.loss(p, np.arange(5), free)
    mu, alpha, beta = hawkes.unpack_many(p, free)
    for k in range(5):
        own = [mu[:, k], alpha[:, :, k], beta[:, :, k]]
        assert hawkes.loss(*own, times[k], kinds[k], 0.0, 7.0) == pytest.approx(value[k])
        for part, slope in zip(own, slopes):
            for at in np.ndindex(part.shape):
                ends = []
                for h in (1e-6, -1e-6):
                    part[at] += h
                    ends.append(hawkes.loss(*own, times[k], kinds[k], 0.0, 7.0))
                    part[at] -= h
                assert slope[(*at, k)] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-5)
    start = time.process_time()
    found = hawkes.fit_many(times, kinds, [0.0] * 300, [7.0] * 300)
    assert time.process_time() - start < 15
    assert len(found) == 300 and all(f["loss"] <= less["loss"] + 0.2 for f, *others in found for less in others if f["converged"] and less["converged"])
    alone = hawkes.fit(times[8], kinds[8], 0.0, 7.0)
    assert alone["loss"] == pytest.approx(found[8][0]["loss"], abs=1e-6)


def test_entities_of_many_batches_are_fitted_whole(spark, monkeypatch):
    monkeypatch.setattr(fits, "TOGETHER", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.range(400).selectExpr("id % 37 as entity", "cast(id div 37 as int) as month_ordinal")
        sizes = fits.per_entities(rows, lambda es: [[{"n": len(e["month_ordinal"]), "fine": bool((np.diff(e["month_ordinal"]) > 0).all())}] if len(e["month_ordinal"]) > 10 else ValueError("few") for e in es], "n long, fine boolean").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.entity, r.n, r.fine, r.error) for r in sizes if r.error is None) == [(k, 11, True, None) for k in range(30)]
    assert {(r.entity, r.n, r.error) for r in sizes if r.error} == {(k, None, "few") for k in range(30, 37)}


def test_both_methods_of_many_entities_are_compared(spark):
    """240 entities, two of them without events of both kinds, have a row with both results or errors within a minute."""
    rng = np.random.default_rng(5)
    rows = [(e, 2000 + k // 12, k % 12 + 1, 24000 + k, float(v)) for e in range(240) for k, v in enumerate(np.full(84, 3.0) if e < 2 else rng.gamma(2.0, 1.0, 84))]
    df = spark.createDataFrame(rows, "entity long, year int, month int, month_ordinal int, value double").repartition(1).cache()
    events = S.extremes(S.label(S.thresholds(S.climatology_anomaly(df)))).select("entity", "month_ordinal", (F.col("event_type") == "high").cast("int").alias("event_kind"))
    start = time.monotonic()
    found = calculators.compared(calculators.processes(df, events), calculators.processes(df, calculators.tail_process_events(df, 0.9)), ("pooled", "tail"), "spectral_radius").collect()
    assert time.monotonic() - start < 60
    assert len(found) == 240 and sum(r.difference is not None for r in found) > 200
    assert all((r.pooled_error is None) == (r.pooled_spectral_radius is not None) and (r.tail_error is None) == (r.tail_spectral_radius is not None) for r in found)


def test_a_comparison_shares_scans_of_the_facts(spark, sf_dir):
    """Spans of months are taken from the sums that the series have: two scans, which differ in their filters."""
    from seriesforge.plans.registry import QUERIES

    found = QUERIES["processes_compared"](spark, sf_dir)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") <= 2


def test_many_exceedance_processes_are_searched_at_once():
    """Slopes equal differences of the losses; series beside others get the fit that they get alone, and 60 take seconds."""
    rng = np.random.default_rng(3)
    t, found = np.arange(23 * 12) / 12, []
    values = [100 + 20 * np.sin(2 * np.pi * t) + rng.gumbel(0, 5, len(t)) for _ in range(60)]
    lines = tails.quantile_lines(np.tile(tails.design(t), (60, 1, 1)), np.stack(values), np.ones((60, len(t))), np.full(60, 0.9))
    over = [np.flatnonzero(v > tails.design(t) @ line) for v, line in zip(values, lines)]
    start = time.process_time()
    found = tails.process_fits([t] * 60, values, [t[o] for o in over], [v[o] for v, o in zip(values, over)], list(lines))
    levels = tails.process_levels(found, 10.0)
    assert time.process_time() - start < 15
    assert sum(f["converged"] for f in found) > 50 and all(level is not None for level, _ in levels)
    for k in (0, 7):
        alone = tails.process_fit(t, values[k], t[over[k]], values[k][over[k]], lines[k])
        assert alone["loss"] == pytest.approx(found[k]["loss"], abs=1e-6) and tails.process_level(alone, 10.0)[0] == pytest.approx(levels[k][0], rel=1e-4)
    grid, events = tails.design(np.linspace(0, 23, 64))[None], tails.design(t[over[0]])[None]
    model = tails.Processes(grid, np.zeros(3, dtype=int), np.tile(grid[0] @ lines[0], (3, 1)), np.full(3, 23 / 63), np.tile(events, (3, 1, 1)), np.tile(values[0][over[0]], (3, 1)), np.ones((3, len(over[0]))))
    p = np.array([[*lines[0], 2.0, shape] for shape in (0.1, -0.05, 0.2)])
    _, slopes = model.loss(p, np.arange(3))
    for k, step in enumerate(1e-5 * np.eye(6)):
        ends = [model.loss(p + sign * step, np.arange(3), False)[0] for sign in (1, -1)]
        assert np.allclose(slopes[:, k], (ends[0] - ends[1]) / 2e-5, rtol=1e-4, atol=1e-4)


def test_peaks_and_residuals_do_not_depend_on_entities_beside(spark):
    """Entities fitted together with others, of which one has too few months and one fails, have the peaks and residuals they have alone."""
    def rows(e):
        values, months = seasonal(seed=e)
        return [(e, int(k // 12), int(m), int(k), float(v)) for k, (v, m) in enumerate(zip(values, months))][: 12 if e == 2 else None]

    schema = "entity long, year int, month int, month_ordinal int, value double"
    together = fits.exceedance_processes(spark.createDataFrame([r for e in range(1, 6) for r in rows(e)] + [(9, k // 12, k % 12 + 1, k, 5.0) for k in range(60)], schema).repartition(1), (0.9,)).cache()
    alone = fits.exceedance_processes(spark.createDataFrame(rows(3), schema), (0.9,)).cache()
    assert [r.error is None for r in together.where("entity = 2").collect()] == [False] and together.where("entity = 9").count() == 2
    for of in (fits.process_peaks, fits.process_residuals):
        a, b = (sorted(map(tuple, of(x).where("entity = 3").collect()), key=str) for x in (together, alone))
        assert len(a) > 10 and len(a) == len(b)
        for x, y in zip(a, b):
            assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-3)


def test_peaks_need_no_levels(spark):
    """Without periods there are the same fits and peaks, only no levels."""
    values, months = seasonal()
    rows = spark.createDataFrame([(e, int(k // 12), int(m), int(k), float(v * (1 + e * (k % 5) / 50))) for e in range(3) for k, (v, m) in enumerate(zip(values, months))], "entity long, year int, month int, month_ordinal int, value double")
    full, less = (fits.exceedance_processes(rows, (0.9,), periods=periods).cache() for periods in ((10.0,), ()))
    assert full.where("message is null").count() == 6 and less.where("message is null and size(levels) = 0").count() == 6
    for of in (fits.process_peaks, fits.process_residuals):
        assert of(full).count() > 60 and sorted(map(tuple, of(full).collect())) == sorted(map(tuple, of(less).collect()))


def test_losses_do_not_depend_on_how_grids_are_shared(monkeypatch):
    """As one matrix or apart, at shape 0 and beside it."""
    rng = np.random.default_rng(2)
    grid, x = tails.design(np.linspace(0, 7, 64))[None], tails.design(rng.random((40, 5)).ravel() * 7).reshape(40, 5, 4)
    model = tails.Processes(grid, np.zeros(40, dtype=int), rng.normal(2, 0.1, (40, 64)), np.full(40, 1 / 9), x, rng.normal(3, 0.2, (40, 5)), np.ones((40, 5)))
    points = np.concatenate((rng.normal(0, 0.1, (40, 5)), np.where(np.arange(40) % 3, rng.uniform(-0.2, 0.2, 40), 0.0)[:, None]), axis=1)
    together, single = model.loss(points, np.arange(40)), [model.loss(points[k : k + 1], np.array([k])) for k in range(40)]
    apart = tails.Processes(np.repeat(grid, 40, axis=0), np.arange(40), model.u_grid, model.width, x, model.v, model.there).loss(points, np.arange(40))
    for k in (0, 1):
        assert np.allclose(together[k], np.concatenate([s[k] for s in single]), rtol=1e-9) and np.allclose(together[k], apart[k], rtol=1e-9)


def test_tails_of_many_samples_are_those_of_each():
    rng = np.random.default_rng(4)
    samples = [rng.pareto(3, n) for n in (2, 3, 3, 7, 40, 40)] + [np.zeros(5), np.array([1.0, np.nan, 2.0, 0.5])]
    for many, x in zip(tails.pareto_fits(samples), samples):
        assert many == pytest.approx(tails.pareto_fit(x), nan_ok=True)


def test_one_poor_combination_leaves_the_others(spark):
    values, months = seasonal()
    values[values < np.quantile(values, 0.5)] = 90.0  # a flat low side has no clusters
    rows = spark.createDataFrame([(1, int(k // 12), int(m), int(k), float(v)) for k, (v, m) in enumerate(zip(values, months))], "entity long, year int, month int, month_ordinal int, value double")
    found = fits.exceedance_processes(rows, (0.9,)).collect()
    assert {r.tail for r in found} == {"high", "low"} and any(r.message is None and r.converged for r in found if r.tail == "high")


def test_processes_with_frozen_months_and_chosen_harmonics(spark):
    values, months = seasonal()
    rows = spark.createDataFrame([(1, int(k // 12), int(m), int(k), float(v)) for k, (v, m) in enumerate(zip(values, months))], "entity long, year int, month int, month_ordinal int, value double")
    frozen = spark.createDataFrame([(e, k) for e in (1, 2) for y in range(5) for k in (12 * y + 11, 12 * y + 12)], "entity long, month_ordinal int")
    out = fits.exceedance_processes(rows, (0.9,), frozen=frozen, harmonics="aic").cache()
    found = out.collect()
    assert {(r.entity, r.tail, r.n_frozen_months) for r in found} == {(1, "high", 10), (1, "low", 10)}
    for r in found:
        assert r.message is None and len(r.betas) == 2 + 2 * r.harmonics and r.n_extremes == len(r.peaks)
        assert all(a is None or a <= x <= b for a, x, b in zip(r.levels_low, r.levels, r.levels_high))
    peaks = fits.process_peaks(out).where("tail = 'high'").collect()
    assert all(p.value > p.threshold and p.value == values[p.month_ordinal] for p in peaks)
    residuals = fits.process_residuals(out).collect()
    assert len(residuals) == sum(r.n_extremes for r in found if r.converged)
    assert all(r.residual > 0 and abs(r.model_probability - (1 - np.exp(-r.residual))) < 1e-12 for r in residuals)
    out.unpersist()


def test_decay_index_of_a_long_series(spark):
    rows = spark.range(2000).select(F.lit(1).alias("entity"), F.col("id").alias("month_ordinal"), (F.col("id") % 3 == 0).cast("double").alias("phi"))
    got = [r.decay_index for r in S.decay_index(rows).orderBy("month_ordinal").collect()]
    want, now = [], 0.0
    for k in range(2000):
        now = now * np.exp(-0.8) + float(k % 3 == 0)
        want.append(now)
    assert np.allclose(got, want, rtol=1e-9)


# -- tables and runs -----------------------------------------------------------------------


def test_tables_are_replaced_merged_and_found(spark, tmp_path):
    tables = catalog.Catalog(spark, f"file://{tmp_path}", {"areas": "area_v2"})
    schema = StructType([StructField("entity", LongType()), StructField("v", DoubleType())])
    assert tables.ensure("areas", schema).count() == 0
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0)], schema)
    tables.replace("areas", rows)
    tables.merge("areas", spark.createDataFrame([(2, 5.0), (3, 3.0)], schema), ["entity"])
    tables.merge("fresh", rows, ["entity"])
    assert sorted(map(tuple, tables.read("areas").collect())) == [(1, 1.0), (2, 5.0), (3, 3.0)]
    assert tables.register_folder() == {"areas": "area_v2", "fresh": "fresh"}
    assert spark.sql("select count(*) from areas").first()[0] == 3
    (tmp_path / "area_v2").rename(tmp_path / "area_v2.old")  # cut off between the renames
    tables.recover("areas")
    assert tables.read("areas").count() == 3
    calls = []
    compute = lambda: calls.append(1) or rows
    for refresh in (False, False, True):
        assert tables.cached("grid", compute, refresh).count() == 2
    assert len(calls) == 2
    with pytest.raises(ValueError, match="lacks"):
        tables.ensure("areas", StructType([StructField("other", LongType())]))
    spark.catalog.dropTempView("areas")
    spark.catalog.dropTempView("fresh")


def test_chunks_and_events_are_read(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "entity long, a double").write.parquet(f"file://{tmp_path}/1")
    spark.createDataFrame([(7, 3)], "entity int, b int").write.parquet(f"file://{tmp_path}/2")
    paths = [f"file://{tmp_path}/{k}" for k in (1, 2)]
    rows = catalog.concatenated(spark, paths, {"entity": "long", "a": "double", "b": "long"})
    assert sorted(map(tuple, rows.collect())) == [(1, 2.0, None), (7, None, 3)]
    assert catalog.concatenated(spark, paths, {"entity": "long"}, 5).count() == 1
    events = spark.createDataFrame([("2", "1.5"), ("x", "1"), ("1", None), ("1", "4")], "time string, value string")
    assert [tuple(r) for r in catalog.tail_events(events).collect()] == [(1.0, 4.0), (2.0, 1.5)]


def test_a_run_resumes(spark, tmp_path):
    ids = spark.range(0, 100).withColumnRenamed("id", "entity")
    stored = []

    def run(finished):
        return calculators.by_chunks(ids, finished, 25, lambda a, b: ids.where((F.col("entity") >= a) & (F.col("entity") < b)), lambda rows: stored.append(rows.count()))

    assert run(ids.where("entity < 50")) == 2 and stored == [25, 25]
    assert run(ids) == 0
    with pytest.raises(ValueError):
        calculators.pending("nothing", ids, ids)


def test_shape_zero_has_the_mean_excess_as_scale_and_the_rate_of_the_events(monkeypatch):
    looked_at, loss = [], tails.Processes.loss
    monkeypatch.setattr(tails.Processes, "loss", lambda self, p, *rest: looked_at.extend(p[:, -1] == 0) or loss(self, p, *rest))
    rng = np.random.default_rng(8)
    t = np.arange(84) / 12
    v, line = rng.normal(size=84), np.array([2.5, 0.05, 0.3, -0.2])
    events = np.array([5, 23, 50, 70])
    v[events] = tails.design(t[events]) @ line + [1e-5, 4e-5, 2e-5, 3e-5]  # a threshold close below four of four events
    fit = tails.process_fits([t], [v], [t[events]], [v[events]], [line], spreads=False)[0]
    assert sum(looked_at) == 1  # no search for this fit
    assert fit["converged"] and fit["shape"] == 0 and abs(fit["sigma"] - 2.5e-5) < 1e-10
    x = tails.design(np.linspace(0, t[-1] + 1 / 12, 256))
    weight = np.full(256, 7 / 255)
    weight[[0, -1]] /= 2
    rate = np.exp(x @ (fit["beta"] - line) / fit["sigma"]) * weight
    assert np.allclose(rate @ x, tails.design(t[events]).sum(0), atol=1e-6)
    v[events] = tails.design(t[events]) @ line  # it goes through all of them: no scale has the largest likelihood
    try:
        assert tails.process_fit(t, v, t[events], v[events], line)["converged"] is False
    except ValueError as error:
        assert "no start" in str(error)
