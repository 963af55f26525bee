"""Numerical fits of one entity's series each; a fit that fails is a row that says why.

A series has a row a month, so a group is small whatever the table's size; the frames are
shuffled once by entity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.exprs import return_level
from ..numerics import hawkes, shift, stl, tails
from .series import by_entity

MESSAGE = 500
#: Rows of the entities that are fitted together.
TOGETHER = 40_000
#: Exceedance processes of them that are searched at once.
FITS = 2048


def per_entity(rows: DataFrame, compute: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """compute for each entity's rows in time order; errors become one row with a message and nulls."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        entity = frame["entity"].iloc[0]
        try:
            out = compute(frame.sort_values("month_ordinal"))
            out.insert(0, "entity", entity)
            return out.assign(error=None)[["entity", *columns, "error"]]
        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as error:
            return pd.DataFrame([{"entity": entity, **dict.fromkeys(columns), "error": str(error)[:MESSAGE]}])

    return rows.groupBy("entity").applyInPandas(run, f"entity long, {schema}, error string")


def per_entities(rows: DataFrame, compute: Callable[[list[dict]], list], schema: str) -> DataFrame:
    """compute for many entities at once: it takes each one's columns as arrays in time order, and gives its rows or its error.

    A task holds the rows of whole entities, of about ``TOGETHER`` rows together or of one entity.
    """
    spark = rows.sparkSession
    names, out = rows.columns, StructType.fromDDL(f"entity long, {schema}, error string")
    arrow, blank = to_arrow_schema(out), dict.fromkeys(out.names[1:])
    real = lambda x: None if isinstance(x, float) and math.isnan(x) else x

    def fitted(ids: list, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts)
        columns = {c: held.column(c).to_numpy() for c in names if c != "entity"}
        starts = [k for k, e in enumerate(ids) if not k or e != ids[k - 1]]
        found = compute([{c: v[x:y] for c, v in columns.items()} for x, y in zip(starts, [*starts[1:], len(ids)])])
        each = zip((ids[k] for k in starts), ([blank | {"error": str(r)[:MESSAGE]}] if isinstance(r, Exception) else r for r in found))
        return pa.RecordBatch.from_pylist([{"entity": e, **{c: real(x) for c, x in r.items()}} for e, rs in each for r in rs], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in batches:
            mine = batch.column("entity").to_pylist()
            if len(ids) >= TOGETHER:  # what is held goes with the rest of its last entity
                end = next((k for k, e in enumerate(mine) if e != ids[-1]), None)
                if end is not None:
                    yield fitted(ids + mine[:end], [*parts, batch.slice(0, end)])
                    ids, parts, mine, batch = [], [], mine[end:], batch.slice(end)
            ids += mine
            parts.append(batch)
        if ids:
            yield fitted(ids, parts)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "entity").sortWithinPartitions("entity", "month_ordinal").mapInArrow(run, out)


def stl_index(rows: DataFrame) -> DataFrame:
    """Seasonal, trend and residual of the logarithms, and the residual's percentile within its calendar month."""

    def compute(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame["value"].to_numpy()
        if not (v > 0).all():
            raise ValueError("a value isn't positive")
        if len(v) < 36:
            raise ValueError("fewer than three years")
        s, t, r = stl.decompose(np.log(v))
        return pd.DataFrame({"month_ordinal": frame["month_ordinal"].to_numpy(), "month": frame["month"].to_numpy(), "seasonal": s, "trend": t, "residual": r})

    out = per_entity(rows, compute, "month_ordinal int, month int, seasonal double, trend double, residual double")
    same = Window.partitionBy("entity", "month")
    n, upto = F.count("*").over(same), F.count("*").over(same.orderBy("residual").rangeBetween(Window.unboundedPreceding, 0))
    return out.withColumn("percentile", F.when((n >= 2) & F.col("residual").isNotNull(), upto * 100.0 / (n + 1)))


def weighted_moments(rows: DataFrame, column: str = "value", orders: int = 4) -> DataFrame:
    """b_0..b_orders of each entity: sums of sorted values with polynomial weights of their rank."""
    i = F.row_number().over(by_entity().orderBy(column, "month_ordinal")) - 1
    ranked = rows.select("entity", F.col(column).alias("z"), i.cast("double").alias("i"), F.count("*").over(by_entity()).cast("double").alias("n"))
    weight, sums = F.lit(1.0), []
    for k in range(orders + 1):
        sums.append(F.avg(weight * F.col("z")).alias(f"b_{k}"))
        weight = weight * (F.col("i") - k) / F.greatest(F.lit(1.0), F.col("n") - 1 - k)
    return ranked.groupBy("entity").agg(*sums)


def cross_entropy_thresholds(rows: DataFrame, column: str = "index_value", high: float = 0.05, low: float = 0.05) -> DataFrame:
    """Pooled thresholds of each entity's index, from the quantile function closest to the prior with the sample's moments.

    The prior starts at the least of the values over their mean.  One row an entity; the thresholds hold for all months.
    """

    def compute(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame[column].dropna().to_numpy(dtype=float)
        if len(v) < 12:
            raise ValueError("fewer than twelve values")
        if not v.mean() > 0:
            raise ValueError("the mean isn't positive")
        z = v / v.mean()
        b, epsilon = tails.moments(z), float(z.min())
        lam, objective, fine = tails.cross_entropy_fit(b, epsilon)
        level = lambda u: float(tails.cross_entropy_quantile(np.array([u]), epsilon, lam)[0] * v.mean())
        held = tails.cross_entropy_moments(lam, epsilon, len(b))
        return pd.DataFrame([{"threshold_quantile": 1 - high, "threshold_high": level(1 - high), "threshold_low": level(low), "mean": float(v.mean()), "epsilon": epsilon, "lambdas": list(lam), "moments": list(b), "residuals": list(held - b), "objective": objective, "converged": fine}])

    return per_entity(rows, compute, "threshold_quantile double, threshold_high double, threshold_low double, mean double, epsilon double, lambdas array<double>, moments array<double>, residuals array<double>, objective double, converged boolean")


def with_pooled_thresholds(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """The rows of entities with a fit, with its thresholds: what labels, extremes and transitions are taken from."""
    known = fits.where("error is null").select("entity", "threshold_quantile", "threshold_high", "threshold_low")
    return rows.join(known, "entity")


def monthly_thresholds(fits: DataFrame) -> DataFrame:
    """A fit's thresholds once for each calendar month."""
    return fits.where("error is null").select("entity", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "threshold_quantile", "threshold_high", "threshold_low", "epsilon", "lambdas", "converged", "objective")


def cross_entropy_level(u: Column, epsilon: Column, lambdas: Column) -> Column:
    """The fitted quantile function as an expression: the prior's quantile times exp of a polynomial in u."""
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1 - 1e-12))
    power = F.aggregate(F.reverse(lambdas), F.lit(0.0), lambda acc, x: acc * u + x)
    return (epsilon - (1 - epsilon) * F.ln(1 - u)) * F.exp(-power)


def quantile_curve(fits: DataFrame, points: int = 200) -> DataFrame:
    """(entity, u, prior, fitted) of each fit on an even grid."""
    grid = fits.where("lambdas is not null").select("entity", "epsilon", "lambdas", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    u = F.col("k") * F.lit((1 - 1e-8) / (points - 1))
    rows = grid.withColumn("u", u)
    return rows.select("entity", "u", (F.col("epsilon") - (1 - F.col("epsilon")) * F.ln(1 - F.col("u"))).alias("prior"), cross_entropy_level(F.col("u"), F.col("epsilon"), F.col("lambdas")).alias("fitted"))


def tail_levels(rows: DataFrame, q: float = 0.9, periods: tuple[float, ...] = (10.0, 25.0, 50.0, 100.0)) -> DataFrame:
    """Pareto tails beyond a quantile of each entity and their return levels."""

    def compute(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame["value"].to_numpy()
        u = float(np.quantile(v, q))
        excess = v[v > u] - u
        shape, scale, fine = tails.pareto_fit(excess)
        return pd.DataFrame([{"period": p, "threshold": u, "shape": shape, "scale": scale, "n_exceedances": len(excess), "n": len(v), "level": tails.return_level(u, scale, shape, p * 12, len(excess), len(v)) if fine else None, "converged": fine} for p in periods])

    return per_entity(rows, compute, "period double, threshold double, shape double, scale double, n_exceedances long, n long, level double, converged boolean")


def stored_return_levels(fits: DataFrame, periods: tuple[float, ...] = (10.0, 100.0)) -> DataFrame:
    """Return levels of fits that are already in a table: an expression, no fit."""
    rows = fits.where("converged").select("*", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))
    level = return_level(F.col("threshold"), F.col("sigma"), F.col("xi"), 1.0, F.col("n_extremes") * F.col("period"), F.col("n_observations"))
    return rows.select("entity", "tail", "threshold_quantile", "period", level.alias("level"))


def exceedance_processes(rows: DataFrame, quantiles: tuple[float, ...] = (0.95, 0.98), run: int = 1, periods: tuple[float, ...] = (10.0, 25.0, 50.0, 100.0), frozen: DataFrame | None = None, harmonics: int | str = 1) -> DataFrame:
    """Both tails at each quantile: seasonal threshold, declustered exceedances, process fit, return levels with 95 % intervals; a row for each that fails.

    frozen (entity, month_ordinal): threshold and location stay constant over each run of these months.
    periods: of the levels; without any, no covariances are worked out either.
    harmonics: how many the lines have, or "aic" or "bic" to choose one to three for each entity and tail.
    """

    def fitted(jobs: list[dict]) -> None:
        """Puts the result or the error of each into it; all have lines of as many harmonics."""
        try:
            _fit_together(jobs)
        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as error:
            if len(jobs) == 1:  # one combination that fails leaves the others
                jobs[0]["found"] = error
            else:
                for half in (jobs[: len(jobs) // 2], jobs[len(jobs) // 2 :]):
                    fitted(half)

    def _fit_together(jobs: list[dict]) -> None:
        waves, sizes = jobs[0]["waves"], [len(j["v"]) for j in jobs]
        known = np.arange(max(sizes)) < np.array(sizes)[:, None]
        x, v = np.zeros((*known.shape, 2 + 2 * waves)), np.zeros(known.shape)
        x[known], v[known] = tails.design(np.concatenate([j["t"] for j in jobs]), waves), np.concatenate([j["v"] for j in jobs])
        lines = tails.quantile_lines(x, v, known, np.array([j["q"] for j in jobs]))
        levels_of = (x @ lines[..., None])[..., 0]
        for job, line, u, n in zip(jobs, lines, levels_of, sizes):
            over = np.flatnonzero(job["v"] > u[:n])
            job |= {"line": line, "u": u[:n], "groups": np.split(over, np.flatnonzero(np.diff(over) - 1 >= run) + 1), "found": ValueError("no exceedances")}
        jobs = [j for j in jobs if len(j["groups"][0])]
        for job in jobs:
            job["peaks"] = np.array([g[np.argmax(job["v"][g])] for g in job["groups"]], dtype=int)
        if not jobs:
            return
        found = tails.process_fits([j["t"] for j in jobs], [j["v"] for j in jobs], [j["t"][j["peaks"]] for j in jobs], [j["v"][j["peaks"]] for j in jobs], [j["line"] for j in jobs], harmonics=waves, runs=[j["runs"] for j in jobs], spreads=len(periods) > 0)
        for job, fit in zip(jobs, found):
            job["found"] = ValueError("no start has a likelihood")
            job["fit"] = fit
        jobs = [j for j in jobs if j["fit"] is not None]
        by_period = [tails.process_levels([j["fit"] for j in jobs], period) for period in periods]
        for job, levels in zip(jobs, zip(*by_period) if by_period else [()] * len(jobs)):
            job["found"] = result(job, levels)

    def result(job: dict, found: tuple) -> dict:
        fit, peaks, sign, runs, waves = job["fit"], job["peaks"], job["sign"], job["runs"], job["waves"]
        beta = [float(b) for b in fit["beta"]]
        levels, errors = [None if x is None else x * sign for x, _ in found], [e for _, e in found]
        ends = [[None if e is None else x + k * 1.96 * e for x, e in zip(levels, errors)] for k in (-1, 1)]
        location = tails.design(tails.held(job["t"][peaks], runs), waves) @ fit["beta"]
        clusters = [{"month_ordinal": int(job["months"][p]), "cluster_size": len(g), "value": float(job["v"][p]), "threshold": float(job["u"][p]), "location": float(m)} for p, g, m in zip(peaks, job["groups"], location)]
        return {"converged": fit["converged"], "log_likelihood": -fit["loss"], "threshold": float(np.median(job["u"])), "n_extremes": len(peaks), "n_observations": len(job["v"]), "n_frozen_months": sum(round((b - a) * 12) for a, b in runs), "beta0": beta[0], "beta1": beta[1], "sin_1": beta[2], "cos_1": beta[3], "betas": beta, "sigma": fit["sigma"], "xi": fit["shape"], "harmonics": waves, "levels": levels, "levels_low": ends[0], "levels_high": ends[1], "peaks": clusters}

    doubles = "beta0 double, beta1 double, sin_1 double, cos_1 double, betas array<double>, sigma double, xi double"
    fields = f"converged boolean, log_likelihood double, threshold double, n_extremes long, n_observations long, n_frozen_months long, {doubles}, harmonics int, levels array<double>, levels_low array<double>, levels_high array<double>"
    peak = "peaks array<struct<month_ordinal:int,cluster_size:int,value:double,threshold:double,location:double>>"

    def jobs_of(entity: dict) -> list[dict]:
        still, seen = np.unique(entity["month_ordinal"][entity["frozen"]]), ~entity["frozen"] & ~np.isnan(entity["value"])
        months, values = entity["month_ordinal"][seen], entity["value"][seen]
        if len(months) < 20:
            raise ValueError("fewer than 20 observations")
        if not np.isfinite(values).all():
            raise ValueError("a value isn't finite")
        first = months.min() // 12 * 12
        t, out = (months - first) / 12, []
        runs = [(float(g[0] - first) / 12, float(g[-1] + 1 - first) / 12) for g in np.split(still, np.flatnonzero(np.diff(still) > 1) + 1) if len(g)]
        for tail, sign in (("high", 1), ("low", -1)):
            waves = harmonics if isinstance(harmonics, int) else tails.choose_harmonics(t, values * sign, harmonics)[0]
            out += [{"tail": tail, "sign": sign, "q": q, "t": t, "months": months, "v": values * sign, "runs": runs, "waves": waves} for q in quantiles]
        return out

    def compute(entities: list[dict]) -> list:
        out, alike = [], {}
        for entity in entities:
            try:
                out.append(jobs_of(entity))
            except ValueError as error:
                out.append(error)
                continue
            for job in out[-1]:  # together: as many harmonics, about as many months
                alike.setdefault((job["waves"], len(job["t"]).bit_length()), []).append(job)
        for jobs in alike.values():
            for k in range(0, len(jobs), FITS):
                fitted(jobs[k : k + FITS])
        rows = lambda job: job["found"] | {"message": None} if isinstance(job["found"], dict) else {"converged": False, "message": str(job["found"])[:MESSAGE]}
        return [jobs if isinstance(jobs, Exception) else [{"tail": j["tail"], "threshold_quantile": j["q"], **rows(j)} for j in jobs] for jobs in out]

    series = rows.select("entity", "month_ordinal", F.col("value").cast("double").alias("value"), F.lit(False).alias("frozen"))
    if frozen is not None:
        known = frozen.join(rows.select("entity").distinct(), "entity", "left_semi")
        series = series.unionByName(known.select("entity", "month_ordinal", F.lit(None).cast("double").alias("value"), F.lit(True).alias("frozen")))
    return per_entities(series, compute, f"tail string, threshold_quantile double, {fields}, {peak}, message string")


def process_peaks(fits: DataFrame) -> DataFrame:
    """The clusters' peaks that each process was fitted to, on its tail's scale, with their number in time order."""
    return fits.select("entity", "tail", "threshold_quantile", F.posexplode("peaks").alias("k", "p")).select("entity", "tail", "threshold_quantile", (F.col("k") + 1).alias("cluster_id"), "p.*")


def process_residuals(fits: DataFrame) -> DataFrame:
    """Peaks as residuals that are exponential if the process holds, with the probabilities and quantiles both plots compare.

    A fit under which one of its peaks is impossible has no rows.
    """
    each = Window.partitionBy("entity", "tail", "threshold_quantile")
    peaks = fits.where("converged").select("entity", "tail", "threshold_quantile", "sigma", "xi", F.explode("peaks").alias("p"))
    excess = F.col("p.value") - F.col("p.threshold")
    scale = F.col("sigma") + F.col("xi") * (F.col("p.threshold") - F.col("p.location"))
    support = 1 + F.col("xi") * excess / F.nullif(scale, F.lit(0.0))
    flat = F.abs("xi") < 1e-6
    value = F.when(flat, excess / F.col("sigma")).when((scale > 0) & (support > 0), F.ln(support) / F.nullif("xi", F.lit(0.0)))
    rows = peaks.select("entity", "tail", "threshold_quantile", value.alias("residual"), F.col("p.month_ordinal").alias("month_ordinal"))
    n = F.count("*").over(each)
    ranked = rows.select("*", n.alias("n"), F.count("residual").over(each).alias("valid"), F.row_number().over(each.orderBy("residual", "month_ordinal")).alias("k")).where("n = valid")
    share = F.col("k") / (F.col("n") + 1.0)
    return ranked.select("entity", "tail", "threshold_quantile", "k", "residual", share.alias("empirical_probability"), (1 - F.exp(-F.col("residual"))).alias("model_probability"), (-F.ln(1 - share)).alias("theoretical_quantile"))


def threshold_stability(rows: DataFrame) -> DataFrame:
    """Pareto fits of each entity beyond 25 quantiles from 0.70 to 0.98: a good threshold is where shape and modified scale stop changing."""

    def compute(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame["value"].dropna().to_numpy(dtype=float)
        if len(v) < 20:
            raise ValueError("fewer than 20 observations")
        return pd.DataFrame(tails.threshold_stability(v))

    return per_entity(rows, compute, "threshold double, n_exceedances long, mean_excess double, shape double, scale double, modified_scale double")


def residual_life(rows: DataFrame, candidates: tuple[float, ...], least: int = 8) -> DataFrame:
    """Mean excess over quantiles of each entity, where enough exceed them."""
    q = rows.groupBy("entity").agg(F.percentile("value", F.array(*[F.lit(c) for c in candidates])).alias("q"))
    levels = q.select("entity", F.posexplode("q").alias("level_no", "u")).withColumn("u", F.round("u", 6))
    over = rows.select("entity", F.round("value", 6).alias("value")).join(levels, "entity").where("value > u")
    return over.groupBy("entity", "level_no").agg(F.first("u").alias("u"), F.avg(F.col("value") - F.col("u")).alias("mean_excess"), F.count("*").alias("n")).where(F.col("n") >= least)


def excitation(events: DataFrame, months: DataFrame) -> DataFrame:
    """Hawkes fits of each entity's dry and wet events: parameters and the tests of both cross-excitations.

    events: entity, month_ordinal, event_kind (0, 1); months: entity, first, last.
    """

    def fitted(full: dict, *less: dict) -> dict:
        tests = [hawkes.likelihood_ratio(full, one) for one in less]
        flat = {f"{name}_{a}{b}": m[i, j] for name, m in (("alpha", full["alpha"]), ("beta", full["beta"])) for i, a in enumerate("dw") for j, b in enumerate("dw")}
        return {"mu_d": full["mu"][0], "mu_w": full["mu"][1], **flat, "spectral_radius": full["radius"], "log_likelihood": -full["loss"], "converged": full["converged"], "lr_dry_to_wet": tests[0][0], "p_dry_to_wet": tests[0][1], "lr_wet_to_dry": tests[1][0], "p_wet_to_dry": tests[1][1]}

    def compute(entities: list[dict]) -> list:
        out: list = [ValueError("fewer than four events, or of one kind only")] * len(entities)
        known = [k for k, e in enumerate(entities) if len(e["event_kind"]) >= 4 and len(set(e["event_kind"])) == 2]
        some = [entities[k] for k in known]
        found = hawkes.fit_many([e["month_ordinal"] / 12 for e in some], [e["event_kind"] for e in some], [e["first"][0] / 12 for e in some], [(e["last"][0] + 1) / 12 for e in some])
        for k, fits in zip(known, found):
            out[k] = [fitted(*fits)] if np.isfinite(fits[0]["loss"]) else ValueError("no start has a likelihood")
        return out

    names = ["mu_d", "mu_w", *[f"{m}_{a}{b}" for m in ("alpha", "beta") for a in "dw" for b in "dw"], "spectral_radius", "log_likelihood"]
    schema = ", ".join(f"{n} double" for n in names) + ", converged boolean, lr_dry_to_wet double, p_dry_to_wet double, lr_wet_to_dry double, p_wet_to_dry double"
    return per_entities(events.join(months, "entity"), compute, schema)


def monthly_excitation(events: DataFrame, models: DataFrame, months: DataFrame, window: int = 36) -> DataFrame:
    """Base, self- and cross-excited rate of both kinds at each month, from events of the months before it."""
    targets = months.select("entity", "month_ordinal", F.explode(F.array(F.lit(0), F.lit(1))).alias("target"))
    past = events.select(F.col("entity").alias("of"), F.col("month_ordinal").alias("then"), F.col("event_kind").alias("source"))
    age = F.col("month_ordinal") - F.col("then")
    near = targets.join(past, (F.col("entity") == F.col("of")) & (age > 0) & (age <= window), "left").join(models, "entity")
    pick = lambda name: F.when((F.col("target") == 0) & (F.col("source") == 0), F.col(f"{name}_dd")).when(F.col("target") == 0, F.col(f"{name}_dw")).when(F.col("source") == 0, F.col(f"{name}_wd")).otherwise(F.col(f"{name}_ww"))
    part = F.when(F.col("then").isNull(), 0.0).otherwise(pick("alpha") * pick("beta") * F.exp(-pick("beta") * age / 12.0))
    own = F.col("source") == F.col("target")
    out = near.groupBy("entity", "month_ordinal", "target").agg(F.first(F.when(F.col("target") == 0, F.col("mu_d")).otherwise(F.col("mu_w"))).alias("base"), F.sum(F.when(own, part).otherwise(0.0)).alias("self_rate"), F.sum(F.when(own, 0.0).otherwise(part)).alias("cross_rate"))
    return out.withColumn("rate", F.col("base") + F.col("self_rate") + F.col("cross_rate"))


def significant_transitions(rates: DataFrame, q: float = 0.95) -> DataFrame:
    """Months whose share of cross-excitation reaches its quantile over the entity's months."""
    share = rates.withColumn("score", F.col("cross_rate") / F.nullif("rate", F.lit(0.0)))
    level = share.groupBy("entity", "target").agg(F.round(F.percentile("score", F.lit(q)), 9).alias("level"))
    return share.join(level, ["entity", "target"]).withColumn("significant", (F.round("score", 9) >= F.col("level")) & (F.col("score") > 0)).select("entity", "month_ordinal", "target", "score", "level", "significant")


def short_memory(models: DataFrame, p_value: float = 0.05, least_alpha: float = 1e-3, least_events: int = 12, memory: float = 0.25, least: float = 0.5) -> DataFrame:
    """Fits with a significant cross-excitation of which at least half is spent within a quarter of a year, one row for each direction."""
    fine = models.where(F.col("converged") & F.col("error").isNull() & (F.col("n_events") >= least_events))
    ways = [F.struct(F.lit(name).alias("direction"), F.col(f"p_{name}").alias("p"), F.col(f"alpha_{a}").alias("alpha"), (1 - F.exp(-memory * F.col(f"beta_{a}"))).alias("mass")) for name, a in (("dry_to_wet", "wd"), ("wet_to_dry", "dw"))]
    rows = fine.select("entity", F.explode(F.array(*ways)).alias("w")).select("entity", "w.*")
    return rows.where((F.col("p") < p_value) & (F.col("alpha") >= least_alpha) & (F.col("mass") >= least))


def spectral_radius(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the matrix [[a, b], [c, d]] without negative entries."""
    half = (a - d) / 2
    return (a + d) / 2 + F.sqrt(half * half + b * c)


def overall_quality(models: DataFrame) -> DataFrame:
    """One row over all fits: how many converged or failed, and of the good ones events, likelihood an event and how many are stable."""
    failed, fine = F.col("error").isNotNull(), F.coalesce("converged", F.lit(False))
    good = lambda c: F.when(fine & ~failed, c)
    n, count = F.count("*"), lambda c: F.sum(c.cast("long"))
    quartiles = F.percentile(good(F.col("n_events")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    each = good(F.col("log_likelihood") / F.nullif("n_events", F.lit(0)))
    out = models.agg(n.alias("n_rows"), count(fine).alias("n_converged"), count(failed).alias("n_failed"), quartiles.alias("q"), F.percentile(each, F.lit(0.5)).alias("median_likelihood_per_event"), F.percentile(good(F.col("spectral_radius")), F.lit(0.5)).alias("median_spectral_radius"), F.avg(good((F.col("spectral_radius") < 1).cast("double"))).alias("stable_ratio"))
    share = lambda c: F.col(c) / F.nullif("n_rows", F.lit(0))
    events = [F.col("q")[k].alias(f"{name}_events") for k, name in enumerate(("q1", "median", "q3"))]
    return out.select("n_rows", "n_converged", "n_failed", share("n_converged").alias("convergence_rate"), share("n_failed").alias("failure_rate"), *events, "median_likelihood_per_event", "median_spectral_radius", "stable_ratio")


def shift_labels(rows: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """stable, degraded or intermittent, from breaks of the months that aren't frozen, without the months' means where these dominate."""
    from .series import without_frozen

    def compute(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["value"].notna()]
        out = shift.classify(frame["value"].to_numpy(dtype=float), frame["month"].to_numpy())
        first, second = out["first"], out["second"]
        return pd.DataFrame([{"shift_label": out["label"], "statistic": first.stat, "p_value": first.p, "break_index": first.index, "second_statistic": second.stat, "second_p_value": second.p, "second_index": second.index, "used_deseasoned": out["dominance"] > shift.DOMINANCE, "dominance": out["dominance"]}])

    moving = rows if frozen is None else without_frozen(rows, frozen)
    out = per_entity(moving.where("value is not null"), compute, "shift_label string, statistic double, p_value double, break_index int, second_statistic double, second_p_value double, second_index int, used_deseasoned boolean, dominance double")
    known = rows.select("entity").distinct().join(out, "entity", "left")
    return known.withColumn("shift_label", F.coalesce("shift_label", F.lit("stable")))
