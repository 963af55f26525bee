"""Queries of the numerical fits, and SQL for those parts that are expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, quality
from ..operators import series as S
from ..sources import adapters as A
from .registry import query
from .series_queries import labelled


def _events(spark, d):
    events = S.extremes(labelled(spark, d))
    return events.select("entity", "month_ordinal", F.when(F.col("event_type") == "high", 1).otherwise(0).alias("event_kind"))


def _span(spark, d):
    return A.series(spark, d).groupBy("entity").agg(F.min("month_ordinal").alias("first"), F.max("month_ordinal").alias("last"))


def _models(spark, d):
    """Deterministic stand-ins for fitted processes."""
    e = F.col("entity")
    names = [f"{m}_{a}{b}" for m in ("alpha", "beta") for a in "dw" for b in "dw"]
    return A.info(spark, d).select("entity", F.lit(0.5).alias("mu_d"), F.lit(0.25).alias("mu_w"), *[(((e + k) % 7 + 1).cast("double") / (20 if k < 4 else 1)).alias(n) for k, n in enumerate(names)])


@query()
def stl_percentile(spark, d):
    return fits.stl_index(A.series(spark, d))


_WEIGHTS = ["1.0::double"]
for _k in range(4):
    _WEIGHTS.append(f"{_WEIGHTS[-1]} * (i - {_k}) / greatest(1.0::double, n - {1 + _k})")


@query(f"""select entity, {", ".join(f"avg({w} * z) as b_{k}" for k, w in enumerate(_WEIGHTS))} from (select entity, value as z, cast(row_number() over (partition by entity order by value, month_ordinal) - 1 as double) as i, cast(count(*) over (partition by entity) as double) as n from series) group by entity""", "b_0 b_1 b_2 b_3 b_4")
def weighted_moments(spark, d):
    return fits.weighted_moments(A.series(spark, d))


def _percentiles(spark, d):
    rows = S.percentile_rank(A.series(spark, d))
    return rows.withColumn("index_value", F.col("percentile")).where("index_value is not null")


@query()
def cross_entropy_thresholds(spark, d):
    return fits.cross_entropy_thresholds(_percentiles(spark, d))


@query()
def pareto_return_levels(spark, d):
    return fits.tail_levels(A.series(spark, d))


@query("""select entity, tail, threshold_quantile, period, case when n_extremes * period / n_observations <= 1 then threshold when abs(xi) < 1e-8 then threshold + sigma * ln(n_extremes * period / n_observations)
    else threshold + sigma / xi * (pow(n_extremes * period / n_observations, xi) - 1) end as level from fits, (values (10.0::double), (100.0::double)) p(period) where converged""", "threshold_quantile period level")
def stored_return_levels(spark, d):
    return fits.stored_return_levels(A.tail_fits(A.series(spark, d)))


@query()
def exceedance_processes(spark, d):
    rows = A.series(spark, d)
    return fits.exceedance_processes(rows, frozen=A.frozen(rows)).drop("peaks")


@query()
def process_peaks(spark, d):
    rows = A.series(spark, d)
    return fits.process_peaks(fits.exceedance_processes(rows, periods=(), frozen=A.frozen(rows)))


@query()
def process_residuals(spark, d):
    rows = A.series(spark, d)
    return fits.process_residuals(fits.exceedance_processes(rows, periods=(), frozen=A.frozen(rows)))


@query()
def threshold_stability(spark, d):
    return fits.threshold_stability(A.series(spark, d))


@query("""with u as (select entity, round(quantile_cont(value, 0.7), 6) as u0, round(quantile_cont(value, 0.8), 6) as u1, round(quantile_cont(value, 0.9), 6) as u2 from series group by 1),
    v as (select entity, 0 as level_no, u0 as u from u union all select entity, 1, u1 from u union all select entity, 2, u2 from u)
    select entity, cast(level_no as int) as level_no, any_value(u) as u, avg(value - u) as mean_excess, count(*) as n from (select entity, round(value, 6) as value from series) join v using (entity) where value > u group by 1, 2 having count(*) >= 8""", "u mean_excess")
def mean_residual_life(spark, d):
    return fits.residual_life(A.series(spark, d), (0.7, 0.8, 0.9))


@query()
def hawkes_fits(spark, d):
    return fits.excitation(_events(spark, d), _span(spark, d))


_PARTS = ", ".join(f"cast((entity + {k}) % 7 + 1 as double) / {20 if k < 4 else 1} as {m}_{a}{b}" for k, (m, a, b) in enumerate((m, a, b) for m in ("alpha", "beta") for a in "dw" for b in "dw"))
_PICK = lambda m: f"case when target = 0 and source = 0 then {m}_dd when target = 0 then {m}_dw when source = 0 then {m}_wd else {m}_ww end"
_RATES = f"""select s.entity, s.month_ordinal, target, any_value(case target when 0 then 0.5::double else 0.25::double end) as base,
      coalesce(sum(case when source = target then {_PICK("alpha")} * {_PICK("beta")} * exp(-({_PICK("beta")}) * (s.month_ordinal - e.month_ordinal) / 12.0::double) end), 0) as self_rate,
      coalesce(sum(case when source <> target then {_PICK("alpha")} * {_PICK("beta")} * exp(-({_PICK("beta")}) * (s.month_ordinal - e.month_ordinal) / 12.0::double) end), 0) as cross_rate
    from (select entity, month_ordinal, unnest([0, 1]) as target from series) s join (select entity, {_PARTS} from info) m using (entity)
    left join (select entity, month_ordinal, case event_type when 'high' then 1 else 0 end as source from extreme) e on e.entity = s.entity and e.month_ordinal < s.month_ordinal and s.month_ordinal - e.month_ordinal <= 36 group by 1, 2, 3"""


@query(f"select *, base + self_rate + cross_rate as rate from ({_RATES})", "base self_rate cross_rate rate")
def monthly_excitation(spark, d):
    return fits.monthly_excitation(_events(spark, d), _models(spark, d), A.series(spark, d))


@query(f"""with r as (select *, cross_rate / (base + self_rate + cross_rate) as score from ({_RATES})), l as (select entity, target, round(quantile_cont(score, 0.95), 9) as level from r group by 1, 2)
    select r.entity, month_ordinal, r.target, score, level, round(score, 9) >= level and score > 0 as significant from r join l on r.entity = l.entity and r.target = l.target""", "score level")
def significant_transitions(spark, d):
    return fits.significant_transitions(fits.monthly_excitation(_events(spark, d), _models(spark, d), A.series(spark, d)))


def _judged(spark, d):
    """The stand-ins with what a fit says about itself."""
    e = F.col("entity")
    radius = fits.spectral_radius(F.col("alpha_dd"), F.col("alpha_dw"), F.col("alpha_wd"), F.col("alpha_ww")) * (1 + e % 3)
    return _models(spark, d).withColumns({"converged": e % 5 != 0, "error": F.when(e % 13 == 0, F.lit("failed")), "n_events": e % 30, "log_likelihood": -(e % 11).cast("double"), "p_dry_to_wet": (e % 9).cast("double") / 100, "p_wet_to_dry": (e % 8).cast("double") / 100, "spectral_radius": radius})


_JUDGED = f"""select *, entity % 5 <> 0 as converged, entity % 13 = 0 as failed, entity % 30 as n_events, -cast(entity % 11 as double) as log_likelihood, cast(entity % 9 as double) / 100 as p_d, cast(entity % 8 as double) / 100 as p_w,
    ((alpha_dd + alpha_ww) / 2 + sqrt(pow((alpha_dd - alpha_ww) / 2, 2) + alpha_dw * alpha_wd)) * (1 + entity % 3) as radius from (select entity, {_PARTS} from info)"""


@query(f"""with j as (select * from ({_JUDGED}) where converged and not failed and n_events >= 12)
    select * from (select entity, 'dry_to_wet' as direction, p_d as p, alpha_wd as alpha, 1 - exp(-0.25::double * beta_wd) as mass from j union all select entity, 'wet_to_dry', p_w, alpha_dw, 1 - exp(-0.25::double * beta_dw) from j) where p < 0.05 and alpha >= 1e-3 and mass >= 0.5""", "p alpha mass")
def short_memory_transitions(spark, d):
    return fits.short_memory(_judged(spark, d))


@query(f"""with j as ({_JUDGED}), g as (select * from j where converged and not failed)
    select n_rows, n_converged, n_failed, n_converged / n_rows as convergence_rate, n_failed / n_rows as failure_rate, q1_events, median_events, q3_events, median_likelihood_per_event, median_spectral_radius, stable_ratio
    from (select count(*) as n_rows, count(*) filter (converged) as n_converged, count(*) filter (failed) as n_failed from j),
      (select quantile_cont(n_events, 0.25) as q1_events, quantile_cont(n_events, 0.5) as median_events, quantile_cont(n_events, 0.75) as q3_events, quantile_cont(log_likelihood / nullif(n_events, 0), 0.5) as median_likelihood_per_event, quantile_cont(radius, 0.5) as median_spectral_radius, avg(case when radius < 1 then 1.0 else 0.0 end) as stable_ratio from g)""", "convergence_rate failure_rate q1_events median_events q3_events median_likelihood_per_event median_spectral_radius stable_ratio")
def overall_fit_quality(spark, d):
    return fits.overall_quality(_judged(spark, d))


@query()
def fitted_months(spark, d):
    events = _events(spark, d)
    return fits.monthly_excitation(events, fits.excitation(events, _span(spark, d)).where("error is null"), A.series(spark, d))


@query()
def shift_labels(spark, d):
    rows = A.series(spark, d)
    return fits.shift_labels(rows, A.frozen(rows))


@query()
def quality_flags_with_shift(spark, d):
    rows = A.series(spark, d)
    return quality.classify(rows, A.info(spark, d).withColumn("area", F.col("area") * 100), fits.shift_labels(rows, A.frozen(rows)), A.frozen(rows))
