"""Grid and zonal queries over the derived results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import series as S
from ..sources import adapters as A
from .registry import query
from .series_queries import labelled

_EDGES = "cell_y * 0.5::double as cell_lat, cell_x * 0.5::double as cell_lon"


def _counts(facts: str, key: str = "") -> str:
    k = f", {key}" if key else ""
    return f"select {_EDGES}{k}, count(distinct entity) as entity_count, cast(count(*) as bigint) as event_count from {facts} join cells using (entity) group by cell_y, cell_x{k}"


@query(_counts("extreme"))
def grid_extremes(spark, d):
    return G.counts(S.extremes(labelled(spark, d)), A.info(spark, d))


@query(_counts("extreme", "event_type"))
def grid_extremes_by_type(spark, d):
    return G.counts(S.extremes(labelled(spark, d)), A.info(spark, d), ["event_type"])


@query(_counts("transition"))
def grid_transitions(spark, d):
    return G.counts(S.abrupt_transitions(labelled(spark, d)), A.info(spark, d))


@query(_counts("transition", "transition_type"))
def grid_transitions_by_type(spark, d):
    return G.counts(S.abrupt_transitions(labelled(spark, d)), A.info(spark, d), ["transition_type"])


_SIDES = "count(*) filter (extreme_label = 'extreme_high') as high, count(*) filter (extreme_label = 'extreme_low') as low, count(*) filter (extreme_label <> 'normal') as either"
_STATS = ", ".join(f"avg({c}) as mean_{c}, median({c}) as median_{c}" for c in ("high", "low", "either"))
_STAT_NAMES = " ".join(f"{s}_{c}" for c in ("high", "low", "either") for s in ("mean", "median"))


def _sides():
    label = F.col("extreme_label")
    return {"high": (label == "extreme_high").cast("long"), "low": (label == "extreme_low").cast("long"), "either": (label != "normal").cast("long")}


@query(f"select cell_y * 30.0::double as cell_lat, cell_x * 30.0::double as cell_lon, count(*) as entity_count, {_STATS} from (select entity, {_SIDES} from labelled group by 1) join wide_cells using (entity) group by cell_y, cell_x", _STAT_NAMES)
def grid_per_entity_stats(spark, d):
    return G.per_entity_stats(labelled(spark, d), A.info(spark, d), _sides(), size=30.0)


@query(f"select cell_y * 30.0::double as cell_lat, cell_x * 30.0::double as cell_lon, month, count(*) as entity_count, {_STATS} from (select entity, month, {_SIDES} from labelled group by 1, 2) join wide_cells using (entity) group by cell_y, cell_x, month", _STAT_NAMES)
def grid_monthly_exceedance(spark, d):
    return G.per_entity_stats(labelled(spark, d), A.info(spark, d), _sides(), ["month"], 30.0)


def _fits(spark, d):
    return A.tail_fits(A.series(spark, d))


@query(f"select {_EDGES}, count(*) as n, avg(cast(converged as int)) as convergence_rate from fits join cells using (entity) group by cell_y, cell_x", "convergence_rate")
def grid_convergence(spark, d):
    return G.rates(_fits(spark, d), A.info(spark, d))


_MEASURES = ("xi", "sigma", "threshold", "n_extremes", "n_observations", "frequency")
_MEDIANS = ", ".join([f"median({c}) as median_{c}" for c in _MEASURES] + [f"avg({c}) as mean_{c}" for c in _MEASURES[3:]])
_MEDIAN_NAMES = " ".join([f"median_{c}" for c in _MEASURES] + [f"mean_{c}" for c in _MEASURES[3:]])
_WIDE_EDGES = "cell_y * 30.0::double as cell_lat, cell_x * 30.0::double as cell_lon"


def _tails(spark, d):
    return _fits(spark, d).withColumn("frequency", F.col("n_extremes") / F.col("n_observations"))


@query(f"select {_WIDE_EDGES}, tail, threshold_quantile, count(*) as n, {_MEDIANS} from (select *, n_extremes / n_observations as frequency from fits) join wide_cells using (entity) where converged group by cell_y, cell_x, tail, threshold_quantile", f"threshold_quantile {_MEDIAN_NAMES}")
def grid_converged(spark, d):
    return G.medians(_tails(spark, d), A.info(spark, d), list(_MEASURES), ["tail", "threshold_quantile"], 30.0, _MEASURES[3:])


_TAIL = "select {0}, count(*) as entity_count, avg(n_extremes / n_observations) as f from fits join wide_cells using (entity) where converged and tail = '{1}' and threshold_quantile = 0.95 group by cell_y, cell_x"


@query(f"""with a as (select {_WIDE_EDGES}, count(*) as entity_count, {_STATS} from (select entity, {_SIDES} from labelled group by 1) join wide_cells using (entity) group by cell_y, cell_x),
    h as ({_TAIL.format(_WIDE_EDGES, "high")}), l as ({_TAIL.format(_WIDE_EDGES, "low")})
    select cell_lat, cell_lon, greatest(coalesce(a.entity_count, 0), coalesce(h.entity_count, 0), coalesce(l.entity_count, 0)) as entity_count, coalesce(mean_high, 0) as left_high, coalesce(mean_low, 0) as left_low, coalesce(h.f, 0) as right_high, coalesce(l.f, 0) as right_low
    from a full join h using (cell_lat, cell_lon) full join l using (cell_lat, cell_lon)""", "left_high left_low right_high right_low")
def grids_of_two_methods(spark, d):
    info, fits = A.info(spark, d), _tails(spark, d).where("threshold_quantile = 0.95")
    left = G.per_entity_stats(labelled(spark, d), info, _sides(), size=30.0)
    side = lambda tail: G.medians(fits.where(F.col("tail") == tail), info, [], size=30.0, means=("frequency",)).withColumnRenamed("n", "entity_count")
    return G.side_by_side([(left, {"mean_high": "left_high", "mean_low": "left_low"}), (side("high"), {"mean_frequency": "right_high"}), (side("low"), {"mean_frequency": "right_low"})])


@query("""select cell_y * 30.0::double as cell_lat, cell_x * 30.0::double as cell_lon, month, count(*) as n, median(threshold_high) as median_threshold_high, median(threshold_low) as median_threshold_low
    from (select entity, month, any_value(threshold_high) as threshold_high, any_value(threshold_low) as threshold_low from labelled group by 1, 2) join wide_cells using (entity) group by cell_y, cell_x, month""", "median_threshold_high median_threshold_low")
def grid_monthly_threshold(spark, d):
    per = labelled(spark, d).groupBy("entity", "month").agg(F.first("threshold_high").alias("threshold_high"), F.first("threshold_low").alias("threshold_low"))
    return G.medians(per.withColumn("converged", F.lit(True)), A.info(spark, d), ["threshold_high", "threshold_low"], ["month"], 30.0)


@query(f"""with f as (select entity, threshold_quantile, tail, n_extremes / n_observations as f from fits where converged), b as (select h.entity, h.threshold_quantile, h.f + l.f as total from f h join f l on h.entity = l.entity and h.threshold_quantile = l.threshold_quantile where h.tail = 'high' and l.tail = 'low')
    select cell_y * 30.0::double as cell_lat, cell_x * 30.0::double as cell_lon, threshold_quantile, count(*) as n, avg(total) as mean_frequency, median(total) as median_frequency from b join wide_cells using (entity) group by cell_y, cell_x, threshold_quantile""", "threshold_quantile mean_frequency median_frequency")
def grid_tail_frequencies(spark, d):
    return G.frequencies(_fits(spark, d), A.info(spark, d), 30.0)


@query("""with a as (select entity, count(*) as n, count(*) filter (extreme_label = 'extreme_high') as high, count(*) filter (extreme_label = 'extreme_low') as low from labelled group by 1),
    b as (select entity, count(*) as n, count(*) filter (index_value >= 50000) as high, count(*) filter (index_value <= -50000) as low from labelled group by 1),
    c as (select cell_x, cell_y, cast(sum(a.n) as bigint) as a_n, cast(sum(a.high) as bigint) as a_high, cast(sum(a.low) as bigint) as a_low, cast(sum(b.n) as bigint) as b_n, cast(sum(b.high) as bigint) as b_high, cast(sum(b.low) as bigint) as b_low
      from a join b using (entity) join wide_cells using (entity) group by 1, 2)
    select cell_y * 30.0::double as cell_lat, cell_x * 30.0::double as cell_lon, a_n, a_high, a_low, b_n, b_high, b_low, a_high / a_n - b_high / b_n as high_rate_difference, a_low / a_n - b_low / b_n as low_rate_difference from c""", "high_rate_difference low_rate_difference")
def grid_exceedance_comparison(spark, d):
    rows, i = labelled(spark, d), F.col("index_value")
    label = F.col("extreme_label")
    a = rows.select("entity", (label == "extreme_high").alias("high"), (label == "extreme_low").alias("low"))
    b = rows.select("entity", (i >= 50000).alias("high"), (i <= -50000).alias("low"))
    return G.exceedance_comparison(a, b, A.info(spark, d), 30.0)


_CLIPPED = """select cast(least(greatest(floor((lat + 90) / 30), 0), 5) as bigint) as row, cast(least(greatest(floor((lon + 180) / 30), 0), 11) as bigint) as "column", count(*) as entity_count, cast(sum(n) as bigint) as event_count, sum(n) / count(*) as mean_per_entity
    from (select entity, count(*) as n from extreme group by 1) join info using (entity) group by 1, 2"""


@query(_CLIPPED, "mean_per_entity")
def grid_clipped_counts(spark, d):
    return G.clipped_counts(S.extremes(labelled(spark, d)), A.info(spark, d), 30.0)


@query("""select cell_y * 30.0::double as cell_lat, cell_x * 30.0::double as cell_lon, count(distinct entity) as entity_count, median(value) as median_value, stddev_pop(value) as spread, sum(value) as total from series join wide_cells using (entity) group by cell_y, cell_x""", "median_value spread total")
def grid_stats(spark, d):
    return G.stats(A.series(spark, d), A.info(spark, d), {"median_value": ("value", "median"), "spread": ("value", "std"), "total": ("value", "sum")}, 30.0)


@query(f"""select cast(floor(cell_lat / 10) * 10 as int) as band, sum(entity_count * event_count) / sum(entity_count) as zonal_mean, cast(sum(entity_count) as bigint) as weight from ({_counts("extreme")}) group by 1""", "zonal_mean")
def zonal_mean(spark, d):
    return G.zonal_mean(G.counts(S.extremes(labelled(spark, d)), A.info(spark, d)), "event_count")


@query(f"""select cast(floor(cell_lat / 5) * 5 as int) as band, sum(entity_count * mean_high) / sum(entity_count) as mean_high, sum(entity_count * mean_low) / sum(entity_count) as mean_low, cast(sum(entity_count) as bigint) as weight
    from (select {_EDGES}, count(*) as entity_count, {_STATS} from (select entity, {_SIDES} from labelled group by 1) join cells using (entity) group by cell_y, cell_x) where entity_count >= 1 group by 1""", "mean_high mean_low")
def zonal_profile(spark, d):
    return G.zonal_profile(G.per_entity_stats(labelled(spark, d), A.info(spark, d), _sides()), ["mean_high", "mean_low"])


@query(f"""select r as row, c as "column", event_count from (select unnest(range(6)) as r) cross join (select unnest(range(12)) as c) left join ({_CLIPPED}) g on g.row = r and g."column" = c""")
def grid_dense(spark, d):
    return G.dense(G.clipped_counts(S.extremes(labelled(spark, d)), A.info(spark, d), 30.0), "event_count", 6, 12)


@query(f"""select coalesce(a.cell_lat, b.cell_lat) as cell_lat, coalesce(a.cell_lon, b.cell_lon) as cell_lon, coalesce(a.event_count, 0) as extremes, coalesce(b.event_count, 0) as transitions, greatest(coalesce(a.entity_count, 0), coalesce(b.entity_count, 0)) as entity_count
    from ({_counts("extreme")}) a full join ({_counts("transition")}) b on a.cell_lat = b.cell_lat and a.cell_lon = b.cell_lon""")
def grids_merged(spark, d):
    rows, info = labelled(spark, d), A.info(spark, d)
    return G.merge_grids([G.counts(S.extremes(rows), info), G.counts(S.abrupt_transitions(rows), info)], ["extremes", "transitions"])


@query(f"select *, event_count / entity_count as mean_per_entity from ({_counts('extreme')}) where entity_count >= 1", "mean_per_entity")
def grid_busy_cells(spark, d):
    return G.busy_cells(G.counts(S.extremes(labelled(spark, d)), A.info(spark, d)), 1)
