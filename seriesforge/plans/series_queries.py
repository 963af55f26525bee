"""Queries of the ordered-series, quality, entropy and pair operators over the derived series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entropy, meteo, pairs, quality
from ..operators import series as S
from ..sources import adapters as A
from .registry import query


def labelled(spark, d):
    return S.label(S.thresholds(S.climatology_anomaly(A.series(spark, d))))


def decayed(spark, d):
    return S.decay_index(S.phi(S.strengths(labelled(spark, d)), "normalize"))


@query("select entity, year, month, value from series where entity >= 10 and entity < 40", "value")
def series_scan_range(spark, d):
    return S.in_range(A.series(spark, d), 10, 40).select("entity", "year", "month", "value")


@query("select entity, year, month, value from series where entity in (select entity from info where kind = 1)", "value")
def series_scan_ids(spark, d):
    return S.of_entities(A.series(spark, d), A.info(spark, d).where("kind = 1")).select("entity", "year", "month", "value")


@query("select entity, year * 100 + month as year_month from series semi join frozen using (entity, month_ordinal)")
def frozen_scan(spark, d):
    rows = A.series(spark, d)
    return rows.join(A.frozen(rows), ["entity", "month_ordinal"], "left_semi").select("entity", (F.col("year") * 100 + F.col("month")).alias("year_month"))


@query("""select entity, year, month, month_ordinal, min(value) as value, year * 100 + month as year_month
    from (select * from series union all select entity, year, month, month_ordinal, value + 1 from series where entity < 20) group by 1, 2, 3, 4""", "value")
def normalised_series(spark, d):
    rows = A.series(spark, d)
    return S.normalise(rows.unionByName(rows.where("entity < 20").withColumn("value", F.col("value") + 1)))


@query("select * from series anti join frozen using (entity, month_ordinal)", "value")
def series_without_frozen(spark, d):
    rows = A.series(spark, d)
    return S.without_frozen(rows, A.frozen(rows))


_RUNS = """select entity, min(month_ordinal) as first, max(month_ordinal) as last, count(*) as months
    from (select *, month_ordinal - row_number() over (partition by entity order by month_ordinal) as g from frozen) group by entity, g"""


@query(_RUNS)
def frozen_runs(spark, d):
    return S.frozen_runs(A.frozen(A.series(spark, d)))


@query(f"select * from series s where not exists (select 1 from frozen f where f.entity = s.entity and f.month_ordinal = s.month_ordinal) or exists (select 1 from ({_RUNS}) r where r.entity = s.entity and r.first = s.month_ordinal)", "value")
def defrozen_series(spark, d):
    rows = A.series(spark, d)
    return S.without_frozen_but_anchors(rows, A.frozen(rows))


@query(f"""select s.entity, s.month_ordinal, s.value, coalesce(a.value, s.value) as held from series s left join ({_RUNS}) r on r.entity = s.entity and s.month_ordinal between r.first and r.last
    left join series a on a.entity = r.entity and a.month_ordinal = r.first""", "value held")
def held_plateaus(spark, d):
    rows = A.series(spark, d)
    return S.hold_plateaus(rows, A.frozen(rows)).select("entity", "month_ordinal", "value", "held")


@query("select entity, month_ordinal, (year - min(year) over (partition by entity)) + (month - 1) / 12.0::double as time, -value as value from series", "time value")
def low_tail_on_time_axis(spark, d):
    return S.for_tail(S.with_time(A.series(spark, d)), "low").select("entity", "month_ordinal", "time", "value")


@query("""select entity, cast(sum(n) as bigint) as n from (select entity, month, count(*) as n from gappy group by 1, 2) group by entity having sum(n) >= 12 and count(*) >= 12 and min(n) >= 1""")
def entities_with_enough_months(spark, d):
    return S.enough_months(A.gappy_series(spark, d), 1, 12)


@query("select entity, year, month, value, climatology, index_value from indexed", "value climatology index_value")
def climatology_anomaly(spark, d):
    return S.climatology_anomaly(A.series(spark, d)).select("entity", "year", "month", "value", "climatology", "index_value")


@query("""select entity, month_ordinal, case when count(*) over (partition by entity, month) >= 2 then count(*) over (partition by entity, month order by value range unbounded preceding) * 100.0::double
    / (count(*) over (partition by entity, month) + 1) end as percentile from series""", "percentile")
def monthly_percentile_rank(spark, d):
    return S.percentile_rank(A.series(spark, d)).select("entity", "month_ordinal", "percentile")


@query("select entity, year, month, index_value, threshold_low, threshold_high, extreme_label from labelled", "index_value threshold_low threshold_high")
def quantile_labels(spark, d):
    return labelled(spark, d).select("entity", "year", "month", "index_value", "threshold_low", "threshold_high", "extreme_label")


@query("select *, abs(index_value - threshold) as severity from extreme", "value climatology index_value threshold severity")
def extreme_events(spark, d):
    return S.severities(S.extremes(labelled(spark, d)))


@query("select * from transition", "from_index to_index")
def abrupt_transitions(spark, d):
    return S.abrupt_transitions(labelled(spark, d))


@query("""select entity, year, month, month_ordinal, value, round(z, 3) as z, case when z > 0 then 'high' else 'low' end as event_type
    from (select *, (value - avg(value) over (partition by entity)) / nullif(stddev_pop(value) over (partition by entity), 0) as z from series) where abs(z) > 2""", "value z")
def zscore_events(spark, d):
    return S.zscore_events(A.series(spark, d), 2.0)


@query("select entity, month_ordinal, value - (climatology - avg(value) over (partition by entity)) as deseasoned from clim", "deseasoned")
def deseasonalised(spark, d):
    return S.deseasonalise(A.series(spark, d)).select("entity", "month_ordinal", "deseasoned")


@query("select entity, var_pop(climatology - m) / nullif(var_pop(value), 0) as dominance from (select *, avg(value) over (partition by entity) as m from clim) group by entity", "dominance")
def seasonality_dominance(spark, d):
    return S.seasonality_dominance(A.series(spark, d))


_COARSE = """select *, cast(floor(value / 200000) * 200000 as double) as coarse from series"""
_SEGMENTS = f"""select entity, min(pos) - 1 as first_pos, max(pos) + 1 as last_pos, cast(min(ob) as int) as first_ordinal, any_value(n_obs) as n_obs, max(greatest(abs(d1), abs(d2))) <= 1e-6 as flat, max(pos) - min(pos) + 3 as points
    from (select *, pos - row_number() over (partition by entity order by pos) as g from (
      select entity, month_ordinal, row_number() over w as pos, coarse - lag(coarse) over w as d1, lead(coarse) over w - coarse as d2, month_ordinal - lag(month_ordinal) over w as g1,
        lead(month_ordinal) over w - month_ordinal as g2, lag(month_ordinal) over w as ob, count(*) over (partition by entity) as n_obs from ({_COARSE}) where coarse > 0 window w as (partition by entity order by month_ordinal))
      where g1 = 1 and g2 = 1 and abs(d1 - d2) <= 1e-6) group by entity, g having max(pos) - min(pos) + 3 >= 3"""


def _coarse(spark, d):
    return A.series(spark, d).withColumn("value", (F.floor(F.col("value") / 200000) * 200000).cast("double"))


@query(f"select entity, cast(first_pos as int) as first_pos, cast(last_pos as int) as last_pos, first_ordinal, n_obs, flat, cast(points as int) as points from ({_SEGMENTS})")
def collinear_segments(spark, d):
    return S.collinear_segments(_coarse(spark, d), 3)


@query(f"""with seg as ({_SEGMENTS}), pts as (select entity, count(distinct p) as c from (select entity, unnest(range(first_pos, last_pos + 1)) as p from seg) group by entity),
    n as (select entity, count(*) as n_obs from ({_COARSE}) where coarse > 0 group by entity),
    agg as (select entity, count(*) filter (not flat) as n_linear, count(*) filter (flat) as n_flat, max(points) filter (not flat) as max_linear, max(points) filter (flat) as max_flat, min(first_ordinal) filter (not flat) as first_linear_ordinal from seg group by entity)
    select n.entity, n_obs, cast(coalesce(n_linear, 0) as bigint) as n_linear, cast(coalesce(n_flat, 0) as bigint) as n_flat, cast(coalesce(max_linear, 0) as bigint) as max_linear, cast(coalesce(max_flat, 0) as bigint) as max_flat,
      coalesce(c, 0) / n_obs as collinear_ratio, first_linear_ordinal from n left join agg using (entity) left join pts using (entity)""", "collinear_ratio")
def interpolation_summary(spark, d):
    return S.interpolation_summary(_coarse(spark, d), 3)


def _exceeding(spark, d):
    return labelled(spark, d).withColumns({"value": F.col("index_value"), "threshold": F.col("threshold_high")})


_CLUSTERS = """select *, sum(case when gap is null or gap >= 3 then 1 else 0 end) over (partition by entity order by pos) as cluster_id from (
    select *, pos - lag(pos) over (partition by entity order by pos) - 1 as gap from (select entity, month_ordinal, index_value as value, threshold_high as threshold, row_number() over (partition by entity order by month_ordinal) as pos from labelled) where value > threshold)"""


@query(f"""select entity, cast(cluster_id as bigint) as cluster_id, size, month_ordinal, value, threshold from (select *, count(*) over (partition by entity, cluster_id) as size,
    row_number() over (partition by entity, cluster_id order by value desc, pos) as rn from ({_CLUSTERS})) where rn = 1""", "value threshold")
def declustered_exceedances(spark, d):
    return S.decluster(_exceeding(spark, d))


@query("select entity, row_number() over (partition by entity order by month_ordinal) as cluster_id, cast(1 as bigint) as size, month_ordinal, index_value as value, threshold_high as threshold from labelled where index_value > threshold_high", "value threshold")
def singleton_exceedances(spark, d):
    return S.singletons(_exceeding(spark, d))


@query("""with e as (select *, abs(index_value - threshold) as severity, lag(event_type) over w as pt, lag(month_ordinal) over w as po from extreme window w as (partition by entity order by month_ordinal)),
    c as (select *, sum(case when pt is null or pt <> event_type or month_ordinal - po - 1 >= 3 then 1 else 0 end) over (partition by entity order by month_ordinal) as cluster_id from e)
    select entity, cast(cluster_id as bigint) as cluster_id, size, event_type, month_ordinal, severity from (select *, count(*) over (partition by entity, cluster_id) as size, row_number() over (partition by entity, cluster_id order by severity desc, month_ordinal) as rn from c) where rn = 1""", "severity")
def typed_clusters(spark, d):
    return S.decluster_typed(S.severities(S.extremes(labelled(spark, d))))


@query("select entity, month_ordinal, strength, phi, decay_index from decayed", "strength phi decay_index")
def decay_index(spark, d):
    return decayed(spark, d).select("entity", "month_ordinal", "strength", "phi", "decay_index")


_PLACED = "select *, row_number() over w as pos, extreme_label <> 'normal' as ext, lag(extreme_label <> 'normal') over w as pe, lead(extreme_label <> 'normal') over w as ne, lag(phi) over w as pp, lead(phi) over w as np, month_ordinal - lag(month_ordinal) over w as g1, lead(month_ordinal) over w - month_ordinal as g2 from decayed window w as (partition by entity order by month_ordinal)"


def _segments_sql(bridge: str) -> str:
    return f"""select *, case when has_high = 1 and has_low = 1 then 'transition' else 'unilateral' end as segment_type, cast(row_number() over (partition by entity order by start_ordinal) as int) as segment_id from (
      select entity, min(month_ordinal) as start_ordinal, max(month_ordinal) as end_ordinal, count(*) as months, max(cast(extreme_label = 'extreme_high' as int)) as has_high, max(cast(extreme_label = 'extreme_low' as int)) as has_low,
        max(decay_index) as max_s, avg(decay_index) as mean_s, sum(decay_index) as sum_s, count(*) filter (ext) as n_extremes
      from (select *, pos - row_number() over (partition by entity order by month_ordinal) as g from ({_PLACED}) where ext or coalesce({bridge}, false)) group by entity, g)"""


@query(_segments_sql("pe and decay_index > 1"), "max_s mean_s sum_s")
def decay_segments(spark, d):
    return S.segments(decayed(spark, d))


@query(_segments_sql("pe and ne and pp * exp(-0.8 * g1) + np * exp(-0.8 * g2) > 0.3"), "max_s mean_s sum_s")
def bridged_segments(spark, d):
    rows = decayed(spark, d).withColumn("strength", F.col("phi"))
    return S.segments(rows, S.bidirectional_bridge(0.8, 0.3))


@query(f"""with seg as ({_segments_sql("pe and decay_index > 1")}), hit as (select r.*, segment_id from decayed r join seg s on r.entity = s.entity and r.month_ordinal between s.start_ordinal and s.end_ordinal where segment_type = 'transition' and extreme_label <> 'normal'),
    runs as (select *, sum(case when p is null or p <> extreme_label then 1 else 0 end) over (partition by entity, segment_id order by month_ordinal) as run_id from (select *, lag(extreme_label) over (partition by entity, segment_id order by month_ordinal) as p from hit))
    select entity, segment_id, cast(run_id as bigint) as run_id, extreme_label, month_ordinal, strength from (select *, row_number() over (partition by entity, segment_id, run_id order by strength desc, month_ordinal) as rn from runs) where rn = 1""", "strength")
def segment_events(spark, d):
    rows = decayed(spark, d)
    return S.segment_events(rows, S.segments(rows))


@query("""select entity, time, event_kind, cast(row_number() over (partition by entity order by time, event_kind) as int) as place from (select entity, floor(month_ordinal / 12) + (month_ordinal % 12) / 12.0::double as time, cast(case event_type when 'high' then 1 else 0 end as int) as event_kind from extreme)""", "time")
def event_timeline(spark, d):
    events = S.extremes(labelled(spark, d))
    return S.timeline(events.where("event_type = 'high'"), events.where("event_type = 'low'"))


# -- quality -------------------------------------------------------------------------------

_LEVELS = "select entity, count(value) as n_obs, median(value) as median, avg(value) as mean, quantile_cont(value, 0.8) as q, min(value) as least, max(value) as largest from series group by entity"
_FLAT = "select entity, cast(sum(n) as bigint) as n_obs, count(*) as n_unique, max(n) / sum(n) as dominant_ratio, count(*) / sum(n) as unique_ratio from vcounts group by entity"
_VOL = """select s.entity, n_obs, sd / mean as cv, e as entropy, e * sd / mean as h_cv from (select entity, count(*) as n_obs, avg(value) as mean, stddev_samp(value) as sd from series group by entity) s join
    (select entity, sum(-(n / t) * log2(n / t)) as e from (select *, sum(n) over (partition by entity) as t from ({0})) group by entity) using (entity)"""


@query(_LEVELS, "median mean q least largest")
def entity_levels(spark, d):
    return quality.levels(A.series(spark, d))


@query(_FLAT, "dominant_ratio unique_ratio")
def flatness(spark, d):
    return quality.flatness(A.series(spark, d), -3)


@query(_VOL.format("vcounts"), "cv entropy h_cv")
def penalised_volatility(spark, d):
    return quality.volatility(A.series(spark, d), -3)


_MOVING = "(select * from series anti join frozen using (entity, month_ordinal))"


@query(f"""with m as (select entity, month_ordinal, round(value, -5) as value from {_MOVING}), o as (select *, lag(value) over w as before, row_number() over w as rn from m window w as (partition by entity order by month_ordinal)),
    c as (select entity, coalesce(stddev_samp((value - before) / nullif(before, 0)), 0) as std_change, cast(sum(case when value = before then 1 else 0 end) as bigint) as n_zero_delta, count(*) as n_transitions from o where rn > 1 group by 1),
    v as (select entity, cast(sum(n) as bigint) as n_obs, count(*) as n_distinct, avg(value) as mean, stddev_samp(value) as sd, max(n) / sum(n) as dominant_ratio from (select entity, value, count(*) as n from m group by 1, 2) group by 1)
    select entity, n_obs, n_distinct, case when mean > 0 then sd / mean end as cv, dominant_ratio, std_change, n_zero_delta, n_transitions, case when n_zero_delta > 0 then std_change / sqrt(n_zero_delta) else std_change end as penalised_volatility, coalesce(n_frozen, 0) as n_frozen
    from v join c using (entity) left join (select entity, count(*) as n_frozen from frozen group by 1) f using (entity)""", "cv dominant_ratio std_change penalised_volatility")
def penalised_changes(spark, d):
    rows = A.series(spark, d)
    return quality.penalised_changes(rows.withColumn("value", F.round("value", -5)), A.frozen(rows))


_CLASSIFIED = f"""select l.entity, mean as mean_area, median as median_area, coalesce(area, 0) as atlas_area, cast(case when q = 0 then 1 else 0 end + case when dr >= 0.8 then 2 else 0 end
      + case when not coalesce(area > 0, false) or median / area < 0.1 or median / area > 10 then 4 else 0 end + case when area > 0 and (area < 0.5 * r.least or area > 1.5 * r.largest) then 8 else 0 end + case when h_cv <= 0.001 then 16 else 0 end as int) as flags
    from ({_LEVELS}) l left join (select entity, max(n) / sum(n) as dr from (select entity, value, count(*) as n from {_MOVING} group by 1, 2) group by entity) using (entity)
    left join (select entity, min(value) as least, max(value) as largest from {_MOVING} group by 1) r using (entity)
    left join (select entity, h_cv from ({_VOL.format(f"select entity, value, count(*) as n from {_MOVING} group by 1, 2").replace("from series group", f"from {_MOVING} group")})) using (entity) left join (select entity, area * 100 as area from info) using (entity)"""


def _classified(spark, d):
    rows = A.series(spark, d)
    return quality.classify(rows, A.info(spark, d).withColumn("area", F.col("area") * 100), frozen=A.frozen(rows))


@query(_CLASSIFIED, "mean_area median_area atlas_area")
def quality_flags(spark, d):
    return _classified(spark, d)


@query(f"select * exclude (flags) from ({_CLASSIFIED}) where flags = 0", "mean_area median_area atlas_area")
def quality_routed(spark, d):
    return quality.route(_classified(spark, d))[0]


@query(f"select flags, count(*) as n, " + ", ".join(f"cast(flags & {b} > 0 as int) as bit_{b}" for b in (1, 2, 4, 8, 16, 32)) + f" from ({_CLASSIFIED}) group by flags")
def flag_sets(spark, d):
    return quality.flag_sets(_classified(spark, d))


_COMPARED = f"select *, area_ratio - 1 as relative_difference, case when area_ratio > 0 then log2(area_ratio) end as log2_ratio, case when area_ratio between 0.5 and 2 then 'good' when area_ratio between 0.2 and 5 then 'moderate' else 'poor' end as agreement from (select entity, median_area, atlas_area, case when atlas_area > 0 then median_area / atlas_area end as area_ratio from ({_CLASSIFIED}))"


@query(_COMPARED, "median_area atlas_area area_ratio relative_difference log2_ratio")
def area_comparison(spark, d):
    return quality.compare_areas(_classified(spark, d))


@query(f"""select n, q[1] as p05, q[2] as p25, q[3] as p50, q[4] as p75, q[5] as p95, q[4] - q[2] as iqr, mean_log2, std_log2, over, under, within from (select count(*) as n, quantile_cont(area_ratio, [0.05, 0.25, 0.5, 0.75, 0.95]) as q, avg(log2_ratio) as mean_log2, stddev_pop(log2_ratio) as std_log2,
    count(*) filter (area_ratio > 2) as over, count(*) filter (area_ratio < 0.5) as under, count(*) filter (area_ratio between 0.5 and 2) as within from ({_COMPARED}))""", "p05 p25 p50 p75 p95 iqr mean_log2 std_log2")
def comparison_summary(spark, d):
    return quality.comparison_summary(quality.compare_areas(_classified(spark, d)))


@query(f"select agreement, count(c.entity) as n from (values ('good'), ('moderate'), ('poor')) v(agreement) left join ({_COMPARED}) c using (agreement) group by agreement")
def agreement_counts(spark, d):
    return quality.agreement_counts(quality.compare_areas(_classified(spark, d)))


@query(f"select case when r < 2 then '1-2' when r < 5 then '2-5' when r < 10 then '5-10' else '10+' end as bin, count(*) as n from (select greatest(area_ratio, 1 / area_ratio) as r from ({_COMPARED}) where area_ratio > 0) group by 1")
def ratio_bins(spark, d):
    return quality.ratio_bins(quality.compare_areas(_classified(spark, d)))


@query("""select entity, stddev_samp(c) / sqrt(greatest(sum(cast(value = p as int)), 1)) as penalised from (select *, (value - p) / nullif(p, 0) as c from (select *, lag(value) over (partition by entity order by month_ordinal) as p from series)) group by entity""", "penalised")
def legacy_volatility(spark, d):
    return quality.legacy_volatility(A.series(spark, d))


@query(f"select entity, flags & ~1 as flags from flagged where flags & 1 > 0 and entity in (select entity from ({_LEVELS}) where q > 0)")
def zero_quantile_recheck(spark, d):
    return quality.recheck_zero_quantile(A.series(spark, d), A.flags(A.info(spark, d)))


# -- entropy and trends --------------------------------------------------------------------

_AE = """select entity, sum(case when s > 0 then -(s / t) * log2(s / t) else 0 end) / log2(12) as ae from (select *, sum(s) over (partition by entity) as t from (select entity, m - min(m) over (partition by entity) as s from
    (select e.entity, k.month, coalesce(avg(value), 0) as m from (select distinct entity from {0}) e cross join (select unnest(range(1, 13)) as month) k left join {0} s on s.entity = e.entity and s.month = k.month group by 1, 2))) where t > 0 group by entity"""


@query(_AE.format("gappy"), "ae")
def overall_entropy(spark, d):
    return entropy.overall_entropy(A.gappy_series(spark, d))


_ANNUAL = """select *, ae - avg(ae) over (partition by entity) as ae_anomaly from (select entity, year, sum(case when s > 0 then -(s / t) * log2(s / t) else 0 end) / log2(12) as ae from (select *, sum(s) over w as t, count(*) over w as n from
    (select *, value - min(value) over (partition by entity, year) as s from series) window w as (partition by entity, year)) where n >= 10 and t > 0 group by 1, 2)"""


@query(_ANNUAL, "ae ae_anomaly")
def annual_entropy(spark, d):
    return entropy.annual_entropy(A.series(spark, d))


@query("""with p as (select entity, row_number() over (partition by entity order by year) as i, value as x from years), n as (select entity, count(*) as n, avg(x) as mean from p group by entity having count(*) >= 5),
    s as (select a.entity, cast(sum(sign(b.x - a.x)) as bigint) as s, quantile_cont((b.x - a.x) / (b.i - a.i), 0.5) as slope from p a join p b on a.entity = b.entity and a.i < b.i group by 1),
    t as (select entity, sum(t * (t - 1) * (2 * t + 5)) as ties from (select entity, x, count(*) as t from p group by 1, 2) group by 1),
    z as (select *, case when s = 0 then 0 else (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0::double) end as z from n join s using (entity) join t using (entity))
    select entity, n, s, z, slope, case when z > 1.959963984540054 then 'increasing' when z < -1.959963984540054 then 'decreasing' else 'no trend' end as trend, slope / mean * 1000 as change_per_decade_pct from z""", "z slope change_per_decade_pct")
def mann_kendall_trend(spark, d):
    years = A.series(spark, d).groupBy("entity", "year").agg(F.avg("value").alias("value"))
    return entropy.trend(years, "value", 5)


_AMP = "select entity, case when mean > 0 then sd / mean end as amplitude from (select entity, stddev_pop(value) as sd from years group by 1) join (select entity, avg(value) as mean from series group by 1) using (entity)"


@query(_AMP, "amplitude")
def amplitude_ratio(spark, d):
    return entropy.amplitude_ratio(A.series(spark, d))


@query(f"""with r as (select round(amplitude, 9) as x, round(ae, 9) as y from ({_AMP}) join ({_AE.format("series")}) using (entity)),
    k as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as ry from r)
    select count(*) as n, corr(x, y) as pearson, corr(rx, ry) as spearman, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from k""", "pearson spearman slope intercept")
def amplitude_entropy_regression(spark, d):
    rows = A.series(spark, d)
    both = entropy.amplitude_ratio(rows).join(entropy.overall_entropy(rows), "entity")
    return entropy.regression(both.select(F.round("amplitude", 9).alias("x"), F.round("ae", 9).alias("y")), "x", "y")


@query(f"""with a as ({_AMP}), q as (select quantile_cont(abs(amplitude), 0.25) as q1, quantile_cont(abs(amplitude), 0.75) as q3 from a)
    select a.* from a, q where amplitude is null or abs(amplitude) between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""", "amplitude")
def amplitude_without_outliers(spark, d):
    return entropy.without_outliers(entropy.amplitude_ratio(A.series(spark, d)), "amplitude")


# -- pairs ---------------------------------------------------------------------------------


def mates(spark, d):
    ids = A.info(spark, d).select("entity")
    return ids.select("entity", (F.col("entity") + 1).alias("partner")).join(ids.withColumnRenamed("entity", "partner"), "partner", "left_semi").select("entity", "partner")


@query("""with q as (select *, unnest(range(1, 12)) as level from info where kind <> 1), c as (select *, unnest(range(1, 12)) as level from info where kind = 1),
    f as (select q.entity, c.entity as partner, q.level, sqrt((q.lat - c.lat) * (q.lat - c.lat) + (q.lon - c.lon) * (q.lon - c.lon)) as distance from q join c on q.level = c.level and q.code // (10 ** (11 - q.level))::bigint = c.code // (10 ** (11 - c.level))::bigint
      where q.area <= 0 or c.area <= 0 or greatest(q.area / nullif(c.area, 0), c.area / nullif(q.area, 0)) <= 10),
    b as (select *, row_number() over (partition by entity order by level desc, distance, partner) as rn from f)
    select i.entity, partner, cast(level as int) as level, distance from info i left join (select * from b where rn = 1) b on b.entity = i.entity where kind <> 1""", "distance")
def nearest_partner(spark, d):
    rows = A.info(spark, d)
    return pairs.nearest(rows.where("kind <> 1"), rows.where("kind = 1"))


_M = """select entity, count(*) as n_obs, stddev_pop(value) / nullif(avg(value), 0) as cv, (max(value) - min(value)) / nullif(avg(value), 0) as range_ratio, stddev_pop(c) as change_std from
    (select *, (value - p) / nullif(p, 0) * 100 as c from (select *, lag(value) over (partition by entity order by month_ordinal) as p from series)) group by entity"""


@query(_M, "cv range_ratio change_std")
def entity_metrics(spark, d):
    return pairs.metrics(A.series(spark, d))


@query(f"""select m.partner, m.entity, a.n_obs as a_n_obs, a.cv as a_cv, a.range_ratio as a_range_ratio, a.change_std as a_change_std, b.n_obs as b_n_obs, b.cv as b_cv, b.range_ratio as b_range_ratio, b.change_std as b_change_std,
    a.cv - b.cv as delta_cv, a.range_ratio - b.range_ratio as delta_range_ratio, a.change_std - b.change_std as delta_change_std from mates m join ({_M}) a on a.entity = m.entity join ({_M}) b on b.entity = m.partner""",
    "a_cv a_range_ratio a_change_std b_cv b_range_ratio b_change_std delta_cv delta_range_ratio delta_change_std")
def pair_metrics(spark, d):
    return pairs.pair_metrics(mates(spark, d), A.series(spark, d))


_LAGS = ", ".join(f"sum({c} * {c}{k}) as {c}_{k}" for c in "uv" for k in range(1, 13))
_NORM = lambda c: "sqrt(" + " + ".join(f"{c}_{k} * {c}_{k}" for k in range(1, 13)) + ")"


@query(f"""with al as (select m.entity, m.partner, x.month_ordinal, x.value as x, y.value as y from mates m join series x on x.entity = m.entity join series y on y.entity = m.partner and y.month_ordinal = x.month_ordinal),
    ce as (select *, count(*) over w as n, x - avg(x) over w as u, y - avg(y) over w as v from al window w as (partition by entity, partner)),
    sh as (select *, {", ".join(f"lead({c}, {k}) over w as {c}{k}" for c in "uv" for k in range(1, 13))} from ce window w as (partition by entity, partner order by month_ordinal)),
    su as (select entity, partner, max(n) as n, sum(u * u) as uu, sum(v * v) as vv, sum(u * v) as uv, {_LAGS} from sh group by 1, 2)
    select entity, partner, n, uv / nullif(sqrt(uu * vv), 0) as pearson, least(greatest(({" + ".join(f"u_{k} * v_{k}" for k in range(1, 13))}) / nullif({_NORM("u")} * {_NORM("v")}, 0), -1), 1) as acf_cosine from su""", "pearson acf_cosine")
def pair_similarity(spark, d):
    return pairs.similarity(mates(spark, d), A.series(spark, d))


@query("""with z as (select entity, month_ordinal from (select *, (value - avg(value) over (partition by entity)) / nullif(stddev_pop(value) over (partition by entity), 0) as z from series) where abs(z) > 2)
    select m.entity, m.partner, (select count(*) from z where z.entity = m.entity) as a_events, (select count(*) from z where z.entity = m.partner) as b_events,
      (select count(*) from z where z.entity = m.entity and not exists (select 1 from z y where y.entity = m.partner and y.month_ordinal = z.month_ordinal)) as only_a,
      (select count(*) from z where z.entity = m.partner and not exists (select 1 from z y where y.entity = m.entity and y.month_ordinal = z.month_ordinal)) as only_b from mates m""")
def pair_events(spark, d):
    return pairs.pair_events(mates(spark, d), A.series(spark, d), 2.0)


@query("select entity, partner from mates where entity not in (select entity from flagged where flags > 5) and partner not in (select entity from flagged where flags > 5)")
def pairs_without_anomalous(spark, d):
    return pairs.without_anomalous(mates(spark, d), A.flags(A.info(spark, d)).where("flags > 5"))


@query("""with b as (select *, case when index_value <= -50000 then 'extreme_low' when index_value >= 50000 then 'extreme_high' else 'normal' end as other from labelled)
    select entity, count(*) as n, count(*) filter (extreme_label = 'extreme_high' and other = 'extreme_high') as high_agree, count(*) filter (extreme_label = 'extreme_low' and other = 'extreme_low') as low_agree,
      count(*) filter (extreme_label = 'normal' and other = 'normal') as normal_agree, count(*) filter (extreme_label <> other) as differ from b group by entity""")
def label_agreement(spark, d):
    a = labelled(spark, d)
    i = F.col("index_value")
    b = a.withColumn("extreme_label", F.when(i <= -50000, "extreme_low").when(i >= 50000, "extreme_high").otherwise("normal"))
    return pairs.label_agreement(a, b)


# -- daily records -------------------------------------------------------------------------


@query("select entity, cast(year(day) as int) as year, cast(month(day) as int) as month, cast(sum(cast(value as decimal(18,4))) as double) as total, avg(value) as mean, count(*) as n from daily group by 1, 2, 3", "total mean")
def daily_to_monthly(spark, d):
    return meteo.to_monthly(A.daily(spark, d), sums={"total": "value"}, means={"mean": "value"})


@query("""select s.entity, s.month_ordinal, s.value, cast(count(d.entity) as bigint) as n_days from series s left join (select entity, cast(24288 + month(day) - 1 as int) as o from daily) d on d.entity = s.entity and d.o - 300 = s.month_ordinal - 300 group by 1, 2, 3""", "value")
def series_with_daily(spark, d):
    monthly = meteo.to_monthly(A.daily(spark, d), sums={}, means={}).select("entity", (F.col("year") * 12 + F.col("month") - 1).alias("month_ordinal"), F.col("n").alias("n_days"))
    return meteo.align(A.series(spark, d).select("entity", "month_ordinal", "value"), monthly, ["entity", "month_ordinal"], "left").select("entity", "month_ordinal", "value", F.coalesce("n_days", F.lit(0)).alias("n_days"))
