"""Queries of lookups, candidates, filters and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, meteo, pairs, quality
from ..operators import grid as G
from ..operators import ledger as L
from ..operators import series as S
from ..sources import adapters as A
from .registry import query
from .series_queries import labelled

_SLOPES = "select entity, regr_slope(value, month_ordinal) as slope from series where entity % 3 <> 0 group by 1"


@query(f"select i.entity, slope from (select entity from info where entity < 40) i left join ({_SLOPES}) using (entity)", "slope")
def trend_lookup(spark, d):
    slopes = A.series(spark, d).where("entity % 3 <> 0").groupBy("entity").agg(F.regr_slope("value", "month_ordinal").alias("slope"))
    return L.lookup(A.info(spark, d).where("entity < 40"), slopes, ["slope"])


@query("select entity, tail, threshold_quantile, n_extremes, xi from fits where entity in (3, 5, 8) and threshold_quantile = 0.95", "threshold_quantile xi")
def fits_by_id(spark, d):
    return L.of_ids(A.tail_fits(A.series(spark, d)), [3, 5, 8], 0.95).select("entity", "tail", "threshold_quantile", "n_extremes", "xi")


@query("select entity, month_ordinal, event_type, index_value from extreme where entity in (2, 7)", "index_value")
def extremes_by_id(spark, d):
    return L.of_ids(S.extremes(labelled(spark, d)), [2, 7]).select("entity", "month_ordinal", "event_type", "index_value")


@query("select * from fits where entity >= 5 and entity < 15", "threshold_quantile xi sigma threshold")
def result_rows(spark, d):
    return S.in_range(A.tail_fits(A.series(spark, d)), 5, 15)


@query("select v.status, count(s.entity) as n from (values ('done'), ('error')) v(status) left join (select * from status where entity >= 10 and entity < 45) s using (status) group by 1")
def status_in_range(spark, d):
    return L.range_status_counts(A.status(A.info(spark, d)), 10, 45)


@query("select distinct entity from series where entity >= 4 and entity < 60 and entity in (select entity from flagged where flags = 0)")
def good_ids_in_range(spark, d):
    return L.ids_in_range(A.series(spark, d), 4, 60, A.flags(A.info(spark, d)).where("flags = 0"))


@query("select entity from flagged where flags > 5 union select entity from status where status = 'error'")
def finished_by_all(spark, d):
    info = A.info(spark, d)
    return L.finished_by_all(A.flags(info).where("flags > 5"), A.status(info).where("status = 'error'"))


@query("select entity from info where entity >= 5 and entity < 70 and entity % 2 = 1 and entity < 40 and entity in (select entity from flagged where flags < 6) and entity not in (select entity from status where status = 'error')")
def resolved_candidates(spark, d):
    info = A.info(spark, d)
    return L.resolve(info, A.status(info).where("status = 'error'"), A.flags(info).where("flags < 6"), 5, 70, [k for k in range(40) if k % 2])


@query("""with p as (select entity, row_number() over (order by entity) - 1 as p, count(*) over () as n from info), q as (select *, n // 7 as least, n % 7 as more from p)
    select entity, cast(case when p < more * (least + 1) then p // (least + 1) else more + (p - more * (least + 1)) // greatest(least, 1) end as int) as worker, cast(p // 16 as int) as batch from q""")
def worker_shares(spark, d):
    return L.shares_of_workers(A.info(spark, d), 7, 16)


@query("select 'large' as name, entity from info where area > 10 union all select 'no_error', entity from info where entity not in (select entity from status where status = 'error')")
def named_filters(spark, d):
    info = A.info(spark, d)
    errors = A.status(info).where("status = 'error'")
    return L.named_filter("large", info, errors).select(F.lit("large").alias("name"), "entity").unionByName(L.named_filter("no_error", info, errors).select(F.lit("no_error").alias("name"), "entity"))


@query("select entity, coalesce(h, 0) as high, coalesce(l, 0) as low, coalesce(t, 0) as tails from (select entity, count(*) filter (event_type = 'high') as h, count(*) filter (event_type = 'low') as l from extreme where entity % 4 > 0 group by 1) full join (select entity, count(*) as t from fits where entity % 3 > 0 group by 1) using (entity)")
def counts_side_by_side(spark, d):
    events = S.extremes(labelled(spark, d)).where("entity % 4 > 0")
    return L.outer_counts([events.where("event_type = 'high'"), events.where("event_type = 'low'"), A.tail_fits(A.series(spark, d)).where("entity % 3 > 0")], ["high", "low", "tails"])


_RUN = """select 'transitions' as measure, transition_type as key, count(*) as n from transition group by 2 union all select 'seasonality', cast(to_ordinal % 12 + 1 as varchar), count(*) from transition group by 2
    union all select 'entity transitions', cast(entity as varchar), count(*) from transition group by 2 union all select 'entity extremes', cast(entity as varchar), count(*) from extreme group by 2 union all select 'entities', status, count(*) from status group by 2"""


@query(_RUN)
def run_summary(spark, d):
    """Summaries of two halves of the entities, put together."""
    rows, status = labelled(spark, d), A.status(A.info(spark, d))
    halves = []
    for half in ("entity % 2 = 0", "entity % 2 = 1"):
        part = rows.where(half)
        halves.append(L.run_summary(S.extremes(part), S.abrupt_transitions(part), status.where(half)))
    return L.merge_summaries(*halves)


_TESTS = "select entity, case entity % 3 when 0 then 'full' when 1 then 'cross' else 'self' end as test_name, entity % 5 < 2 as reject_null, cast(entity % 20 as double) / 20 as p_value from info"


@query(f"select test_name, count(*) as n, avg(cast(reject_null as int)) as reject_rate, avg(p_value) as mean_p, min(p_value) as least_p, max(p_value) as largest_p from ({_TESTS}) group by 1", "reject_rate mean_p least_p largest_p")
def ratio_test_summary(spark, d):
    e = F.col("entity")
    return L.ratio_test_summary(A.info(spark, d).select("entity", F.when(e % 3 == 0, "full").when(e % 3 == 1, "cross").otherwise("self").alias("test_name"), (e % 5 < 2).alias("reject_null"), ((e % 20).cast("double") / 20).alias("p_value")))


@query("""select threshold_quantile, count(*) as n, count(*) filter (converged) as n_converged, avg(cast(converged as int)) as rate, avg(n_extremes) as mean_extremes, avg(cast(entity % 6 <> 0 as int)) as no_error_rate,
    min(date '2024-01-01' + cast(entity % 50 as int)) as computed_at_min, max(date '2024-01-01' + cast(entity % 50 as int)) as computed_at_max from fits group by 1""", "threshold_quantile rate mean_extremes no_error_rate")
def process_qc_summary(spark, d):
    e = F.col("entity")
    rows = A.tail_fits(A.series(spark, d)).withColumns({"error_message": F.when(e % 6 == 0, F.lit("failed")).otherwise(F.lit(" ")), "computed_at": F.date_add(F.lit("2024-01-01").cast("date"), (e % 50).cast("int"))})
    return L.qc_summary(rows)


@query("select entity, q, n_values from (select entity, quantile_cont(value, 0.9) as q, count(distinct value) as n_values from series group by 1) where q >= 100000", "q")
def high_quantile_entities(spark, d):
    return G.high_quantile(A.series(spark, d), 0.9, 100000.0)


@query("select cast(entity as int) as entity, cast(lat as float) as lat, cast(lon as float) as lon, cast(kind as smallint) as kind, area, code from info", "area")
def coerced_grid(spark, d):
    return G.coerce(A.info(spark, d), {"entity": "int", "lat": "float", "lon": "float", "kind": "smallint"}).select("entity", "lat", "lon", "kind", "area", "code")


@query("select entity, least, largest, case when area <= 0 then false else area < least or area > largest end as is_outside from (select entity, area from info) join (select entity, min(value) / 100 as least, max(value) / 100 as largest from series group by 1) using (entity)", "least largest")
def outside_extremes(spark, d):
    return quality.outside_extremes(A.series(spark, d), A.info(spark, d), 100.0)


@query("""select entity, case when count(sd) filter (sd > 1e-9) > 1 then max(sd) / min(sd) filter (sd > 1e-9) else 1.0 end as variance_ratio from (select entity, month, stddev_pop(ln(value)) as sd from series where value > 0 group by 1, 2) group by 1""", "variance_ratio")
def month_variance_ratio(spark, d):
    return quality.month_variance_ratio(A.series(spark, d))


_NEW_BIT = "select f.entity, cast(case when f.entity % 3 = 0 then flags | 16 when f.entity % 3 = 1 then flags & ~16 else flags end as int) as new, flags from (select entity, cast(flags * 4 as int) as flags from flagged) f"


@query(f"select entity, new as flags, case when flags = 0 and new > 0 then 'to anomalies' when flags > 0 and new = 0 then 'to quality' when flags <> new then 'flags' else 'unchanged' end as route from ({_NEW_BIT})")
def recomputed_volatility_bit(spark, d):
    status = A.flags(A.info(spark, d)).withColumn("flags", F.col("flags") * 4)
    return quality.recompute_bit(status, status.where("entity % 3 <> 2").select("entity", (F.col("entity") % 3 == 0).alias("hit")), quality.LOW_VOLATILITY)


@query("""select entity, cast(new as int) as flags, case when new = flags then 'unchanged' when flags = 0 then 'to anomalies' when new = 0 then 'to quality' else 'flags' end as route from (select *, case when entity % 4 = 0 then flags | 32 when entity % 4 < 3 and flags = 32 then 0 else flags end as new
    from (select entity, case entity % 3 when 0 then 0 when 1 then 32 else 34 end as flags from info))""")
def synced_shift_labels(spark, d):
    e = F.col("entity")
    info = A.info(spark, d)
    status = info.select("entity", F.when(e % 3 == 0, 0).when(e % 3 == 1, 32).otherwise(34).alias("flags"))
    return quality.sync_shift(status, info.where("entity % 4 < 3").select("entity", F.when(e % 4 == 0, "degraded").when(e % 4 == 1, "stable").otherwise("intermittent").alias("shift_label")))


@query("select entity, count(*) filter (abs(z) > 3) as n_events, count(*) as n_obs, count(*) filter (abs(z) > 3) / count(*) as anomaly_ratio from (select entity, (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as z from series window w as (partition by entity)) group by 1", "anomaly_ratio")
def event_share(spark, d):
    return pairs.event_share(A.series(spark, d))


_BASINS = "select entity, case when entity % 6 > 0 then code // 1000 end as basin from info"


@query(f"select 'first' as side, entity, kind, basin, lat, lon, area from info join ({_BASINS}) using (entity) where kind = 1 and basin is not null union all select 'others', entity, kind, basin, lat, lon, area from info join ({_BASINS}) using (entity) where kind > 1 and basin is not null and entity < 60", "area")
def entities_with_basins(spark, d):
    info = A.info(spark, d)
    basins = info.select("entity", F.when(F.col("entity") % 6 > 0, F.floor(F.col("code") / 1000)).alias("basin"))
    return pairs.by_kind(info, basins, True).select(F.lit("first").alias("side"), "*").unionByName(pairs.by_kind(info, basins, False, 60).select(F.lit("others").alias("side"), "*"))


@query("select entity, avg(area) as area, count(*) as n from (select distinct s.entity, area from series s join info using (entity) where area > 0) group by 1", "area")
def series_with_area(spark, d):
    info = A.info(spark, d)
    return S.of_entities(info, A.series(spark, d)).where("area > 0").groupBy("entity").agg(F.avg("area").alias("area"), F.count("*").alias("n"))


@query("select entity, month_ordinal, mu, value from (select entity, month_ordinal, value from series where month_ordinal % 2 = 0) join (select entity, month_ordinal, value / 2 as mu from series where month_ordinal % 3 = 0) using (entity, month_ordinal)", "mu value")
def timeline_with_parts(spark, d):
    rows = A.series(spark, d)
    parts = rows.where("month_ordinal % 3 = 0").select("entity", "month_ordinal", (F.col("value") / 2).alias("mu"))
    return meteo.align(rows.where("month_ordinal % 2 = 0").select("entity", "month_ordinal", "value"), parts, ["entity", "month_ordinal"])


@query("""with l as (select entity, 0.2::double as epsilon, [0.1, -0.05, 0.3] as lam from info where entity < 20), g as (select entity, epsilon, lam, k * ((1 - 1e-8) / 49.0::double) as u from l, (select unnest(range(50)) as k))
    select entity, u, epsilon - (1 - epsilon) * ln(1 - u) as prior, (epsilon - (1 - epsilon) * ln(1 - u)) * exp(-(lam[1] + lam[2] * u + lam[3] * u * u)) as fitted from g""", "u prior fitted")
def quantile_curve(spark, d):
    given = A.info(spark, d).where("entity < 20").select("entity", F.lit(0.2).alias("epsilon"), F.array(F.lit(0.1), F.lit(-0.05), F.lit(0.3)).alias("lambdas"))
    return fits.quantile_curve(given, 50)


_GIVEN = "select entity, threshold_quantile, th as threshold_high, tl as threshold_low from (select entity, 0.95::double as threshold_quantile, 80.0 + entity % 5 as th, 15.0 + entity % 3 as tl from info where entity % 4 > 0)"
_RANKED = "(select entity, year, month, month_ordinal, value, 100.0 * n_upto / (n + 1) as index_value from (select *, count(*) over (partition by entity, month) as n, count(*) over (partition by entity, month order by value) as n_upto from series) where n >= 2)"


@query(f"""select entity, month_ordinal, case when index_value <= threshold_low then 'low' else 'high' end as event_type, index_value, abs(index_value - case when index_value <= threshold_low then threshold_low else threshold_high end) as severity
    from {_RANKED} join ({_GIVEN}) using (entity) where index_value <= threshold_low or index_value >= threshold_high""", "index_value severity")
def pooled_extremes(spark, d):
    """Labels, extremes and severities of the percentile index at pooled thresholds that are given."""
    rows = S.percentile_rank(A.series(spark, d)).where("percentile is not null").withColumnRenamed("percentile", "index_value")
    e = F.col("entity")
    given = A.info(spark, d).where("entity % 4 > 0").select("entity", F.lit(0.95).alias("threshold_quantile"), (e % 5 + 80.0).alias("threshold_high"), (e % 3 + 15.0).alias("threshold_low"), F.lit(None).cast("string").alias("error"))
    labels = S.label(fits.with_pooled_thresholds(rows.withColumn("climatology", F.lit(None).cast("double")), given))
    events = S.extremes(labels)
    return events.select("entity", "month_ordinal", "event_type", "index_value", F.abs(F.col("index_value") - F.col("threshold")).alias("severity"))
