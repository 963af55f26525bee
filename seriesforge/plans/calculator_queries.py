"""Queries of whole calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calculators as C
from ..operators import series as S
from ..sources import adapters as A
from .grid_queries import _counts
from .registry import query
from .series_queries import _AE, _AMP, labelled


def _multi(q, low):
    return f"""select i.entity, i.month_ordinal, cast({q} as decimal(5,4)) as threshold_quantile, case when index_value <= lo then 'extreme_low' when index_value >= hi then 'extreme_high' else 'normal' end as extreme_label
        from indexed i join (select entity, round(quantile_cont(index_value, {low}), 9) as lo, round(quantile_cont(index_value, {q}), 9) as hi from indexed group by 1) t using (entity)"""


_LABELS = f"select * from ({_multi(0.9, 0.1)}) union all select * from ({_multi(0.95, 0.05)})"


@query(f"select entity, threshold_quantile, count(*) as n, count(*) filter (extreme_label = 'extreme_high') as high, count(*) filter (extreme_label = 'extreme_low') as low from ({_LABELS}) group by 1, 2", "threshold_quantile")
def quantile_extremes(spark, d):
    rows = C.quantile_extremes(A.series(spark, d))
    return rows.groupBy("entity", "threshold_quantile").agg(F.count("*").alias("n"), *[F.sum((F.col("extreme_label") == f"extreme_{k}").cast("long")).alias(k) for k in ("high", "low")])


@query()
def pooled_labels(spark, d):
    return C.pooled_extremes(A.series(spark, d)).select("entity", "month_ordinal", "threshold_quantile", "index_value", "threshold_low", "threshold_high", "extreme_label")


@query("""select entity, month_ordinal, case when index_value <= lo then 'extreme_low' when index_value >= hi then 'extreme_high' else 'normal' end as extreme_label
    from indexed left join (select entity, month, min(index_value) as lo, max(index_value) as hi from indexed where month <> 4 group by 1, 2) using (entity, month)""")
def labels_by_month(spark, d):
    rows = S.climatology_anomaly(A.series(spark, d))
    given = rows.where("month <> 4").groupBy("entity", "month").agg(F.min("index_value").alias("threshold_low"), F.max("index_value").alias("threshold_high"))
    return C.label_by_month(rows, given).select("entity", "month_ordinal", "extreme_label")


@query("select entity, coalesce(median(value) = 0, false) as is_empty from (select entity, case when entity % 9 = 0 then 0 else value end as value from series) group by 1")
def empty_series(spark, d):
    rows = A.series(spark, d).withColumn("value", F.when(F.col("entity") % 9 == 0, 0.0).otherwise(F.col("value")))
    return rows.groupBy("entity").agg(C.is_empty_series(F.median("value")).alias("is_empty"))


@query()
def pooled_processes(spark, d):
    rows = A.series(spark, d)
    return C.processes(rows, C.segment_process_events(labelled(spark, d)))


@query()
def tail_processes(spark, d):
    rows = A.series(spark, d)
    return C.processes(rows, C.tail_process_events(rows, 0.9))


@query()
def processes_compared(spark, d):
    rows = A.series(spark, d)
    return C.compared(C.processes(rows, C.segment_process_events(labelled(spark, d))), C.processes(rows, C.tail_process_events(rows, 0.9)), ("pooled", "tail"), "spectral_radius")


_SIDES = "select entity, case when entity % 3 > 0 then cast(entity as double) end as a_radius, case when entity % 3 = 0 then 'no events' end as a_error, case when entity % 5 > 0 then entity / 2.0::double end as b_radius, case when entity % 5 = 0 then 'failed' end as b_error from info"


@query(f"select entity, case when a_error is null and b_error is null then 'done' when a_error is not null and b_error is not null then 'error' else 'partial' end as status, substr(nullif(concat_ws('; ', a_error, b_error), ''), 1, 12) as error_message from ({_SIDES})")
def comparison_status(spark, d):
    e, info = F.col("entity"), A.info(spark, d)
    left = info.select("entity", F.when(e % 3 > 0, e.cast("double")).alias("radius"), F.when(e % 3 == 0, "no events").alias("error"))
    right = info.select("entity", F.when(e % 5 > 0, e / 2.0).alias("radius"), F.when(e % 5 == 0, "failed").alias("error"))
    return C.status_of(C.compared(left, right, ("a", "b"), "radius"), ("a", "b"), 12)


@query(f"select entity, ae, amplitude from ({_AE.format('series')}) left join ({_AMP}) using (entity) where entity not in (select entity from status where status = 'done' and entity % 2 = 0)", "ae amplitude")
def entropy_of_pending(spark, d):
    finished = A.status(A.info(spark, d)).where("status = 'done' and entity % 2 = 0")
    return C.entropy_results(A.series(spark, d), finished).select("entity", "ae", "amplitude")


@query("select entity, case when entity % 3 = 0 then null when entity % 3 = 1 then area / 2 else area end as area, kind from info", "area")
def refreshed_column(spark, d):
    info = A.info(spark, d).select("entity", "area", "kind")
    fresh = info.where("entity % 3 < 2").select("entity", F.when(F.col("entity") % 3 == 1, F.col("area") / 2).alias("area"))
    return C.refresh_column(info, fresh, "area")


@query(f"""select a.cell_lat, a.cell_lon, coalesce(s.event_count, 0) as "subset", a.event_count as "all", a.entity_count, coalesce(s.event_count, 0) / a.event_count as share from ({_counts('extreme')}) a
    left join ({_counts('(select * from extreme where entity in (select entity from info where area > 1000))')}) s on a.cell_lat = s.cell_lat and a.cell_lon = s.cell_lon""", "share")
def subset_against_all(spark, d):
    info = A.info(spark, d)
    return C.subset_against_all(S.extremes(labelled(spark, d)), info, info.where("area > 1000"))


@query("select entity, tail, threshold_quantile, n_extremes from fits where threshold_quantile = 0.98 and entity in (2, 4, 9, 11) order by n_extremes, entity, tail limit 5", "threshold_quantile")
def stored_processes(spark, d):
    return C.stored_processes(A.tail_fits(A.series(spark, d)), 0.98, ids=[2, 4, 9, 11], order="n_extremes", limit=5).select("entity", "tail", "threshold_quantile", "n_extremes")


@query("select entity, case when entity % 4 > 0 then cast(entity as double) end as threshold_high, 1.0::double as threshold_low, cast(entity as double) as lambda_0, 0.5::double as lambda_1, 2.0::double as b_0, cast(null as double) as b_1 from info", "threshold_high threshold_low lambda_0 lambda_1 b_0 b_1")
def flat_fits(spark, d):
    e = F.col("entity").cast("double")
    given = A.info(spark, d).select("entity", F.when(F.col("entity") % 4 > 0, e).otherwise(F.lit(float("nan"))).alias("threshold_high"), F.lit(1.0).alias("threshold_low"), F.array(e, F.lit(0.5)).alias("lambdas"), F.array(F.lit(2.0)).alias("moments"))
    return C.flat_fits(given, 2)


@query("select entity, level from (select entity, cast(entity % 12 as int) as level from info) where level > 8")
def deep_basins(spark, d):
    return C.deep_basins(A.info(spark, d).select("entity", (F.col("entity") % 12).cast("int").alias("level")))


@query("select entity from info where entity not in (select entity from status where status in ('done', 'error') and entity % 2 = 0)")
def pending_of_task(spark, d):
    info = A.info(spark, d)
    return C.pending("tails", info, A.status(info).where("entity % 2 = 0"))
