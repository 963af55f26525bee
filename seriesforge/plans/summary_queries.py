"""Queries of summaries and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import series as S
from ..operators import summaries as U
from ..sources import adapters as A
from .fit_queries import _models
from .grid_queries import _CLIPPED
from .registry import query
from .series_queries import _segments_sql, decayed, labelled


@query(f"select segment_type, count(*) as n, count(distinct entity) as entities, avg(months) as mean_months, avg(sum_s) as mean_strength, cast(sum(n_extremes) as bigint) as n_extremes from ({_segments_sql('pe and decay_index > 1')}) group by 1", "mean_months mean_strength")
def segment_summary(spark, d):
    return U.segment_summary(S.segments(decayed(spark, d)))


@query("select parameter, count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from (select 'alpha_dd' as parameter, cast(entity % 7 + 1 as double) / 20 as v from info union all select 'beta_dd', cast((entity + 4) % 7 + 1 as double) from info) group by 1", "q1 median q3")
def model_summary(spark, d):
    return U.model_summary(_models(spark, d), ["alpha_dd", "beta_dd"])


@query("select i.entity, count(t.entity) as n from info i left join transition t using (entity) group by 1")
def transitions_per_entity(spark, d):
    return U.events_per_entity(A.info(spark, d), S.abrupt_transitions(labelled(spark, d)))


@query("select transition_type, cast(to_ordinal % 12 + 1 as int) as month, count(*) as n from transition group by 1, 2")
def transition_seasonality(spark, d):
    return U.transition_seasonality(S.abrupt_transitions(labelled(spark, d)))


@query("""with p as (select entity, month, value, row_number() over (partition by entity, month order by value) - 1 as pos, (count(*) over (partition by entity, month) - 1) * (cast(entity % 10 as double) / 8) as h0, count(*) over (partition by entity, month) - 1 as top from series),
    c as (select *, least(greatest(h0, 0), top) as h from p), e as (select entity, month, max(case when pos = floor(h) then value end) as low, max(case when pos = ceil(h) then value end) as high, max(h) as h from c group by 1, 2)
    select entity, month, low + (h - floor(h)) * (high - low) as threshold from e""", "threshold")
def amplitude_thresholds(spark, d):
    return U.amplitude_thresholds(A.series(spark, d).withColumn("share", (F.col("entity") % 10).cast("double") / 8))


@query("""with b as (select code as basin, code // 1000000 as head, lat - 20 as south, lat + 20 as north, lon - 60 as west, lon + 60 as east from info where kind = 1)
    select i.entity, basin from info i join b on i.code // 1000000 = head and lat between south and north and lon between west and east""")
def basin_lookup(spark, d):
    info = A.info(spark, d)
    box = info.where("kind = 1").select("code", (F.col("lat") - 20).alias("south"), (F.col("lat") + 20).alias("north"), (F.col("lon") - 60).alias("west"), (F.col("lon") + 60).alias("east"))
    return U.basin_lookup(info, box)


@query("select entity from info where lon > -100 and lon < 100 and lat > -45 and lat < 45")
def inside_polygon(spark, d):
    return A.info(spark, d).where(U.contains([(-45.0, -100.0), (-45.0, 100.0), (45.0, 100.0), (45.0, -100.0)])).where("lon <> -100 and lat <> -45").select("entity")


@query("""with w as (select entity, month_ordinal, (month_ordinal - lag(month_ordinal) over (partition by entity order by month_ordinal)) * 0.2::double as w from extreme)
    select entity, month_ordinal, 1 - exp(-w) as model, row_number() over (partition by entity order by w, month_ordinal) / (count(*) over (partition by entity) + 1) as empirical from w where w is not null""", "model empirical")
def residual_points(spark, d):
    return U.residual_points(S.extremes(labelled(spark, d)).withColumn("rate", F.lit(0.2)))


@query("select entity, month_ordinal, value from series order by value desc, entity, month_ordinal desc limit 15", "value")
def largest_values(spark, d):
    return U.top_values(A.series(spark, d), 15)


@query(f"""with g as ({_CLIPPED}), k as (select i, j, exp(-(i * i + j * j) / 2.0::double) as w from (select unnest(range(-2, 3)) as i) cross join (select unnest(range(-2, 3)) as j)),
    s as (select row + i as row, "column" + j as "column", sum(event_count * w) as wv, sum(w) as w from g cross join k group by 1, 2)
    select g.row, g."column", s.wv / s.w as density from g join s on g.row = s.row and g."column" = s."column" """, "density")
def grid_density(spark, d):
    return U.density(G.clipped_counts(S.extremes(labelled(spark, d)), A.info(spark, d), 30.0))
