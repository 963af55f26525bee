"""Queries of the result tables' upkeep and of their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources import adapters as A
from .registry import query
from .series_queries import labelled


def _flags(spark, d):
    return A.flags(A.info(spark, d))


def _status(spark, d):
    return A.status(A.info(spark, d))


def _fits(spark, d):
    return A.tail_fits(A.series(spark, d))


@query("select entity, coalesce(n.flags, o.flags) as flags from flagged o full join (select entity + 50 as entity, flags + 10 as flags from flagged) n using (entity)")
def upsert(spark, d):
    old = _flags(spark, d)
    return L.upsert(old, old.select((F.col("entity") + 50).alias("entity"), (F.col("flags") + 10).alias("flags")), L.KEYS["quality"])


@query("select * from flagged where entity not in (select entity from info where kind = 2)")
def delete_entities(spark, d):
    return L.delete(_flags(spark, d), A.info(spark, d).where("kind = 2"))


@query("select entity, case when entity in (select entity from info where kind = 2) then flags & ~1 else flags end as flags from flagged")
def clear_flag(spark, d):
    return L.clear_bit(_flags(spark, d), A.info(spark, d).where("kind = 2"), 1)


@query("select entity, case when entity % 3 = 0 then cast(entity % 5 as int) else flags end as flags from flagged")
def set_flags(spark, d):
    rows = _flags(spark, d)
    return L.set_flags(rows, rows.where("entity % 3 = 0").select("entity", (F.col("entity") % 5).cast("int").alias("flags")))


@query("select entity, cast(case when entity % 4 = 0 then 2 else flags end as int) as flags from flagged where flags > 3 or entity % 4 = 0")
def move_to_anomalies(spark, d):
    rows = _flags(spark, d)
    return L.move(rows.where("flags <= 3"), rows.where("flags > 3 and entity % 4 <> 0"), rows.where("entity % 4 = 0"), 2)[1].unionByName(rows.where("flags > 3 and entity % 4 = 0").withColumn("flags", F.lit(2)))


@query("select entity, case when flags > 3 then flags else 0 end as flags from flagged")
def status_map(spark, d):
    rows = _flags(spark, d)
    return L.status_map(rows, rows.where("flags > 3"))


@query("select entity from status where status = 'done' and entity >= 10 and entity < 60")
def done_entities(spark, d):
    return L.done(_status(spark, d), 10, 60)


@query("select entity from info where kind <> 2 and entity not in (select entity from status where status = 'done')")
def candidate_entities(spark, d):
    info = A.info(spark, d)
    return L.candidates(info, info.where("kind <> 2"), L.done(_status(spark, d)))


@query("select entity from info order by entity limit 20 offset 30")
def page_of_entities(spark, d):
    return L.page(A.info(spark, d), 20, 30)


@query("select entity // 25 * 25 as chunk_start, count(*) as n, entity // 25 * 25 + 25 as chunk_end from info where entity not in (select entity from status where status = 'done') group by 1")
def pending_chunks(spark, d):
    return L.pending_chunks(A.info(spark, d), L.done(_status(spark, d)), 25)


@query("""select name, files, stored, case when files is null then 'NO FILE' when stored = 0 then 'EMPTY STORE' when files > stored then 'STALE' when files < 0.1 * stored and stored > 100 then 'FILE SMALL' else 'OK' end as state
    from (select n_name as name, case when n_nationkey % 5 <> 0 then n_nationkey * 10 end as files, cast(n_nationkey * n_nationkey * 7 % 300 as int) as stored from nation)""")
def sync_status(spark, d):
    k = F.col("n_nationkey")
    return L.sync_status(A.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(k % 5 != 0, k * 10).alias("files"), (k * k * 7 % 300).alias("stored")))


@query("select extreme_label, count(l.entity) as n from (values ('extreme_low'), ('normal'), ('extreme_high'), ('unknown')) v(extreme_label) left join labelled l using (extreme_label) group by 1")
def zero_filled_counts(spark, d):
    return L.zero_filled_counts(labelled(spark, d), "extreme_label", ["extreme_low", "normal", "extreme_high", "unknown"])


@query("select threshold_quantile, count(*) as n, count(*) filter (converged) as n_converged, avg(cast(converged as int)) as rate, avg(n_extremes) as mean_extremes from fits group by 1", "threshold_quantile rate mean_extremes")
def fit_qc_summary(spark, d):
    return L.qc_summary(_fits(spark, d))


@query("select left(trim(coalesce(error_message, '')), 12) as message, count(*) as n from status where status = 'error' group by 1 order by n desc, message limit 10")
def error_summary(spark, d):
    return L.error_summary(_status(spark, d), 10, 12)


@query("select distinct tail, threshold_quantile from fits", "threshold_quantile")
def available_quantiles(spark, d):
    return _fits(spark, d).select("tail", "threshold_quantile").distinct().orderBy("tail", "threshold_quantile")


@query("select i.entity, cast(coalesce(t, 0) as bigint) as tails from info i left join (select entity, count(distinct tail) as t from fits where converged group by 1) using (entity)")
def tail_coverage(spark, d):
    return L.coverage(A.info(spark, d), _fits(spark, d))


@query("select entity from info order by md5('42:' || entity), entity limit 25")
def hashed_sample(spark, d):
    return L.sample(A.info(spark, d), 25)


@query("""with c as (select kind as cell, entity from info), s as (select cell, count(*) as size from c group by 1), b as (select *, 40 // count(*) over () as base from s),
    h as (select 40 - sum(least(size, base)) as short, count(*) filter (size > base) as rich from b), q as (select cell, case when size > base then base + short // greatest(rich, 1) + cast(row_number() over (partition by size > base order by cell) - 1 < short % greatest(rich, 1) as int) else size end as quota from b, h)
    select cell, entity from (select *, row_number() over (partition by cell order by md5('42:' || entity), entity) as rn from c) join q using (cell) where rn <= quota""")
def stratified_sample(spark, d):
    return L.stratified_sample(A.info(spark, d).select(F.col("kind").alias("cell"), "entity"), 40)


@query("select coalesce(max(entity), 0) as max_entity from info")
def largest_entity(spark, d):
    return A.info(spark, d).agg(F.coalesce(F.max("entity"), F.lit(0)).alias("max_entity"))


@query("select entity, coalesce(area, 0) as area from info", "area")
def atlas_area(spark, d):
    return A.info(spark, d).select("entity", F.coalesce("area", F.lit(0.0)).alias("area"))


@query("select 'done' as state, count(*) filter (status = 'done') as n from status union all select 'error', count(*) filter (status = 'error') from status")
def range_counts(spark, d):
    return _status(spark, d).groupBy(F.col("status").alias("state")).agg(F.count("*").alias("n"))


@query("select entity, 'POINT(' || cast(cast(lon as decimal(9,3)) as varchar) || ' ' || cast(cast(lat as decimal(9,3)) as varchar) || ')' as wkt from info")
def centroids(spark, d):
    point = lambda c: F.col(c).cast("decimal(9,3)").cast("string")
    return A.info(spark, d).select("entity", F.concat(F.lit("POINT("), point("lon"), F.lit(" "), point("lat"), F.lit(")")).alias("wkt"))


