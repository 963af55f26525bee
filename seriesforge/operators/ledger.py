"""Result tables and their upkeep: upserts, deletions, flags, routing, candidates and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import with_place

#: Primary keys of the result tables, by what they hold.
KEYS = {
    "quality": ["entity"], "anomalies": ["entity"], "status": ["entity"], "entropy": ["entity"], "interpolation": ["entity"], "shift_labels": ["entity"],
    "labels": ["entity", "year", "month"], "extremes": ["entity", "year", "month", "event_type"], "transitions": ["entity", "from_ordinal", "to_ordinal", "transition_type"],
    "thresholds": ["entity", "threshold_quantile", "month"], "segments": ["entity", "threshold_quantile", "segment_id"], "tail_fits": ["entity", "tail", "threshold_quantile"],
    "tail_extremes": ["entity", "tail", "threshold_quantile", "cluster_id"], "return_levels": ["entity", "tail", "threshold_quantile", "return_period"],
    "processes": ["entity", "threshold_quantile"], "likelihood_ratios": ["entity", "threshold_quantile", "test_name"],
}


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of both, incoming ones in place of existing ones with the same key; of repeated incoming rows the last by order, else by all columns."""
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    by = [F.desc("_new"), *([F.desc(order)] if order else []), *[F.desc(c) for c in tagged.columns if c not in (*keys, "_new", order)]]
    return tagged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_new", "_rn")


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("entity").distinct(), "entity", "left_anti")


def clear_bit(rows: DataFrame, ids: DataFrame, bit: int) -> DataFrame:
    """Clears a flag of the given entities."""
    hit = rows.join(ids.select("entity").distinct().withColumn("_hit", F.lit(True)), "entity", "left")
    return hit.withColumn("flags", F.when(F.col("_hit"), F.col("flags").bitwiseAND(F.lit(~bit))).otherwise(F.col("flags"))).drop("_hit")


def set_flags(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Flags of new (entity, flags) in place of the old."""
    joined = rows.join(new.select("entity", F.col("flags").alias("_flags")), "entity", "left")
    return joined.withColumn("flags", F.coalesce("_flags", "flags")).drop("_flags")


def move(source: DataFrame, target: DataFrame, ids: DataFrame, flags: int) -> tuple[DataFrame, DataFrame]:
    """(source without the entities, target with them under the given flags)."""
    moved = source.join(ids.select("entity").distinct(), "entity", "left_semi").withColumn("flags", F.lit(flags))
    return delete(source, ids), upsert(target, moved, ["entity"])


def status_map(quality: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Flags of all entities: 0 for those of good quality, unless they are among the anomalies."""
    both = quality.select("entity", F.lit(0).alias("flags"), F.lit(0).alias("p")).unionByName(anomalies.select("entity", "flags", F.lit(1).alias("p")))
    return both.groupBy("entity").agg(F.max(F.struct("p", "flags")).alias("m")).select("entity", F.col("m.flags").alias("flags"))


def done(status: DataFrame, start: int | None = None, end: int | None = None, states: Sequence[str] = ("done",)) -> DataFrame:
    rows = status.where(F.col("status").isin(list(states)))
    if start is not None:
        rows = rows.where((F.col("entity") >= start) & (F.col("entity") < end))
    return rows.select("entity").distinct()


def candidates(all_ids: DataFrame, allowed: DataFrame | None, finished: DataFrame) -> DataFrame:
    """What is left to do: all entities that are allowed and not finished."""
    rows = all_ids.select("entity").distinct()
    if allowed is not None:
        rows = rows.join(allowed.select("entity").distinct(), "entity", "left_semi")
    return rows.join(finished.select("entity").distinct(), "entity", "left_anti")


def page(ids: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of ids in order."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    return ids.select("entity").orderBy("entity").offset(offset).limit(limit)


def chunks(ids: DataFrame, size: int) -> DataFrame:
    """Each id with the range of ``size`` ids that it falls in, and whether the range is pending is a count of its rows."""
    start = F.floor(F.col("entity") / size) * size
    return ids.groupBy(start.cast("long").alias("chunk_start")).agg(F.count("*").alias("n")).withColumn("chunk_end", F.col("chunk_start") + size)


def pending_chunks(ids: DataFrame, finished: DataFrame, size: int) -> DataFrame:
    """Ranges with at least one id that isn't finished."""
    return chunks(candidates(ids, None, finished), size)


def sync_status(counts: DataFrame) -> DataFrame:
    """counts (name, files, stored): how a table's two copies compare."""
    f, s = F.col("files"), F.col("stored")
    state = F.when(f.isNull(), "NO FILE").when(s == 0, "EMPTY STORE").when(f > s, "STALE").when((f < 0.1 * s) & (s > 100), "FILE SMALL").otherwise("OK")
    return counts.withColumn("state", state)


def zero_filled_counts(rows: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Counts of all categories, also of those without rows."""
    spine = rows.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    return spine.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def qc_summary(fits: DataFrame) -> DataFrame:
    """Numbers, rates and, where rows have a time of computation, its range, by quantile."""
    ok = F.col("converged").cast("double")
    times = [F.min("computed_at").alias("computed_at_min"), F.max("computed_at").alias("computed_at_max")] if "computed_at" in fits.columns else []
    message = [F.avg((F.trim(F.coalesce("error_message", F.lit(""))) == "").cast("double")).alias("no_error_rate")] if "error_message" in fits.columns else []
    return fits.groupBy("threshold_quantile").agg(F.count("*").alias("n"), F.sum(F.col("converged").cast("long")).alias("n_converged"), F.avg(ok).alias("rate"), F.avg("n_extremes").alias("mean_extremes"), *message, *times)


def ratio_test_summary(tests: DataFrame) -> DataFrame:
    """Likelihood-ratio tests by name: number, share that reject, mean and range of p."""
    p = "p_value"
    return tests.groupBy("test_name").agg(F.count("*").alias("n"), F.avg(F.col("reject_null").cast("double")).alias("reject_rate"), F.avg(p).alias("mean_p"), F.min(p).alias("least_p"), F.max(p).alias("largest_p"))


def ids_in_range(rows: DataFrame, start: int, end: int, done: DataFrame | None = None) -> DataFrame:
    """Distinct ids in [start, end), of those in done if that is given."""
    found = rows.where((F.col("entity") >= start) & (F.col("entity") < end)).select("entity").distinct()
    return found if done is None else found.join(done.select("entity").distinct(), "entity", "left_semi")


def range_status_counts(status: DataFrame, start: int, end: int, states: Sequence[str] = ("done", "error")) -> DataFrame:
    """Entities of [start, end) in each state, 0 for states without any."""
    return zero_filled_counts(status.where((F.col("entity") >= start) & (F.col("entity") < end)), "status", states)


def of_ids(rows: DataFrame, ids: Sequence[int], quantile: float | None = None) -> DataFrame:
    """Rows of a result table by id and, if given, threshold quantile."""
    found = rows.where(F.col("entity").isin(list(ids)))
    return found if quantile is None else found.where(F.col("threshold_quantile") == F.lit(str(quantile)).cast("decimal(5,4)"))


def lookup(ids: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The values of all ids, null for those without a row."""
    return ids.select("entity").distinct().join(values.select("entity", *columns), "entity", "left")


def finished_by_all(*ledgers: DataFrame) -> DataFrame:
    """Ids that any of several ledgers has."""
    out = ledgers[0].select("entity")
    for more in ledgers[1:]:
        out = out.union(more.select("entity"))
    return out.distinct()


def resolve(all_ids: DataFrame, finished: DataFrame, quality: DataFrame | None = None, start: int | None = None, end: int | None = None, subset: Sequence[int] | None = None) -> DataFrame:
    """Candidates: source, of good quality, in range, in the subset, not finished."""
    rows = all_ids.select("entity")
    if start is not None:
        rows = rows.where(F.col("entity") >= start)
    if end is not None:
        rows = rows.where(F.col("entity") < end)
    if subset is not None:
        rows = rows.where(F.col("entity").isin(list(subset)))
    return candidates(rows, quality, finished)


def shares_of_workers(ids: DataFrame, workers: int, size: int) -> DataFrame:
    """Each id with its worker (even split in order) and its batch of ``size`` ids."""
    known = ids.select("entity").distinct()
    n = known.agg(F.count("*").alias("_n"))
    spread = with_place(known, "entity").join(F.broadcast(n), F.lit(True)).withColumn("_p", F.col("upto") - 1)  # one row
    least, more = F.floor(F.col("_n") / workers), F.col("_n") % workers
    worker = F.when(F.col("_p") < more * (least + 1), F.floor(F.col("_p") / (least + 1))).otherwise(more + F.floor((F.col("_p") - more * (least + 1)) / F.greatest(least, F.lit(1))))
    return spread.select("entity", worker.cast("int").alias("worker"), F.floor(F.col("_p") / size).cast("int").alias("batch"))


def named_filter(name: str, info: DataFrame, errors: DataFrame, least_area: float = 10.0) -> DataFrame:
    """Ids that a named output filter keeps: ``large`` (area above the least) or ``no_error`` (no failed fit)."""
    if name == "large":
        return info.where(F.col("area") > least_area).select("entity")
    if name == "no_error":
        return delete(info.select("entity"), errors)
    raise ValueError(f"no filter is called {name}")


def outer_counts(ids: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Rows of each frame by entity side by side, 0 where a frame has none."""
    tagged = [rows.select("entity", F.lit(k).alias("_k")) for k, rows in enumerate(ids)]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    return out.groupBy("entity").agg(*[F.sum((F.col("_k") == k).cast("long")).alias(n) for k, n in enumerate(names)])


def run_summary(extremes: DataFrame, transitions: DataFrame, status: DataFrame) -> DataFrame:
    """A run's counts as one long table (measure, key, n): tables of parts add up by :func:`merge_summaries`."""
    def part(measure: str, rows: DataFrame, key: Column) -> DataFrame:
        return rows.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), "key", "n")

    parts = [part("transitions", transitions, F.col("transition_type")), part("seasonality", transitions, F.col("to_ordinal") % 12 + 1), part("entity transitions", transitions, F.col("entity")), part("entity extremes", extremes, F.col("entity")), part("entities", status, F.col("status"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def merge_summaries(*parts: DataFrame) -> DataFrame:
    """Summaries of disjoint parts of the entities put together."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("measure", "key").agg(F.sum("n").alias("n"))


def error_summary(status: DataFrame, top: int = 10, prefix: int = 200) -> DataFrame:
    """The commonest beginnings of error messages; ties in order of the text."""
    rows = status.where("status = 'error'").groupBy(F.substring(F.trim(F.coalesce("error_message", F.lit(""))), 1, prefix).alias("message")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "message").limit(top)


def coverage(results: DataFrame, tails: DataFrame) -> DataFrame:
    """Of each entity with results: whether both tails have a fit."""
    per = tails.where("converged").groupBy("entity").agg(F.count_distinct("tail").alias("tails"))
    return results.select("entity").distinct().join(per, "entity", "left").withColumn("tails", F.coalesce("tails", F.lit(0)))


def sample(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n entities in the order of a hash of seed and id: the same ones wherever it runs."""
    return ids.select("entity").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("entity").cast("string"))), "entity").limit(n)


def stratified_sample(cells: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About n entities spread evenly over cells; what a small cell can't give, the others share."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("entity").cast("string")))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size"))
    k = sizes.agg(F.count("*").alias("k"))
    based = sizes.join(k, F.lit(True)).withColumn("base", F.floor(F.lit(n) / F.col("k")).cast("long"))
    rich = F.col("size") > F.col("base")
    short = based.agg((F.lit(n) - F.sum(F.least("size", "base"))).alias("short"), F.sum(rich.cast("long")).alias("rich"))
    place = F.row_number().over(Window.partitionBy(rich).orderBy("cell")) - 1
    quota = F.when(rich, F.col("base") + F.floor(F.col("short") / F.greatest("rich", F.lit(1))) + (F.col("place") < F.col("short") % F.greatest("rich", F.lit(1))).cast("long")).otherwise(F.col("size"))
    quotas = based.withColumn("place", place).join(short, F.lit(True)).select("cell", quota.alias("quota"))
    ranked = cells.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy(order, "entity")))
    return ranked.join(quotas, "cell").where(F.col("rn") <= F.col("quota")).select("cell", "entity")
