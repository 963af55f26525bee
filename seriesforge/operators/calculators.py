"""Whole calculations from a series to its results, put together from the operators.

Every calculator gives a row, with a message, for each entity and combination that fails.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import entropy, fits, ledger, pairs
from . import grid as G
from . import series as S

#: What each algorithm writes, how its done entities are known, and the tables that it needs.
TASKS = {
    "quality": {"done": "quality", "states": ("done",), "tables": ("quality", "anomalies")},
    "entropy": {"done": "entropy", "states": ("done",), "tables": ("entropy",)},
    "interpolation": {"done": "interpolation", "states": ("done",), "tables": ("interpolation",)},
    "shift": {"done": "shift_labels", "states": ("done",), "tables": ("shift_labels",)},
    "quantile": {"done": "status", "states": ("done",), "tables": ("labels", "extremes", "transitions", "status")},
    "pooled": {"done": "status", "states": ("done",), "tables": ("thresholds", "labels", "extremes", "transitions", "status")},
    "tails": {"done": "tail_fits", "states": ("done", "error"), "tables": ("tail_fits", "tail_extremes", "return_levels")},
    "pooled processes": {"done": "processes", "states": ("done", "error"), "tables": ("processes", "likelihood_ratios", "segments")},
    "tail processes": {"done": "processes", "states": ("done", "error"), "tables": ("processes", "likelihood_ratios", "tail_extremes")},
    "comparison": {"done": "status", "states": ("done", "error"), "tables": ("status",)},
}


def pending(task: str, all_ids: DataFrame, status: DataFrame) -> DataFrame:
    """Entities that a task has still to do, by its own rule of what is done."""
    if task not in TASKS:
        raise ValueError(f"no task is called {task}")
    return ledger.candidates(all_ids, None, ledger.done(status, states=TASKS[task]["states"]))


# -- thresholds, labels, extremes ----------------------------------------------------------


def quantile_extremes(rows: DataFrame, quantiles: Sequence[float] = (0.9, 0.95)) -> DataFrame:
    """Labels at several quantiles of the anomaly (low at 1 - q), in one frame with their quantile."""
    indexed, out = S.climatology_anomaly(rows), None
    for q in quantiles:
        one = S.label(S.thresholds(indexed, round(1 - q, 9), q)).withColumn("threshold_quantile", F.lit(q).cast("decimal(5,4)"))
        out = one if out is None else out.unionByName(one)
    return out


def pooled_extremes(rows: DataFrame, quantiles: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """Labels of the percentile index at pooled thresholds of several quantiles; entities without a fit have none."""
    index = S.percentile_rank(rows).withColumn("index_value", F.round("percentile", 9)).where("index_value is not null")
    out = None
    for q in quantiles:
        one = fits.with_pooled_thresholds(index, fits.cross_entropy_thresholds(index, high=1 - q, low=1 - q))
        one = S.label(one.withColumn("threshold_quantile", F.lit(q).cast("decimal(5,4)")))
        out = one if out is None else out.unionByName(one)
    return out


def label_by_month(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Labels at thresholds of each calendar month; a month without thresholds is normal."""
    month = thresholds.select("entity", "month", "threshold_low", "threshold_high")
    return S.label(rows.join(month, ["entity", "month"], "left"))


def is_empty_series(median: Column) -> Column:
    """Whether an entity's median is 0."""
    return F.coalesce(median == 0, F.lit(False))


# -- processes -----------------------------------------------------------------------------


def strengths_by(route: str, labelled: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Strengths of extreme months: ``index`` beyond the label's threshold, ``amplitude`` beyond the month's own quantile at the entity's share."""
    if route == "index":
        return S.strengths(labelled)
    if route == "amplitude":
        from .summaries import amplitude_thresholds

        own = amplitude_thresholds(labelled.join(shares.select("entity", "share"), "entity"))
        beyond = F.greatest(F.abs(F.col("value")) - F.col("threshold"), F.lit(0.0))
        return labelled.join(own, ["entity", "month"]).withColumn("strength", F.when(F.col("extreme_label") == "normal", 0.0).otherwise(beyond)).drop("threshold")
    raise ValueError(f"no route is called {route}")


def segment_process_events(labelled: DataFrame, mapping: str = "normalize", rate: float = 0.8) -> DataFrame:
    """The strongest events of bridged segments, as events of two kinds (0 low, 1 high)."""
    decayed = S.decay_index(S.phi(strengths_by("index", labelled), mapping), rate=rate)
    events = S.segment_events(decayed, S.segments(decayed))
    return events.select("entity", "month_ordinal", (F.col("extreme_label") == "extreme_high").cast("int").alias("event_kind"))


def tail_process_events(rows: DataFrame, quantile: float = 0.95, run: int = 3) -> DataFrame:
    """Peaks of clusters beyond both tails' quantiles of each entity, as events of two kinds."""
    out = None
    for kind, tail in ((0, "low"), (1, "high")):
        side = S.for_tail(rows, tail)
        level = F.percentile("value", F.lit(quantile)).over(S.by_entity())
        peaks = S.decluster(side.withColumn("threshold", level), run=run).select("entity", "month_ordinal", F.lit(kind).alias("event_kind"))
        out = peaks if out is None else out.unionByName(peaks)
    return out


def spans(rows: DataFrame) -> DataFrame:
    """First and last month of each entity.  Their values are counted, so that a query with spans and values sums the facts once for both."""
    found = rows.groupBy("entity").agg(F.min("month_ordinal").alias("first"), F.max("month_ordinal").alias("last"), F.count("value").alias("n"))
    return found.where("n >= 0").drop("n")


def processes(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Fitted processes of all entities of rows; those without events have a row that says so."""
    months = spans(rows)
    found = fits.excitation(events, months)
    return months.select("entity").join(found, "entity", "left").withColumn("error", F.when(F.col("mu_d").isNull() & F.col("error").isNull(), F.lit("no events")).otherwise(F.col("error")))


def compared(left: DataFrame, right: DataFrame, names: tuple[str, str], value: str) -> DataFrame:
    """Two methods' results side by side, each with its own error; a method's failure leaves the other's result."""
    a, b = (rows.select("entity", F.col(value).alias(f"{n}_{value}"), F.col("error").alias(f"{n}_error")) for rows, n in zip((left, right), names))
    out = a.join(b, "entity", "full")
    difference = F.abs(F.col(f"{names[0]}_{value}") - F.col(f"{names[1]}_{value}"))
    return out.withColumn("difference", difference)


def status_of(compared_: DataFrame, names: tuple[str, str], message: int = 500) -> DataFrame:
    """done, partial or error of each entity, with its messages cut to a length."""
    a, b = (F.col(f"{n}_error") for n in names)
    state = F.when(a.isNull() & b.isNull(), "done").when(a.isNotNull() & b.isNotNull(), "error").otherwise("partial")
    return compared_.select("entity", state.alias("status"), F.nullif(F.substring(F.concat_ws("; ", a, b), 1, message), F.lit("")).alias("error_message"))


# -- resumable runs and comparisons --------------------------------------------------------


def entropy_results(rows: DataFrame, finished: DataFrame) -> DataFrame:
    """Overall entropy, trend of annual entropy and amplitude ratio of the entities that aren't finished."""
    left = rows.join(finished.select("entity").distinct(), "entity", "left_anti")
    trend = entropy.trend(entropy.annual_entropy(left), "ae", 5).select("entity", "slope", "trend")
    return entropy.overall_entropy(left).join(trend, "entity", "left").join(entropy.amplitude_ratio(left), "entity", "left")


def by_chunks(ids: DataFrame, finished: DataFrame, size: int, compute: Callable[[int, int], DataFrame], store: Callable[[DataFrame], None]) -> int:
    """Runs what is pending chunk by chunk and stores each, so that a run that is cut off resumes; returns the number of chunks."""
    starts = [(r["chunk_start"], r["chunk_end"]) for r in ledger.pending_chunks(ids, finished, size).orderBy("chunk_start").toLocalIterator()]  # a row a chunk
    for start, end in starts:
        store(compute(start, end))
    return len(starts)


def refresh_column(results: DataFrame, fresh: DataFrame, column: str) -> DataFrame:
    """Stored results with one column anew; entities that fresh lacks keep theirs."""
    joined = results.join(fresh.select("entity", F.col(column).alias("_fresh"), F.lit(True).alias("_has")), "entity", "left")
    return joined.withColumn(column, F.when(F.col("_has"), F.col("_fresh")).otherwise(F.col(column))).select(*results.columns)


def subset_against_all(facts: DataFrame, info: DataFrame, subset: DataFrame, size: float = 0.5) -> DataFrame:
    """Events a entity in each cell, of a subset and of all entities, and their difference."""
    part = G.counts(S.of_entities(facts, subset), info, size=size)
    merged = G.merge_grids([part, G.counts(facts, info, size=size)], ["subset", "all"])
    return merged.select("cell_lat", "cell_lon", "subset", "all", "entity_count", (F.col("subset") / F.col("all")).alias("share"))


def stored_processes(rows: DataFrame, quantile: float | None = None, test: str | None = None, ids: Sequence[int] | None = None, passed: bool | None = None, order: str = "entity", limit: int | None = None) -> DataFrame:
    """Rows of fitted processes or tests, by whichever filters are given, sorted and cut."""
    if quantile is not None:
        rows = rows.where(F.col("threshold_quantile") == F.lit(str(quantile)).cast("decimal(5,4)"))
    if test is not None:
        rows = rows.where(F.col("test_name") == test)
    if ids is not None:
        rows = rows.where(F.col("entity").isin(list(ids)))
    if passed is not None:
        rows = rows.where(F.col("qc_pass") == passed)
    rows = rows.orderBy(order, *[c for c in ("entity", "threshold_quantile", "tail") if c in rows.columns and c != order])
    return rows if limit is None else rows.limit(limit)


def flat_fits(found: DataFrame, k: int) -> DataFrame:
    """Fits with their vectors as columns, NaN as null: what a table of results holds."""
    clean = lambda c: F.when(~F.isnan(c), c)
    vectors = [clean(F.get(F.col(c), F.lit(j))).alias(f"{n}_{j}") for c, n in (("lambdas", "lambda"), ("moments", "b")) for j in range(k)]
    return found.select("entity", clean(F.col("threshold_high")).alias("threshold_high"), clean(F.col("threshold_low")).alias("threshold_low"), *vectors)


def deep_basins(info: DataFrame, least: int = 8) -> DataFrame:
    """Entities whose place in the hierarchy is deeper than a level."""
    return info.where(F.col("level") > least).select("entity", "level")


def impact(partners: DataFrame, rows: DataFrame) -> DataFrame:
    """Both partners' metrics and events, for pairs of which both have a series."""
    return pairs.pair_metrics(partners, rows).join(pairs.pair_events(partners, rows), ["entity", "partner"])
