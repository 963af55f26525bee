"""Ordered-series operators: normalisation, frozen months, anomalies, labels, runs and clusters.

All take and return long frames (entity, year, month, month_ordinal, value).  Everything is a
window over one entity's rows or a join on its keys, so one shuffle by entity serves a chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def by_entity() -> WindowSpec:
    return Window.partitionBy("entity")


def in_time() -> WindowSpec:
    return by_entity().orderBy("month_ordinal")


def by_month() -> WindowSpec:
    return Window.partitionBy("entity", "month")


# -- scans and predicates ------------------------------------------------------------------


def in_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of entities in [start, end); the predicate reaches the scan."""
    return rows.where((F.col("entity") >= start) & (F.col("entity") < end))


def of_entities(rows: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Rows of the given entities: a literal list for few, a semi join for a frame."""
    if isinstance(ids, list):
        return rows.where(F.col("entity").isin(ids))
    return rows.join(ids.select("entity").distinct(), "entity", "left_semi")


def normalise(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """Keeps months 1..12 with a value, the first of repeated months (by order, else by place in the source), and adds year_month and the ordinal."""
    placed = rows.withColumn("_place", F.monotonically_increasing_id() if order is None else order)
    first = F.row_number().over(Window.partitionBy("entity", "year", "month").orderBy("_place", "value"))
    kept = placed.where(F.col("month").between(1, 12) & F.col("value").isNotNull()).withColumn("rn", first).where("rn = 1").drop("rn", "_place")
    return kept.withColumns({"year_month": F.col("year") * 100 + F.col("month"), "month_ordinal": F.col("year") * 12 + F.col("month") - 1})


def without_frozen(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    return rows.join(frozen, ["entity", "month_ordinal"], "left_anti")


def frozen_runs(frozen: DataFrame) -> DataFrame:
    """Runs of consecutive frozen months: entity, first, last, months (gaps and islands)."""
    island = F.col("month_ordinal") - F.row_number().over(in_time())
    runs = frozen.distinct().withColumn("island", island).groupBy("entity", "island")
    return runs.agg(F.min("month_ordinal").alias("first"), F.max("month_ordinal").alias("last"), F.count("*").alias("months")).drop("island")


def without_frozen_but_anchors(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """Drops frozen months but each run's first."""
    anchors = frozen_runs(frozen).select("entity", F.col("first").alias("month_ordinal"))
    return without_frozen(rows, frozen.join(anchors, ["entity", "month_ordinal"], "left_anti"))


def hold_plateaus(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """Values of frozen months replaced by their run's first value; the last value before each month that isn't a later one."""
    runs = frozen.distinct().withColumn("island", F.col("month_ordinal") - F.row_number().over(in_time()))
    first = F.min("month_ordinal").over(Window.partitionBy("entity", "island"))
    marked = rows.join(runs.select("entity", "month_ordinal", first.alias("anchor")), ["entity", "month_ordinal"], "left")
    held = F.first("value").over(Window.partitionBy("entity", "anchor").orderBy("month_ordinal"))
    return marked.withColumn("held", F.when(F.col("anchor").isNull(), F.col("value")).otherwise(held)).drop("anchor")


def with_time(rows: DataFrame) -> DataFrame:
    """Years since the entity's first year, as the axis of seasonal models."""
    time = (F.col("year") - F.min("year").over(by_entity())).cast("double") + (F.col("month") - 1).cast("double") / 12
    return rows.withColumn("time", time)


def for_tail(rows: DataFrame, tail: str) -> DataFrame:
    return rows.withColumn("value", -F.col("value")) if tail == "low" else rows


def enough_months(rows: DataFrame, per_month: int = 20, total: int = 240) -> DataFrame:
    """Entities with enough observations in all and in each of the twelve calendar months."""
    counts = rows.groupBy("entity", "month").agg(F.count("*").alias("n")).groupBy("entity")
    enough = counts.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count("*").alias("months"))
    return enough.where((F.col("n") >= total) & (F.col("months") == 12) & (F.col("least") >= per_month)).select("entity", "n")


# -- anomalies, thresholds, labels ---------------------------------------------------------


def climatology_anomaly(rows: DataFrame) -> DataFrame:
    """Adds the month's mean over all years and the anomaly from it.

    Values are added up in their own order: the same rows give the same mean in every plan, to the last bit, so that
    thresholds taken from anomalies in one branch of a query hold for those of another.
    """
    mean = F.avg("value").over(by_month().orderBy("value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("climatology", mean).withColumn("index_value", F.round(F.col("value") - F.col("climatology"), 9))


def percentile_rank(rows: DataFrame, column: str = "value") -> DataFrame:
    """100 * (values of the same calendar month that aren't larger) / (n + 1); null for fewer than two."""
    upto = F.count("*").over(by_month().orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.count("*").over(by_month())
    return rows.withColumn("percentile", F.when(n >= 2, upto * 100.0 / (n + 1)))


def thresholds(rows: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Adds the entity's low and high quantile of index_value, rounded so that ties are ties anywhere."""
    q = F.percentile("index_value", F.array(F.lit(low), F.lit(high))).over(by_entity())
    return rows.withColumn("_q", q).withColumns({"threshold_low": F.round(F.col("_q")[0], 9), "threshold_high": F.round(F.col("_q")[1], 9)}).drop("_q")


def label(rows: DataFrame) -> DataFrame:
    """extreme_low is checked first; both bounds are inclusive."""
    kind = F.when(F.col("index_value") <= F.col("threshold_low"), "extreme_low").when(F.col("index_value") >= F.col("threshold_high"), "extreme_high")
    return rows.withColumn("extreme_label", kind.otherwise("normal"))


def extremes(labelled: DataFrame) -> DataFrame:
    """Extreme months with the threshold that they passed."""
    high = F.col("extreme_label") == "extreme_high"
    return labelled.where("extreme_label <> 'normal'").select(
        "entity", "year", "month", "month_ordinal", F.when(high, "high").otherwise("low").alias("event_type"), "value", "climatology", "index_value",
        F.when(high, F.col("threshold_high")).otherwise(F.col("threshold_low")).alias("threshold"),
    )


def severities(events: DataFrame) -> DataFrame:
    """How far beyond its threshold each extreme lies."""
    return events.withColumn("severity", F.abs(F.col("index_value") - F.col("threshold")))


def abrupt_transitions(labelled: DataFrame) -> DataFrame:
    """Opposite extremes in adjacent months."""
    rows = labelled.select("entity", "month_ordinal", "extreme_label", "index_value", F.lead(F.struct("month_ordinal", "extreme_label", "index_value")).over(in_time()).alias("next"))
    opposite = (F.col("extreme_label").isin("extreme_low", "extreme_high")) & F.col("next.extreme_label").isin("extreme_low", "extreme_high") & (F.col("extreme_label") != F.col("next.extreme_label"))
    return rows.where(opposite & (F.col("next.month_ordinal") == F.col("month_ordinal") + 1)).select(
        "entity", F.col("month_ordinal").alias("from_ordinal"), F.col("next.month_ordinal").alias("to_ordinal"),
        F.when(F.col("extreme_label") == "extreme_low", "low_to_high").otherwise("high_to_low").alias("transition_type"),
        F.col("index_value").alias("from_index"), F.col("next.index_value").alias("to_index"),
    )


def zscore_events(rows: DataFrame, limit: float = 3.0, spread: Callable[[str], Column] = F.stddev_pop) -> DataFrame:
    """Months more than ``limit`` standard deviations, of the population unless told otherwise, from the entity's mean."""
    z = ratio(F.col("value") - F.avg("value").over(by_entity()), spread("value").over(by_entity()))
    return rows.withColumn("z", z).where(F.abs("z") > limit).withColumn("z", F.round("z", 3)).withColumn("event_type", F.when(F.col("z") > 0, "high").otherwise("low"))


def deseasonalise(rows: DataFrame) -> DataFrame:
    """Adds the value without its month's deviation from the mean."""
    seasonal = F.avg("value").over(by_month()) - F.avg("value").over(by_entity())
    return rows.withColumn("seasonal", seasonal).withColumn("deseasoned", F.col("value") - F.col("seasonal"))


def seasonality_dominance(rows: DataFrame) -> DataFrame:
    """Share of each entity's variance that its monthly means explain."""
    return deseasonalise(rows).groupBy("entity").agg(ratio(F.var_pop("seasonal"), F.var_pop("value")).alias("dominance"))


# -- runs, clusters, segments --------------------------------------------------------------


def _islands(rows: DataFrame, breaks: Column, order: WindowSpec | None = None) -> DataFrame:
    """Numbers runs within an entity: a new one begins wherever breaks holds."""
    return rows.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over((order or in_time()).rowsBetween(Window.unboundedPreceding, 0)))


def collinear_segments(rows: DataFrame, least: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """Runs of at least ``least`` positive adjacent months whose steps are equal, one row each."""
    v, o = F.col("value"), F.col("month_ordinal")
    stepped = rows.where(v > 0).withColumns({
        "pos": F.row_number().over(in_time()), "before": v - F.lag("value").over(in_time()), "after": F.lead("value").over(in_time()) - v,
        "gap_before": o - F.lag("month_ordinal").over(in_time()), "gap_after": F.lead("month_ordinal").over(in_time()) - o,
        "ordinal_before": F.lag("month_ordinal").over(in_time()), "n_obs": F.count("*").over(by_entity()),
    })
    valid = stepped.where((F.col("gap_before") == 1) & (F.col("gap_after") == 1) & (F.abs(F.col("before") - F.col("after")) <= tolerance))
    runs = valid.withColumn("island", F.col("pos") - F.row_number().over(by_entity().orderBy("pos"))).groupBy("entity", "island").agg(
        (F.min("pos") - 1).alias("first_pos"), (F.max("pos") + 1).alias("last_pos"), F.min("ordinal_before").alias("first_ordinal"), F.first("n_obs").alias("n_obs"),
        (F.max(F.greatest(F.abs("before"), F.abs("after"))) <= tolerance).alias("flat"),
    )
    return runs.withColumn("points", F.col("last_pos") - F.col("first_pos") + 1).where(F.col("points") >= least).drop("island")


def interpolation_summary(rows: DataFrame, least: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """Per entity: numbers and largest lengths of linear and flat segments, share of collinear points, first linear month."""
    segments = collinear_segments(rows, least, tolerance)
    points = segments.select("entity", F.explode(F.sequence("first_pos", "last_pos")).alias("p")).distinct().groupBy("entity").agg(F.count("*").alias("collinear"))
    linear = ~F.col("flat")
    counts = segments.groupBy("entity").agg(
        F.sum(linear.cast("long")).alias("n_linear"), F.sum(F.col("flat").cast("long")).alias("n_flat"),
        F.max(F.when(linear, F.col("points"))).alias("max_linear"), F.max(F.when(F.col("flat"), F.col("points"))).alias("max_flat"),
        F.min(F.when(linear, F.col("first_ordinal"))).alias("first_linear_ordinal"),
    )
    n = rows.where(F.col("value") > 0).groupBy("entity").agg(F.count("*").alias("n_obs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = n.join(counts, "entity", "left").join(points, "entity", "left")
    return out.select("entity", "n_obs", *map(zero, ("n_linear", "n_flat", "max_linear", "max_flat")), (F.coalesce("collinear", F.lit(0)) / F.col("n_obs")).alias("collinear_ratio"), "first_linear_ordinal")


def decluster(rows: DataFrame, threshold: str = "threshold", run: int = 3) -> DataFrame:
    """Exceedances in clusters: a new one after ``run`` rows or more below; the largest (first of ties) represents it."""
    placed = rows.withColumn("pos", F.row_number().over(in_time())).where(F.col("value") > F.col(threshold))
    gap = F.col("pos") - F.lag("pos").over(in_time()) - 1
    clusters = _islands(placed, F.coalesce(gap >= run, F.lit(True))).withColumnRenamed("island", "cluster_id")
    whole = Window.partitionBy("entity", "cluster_id")
    best = clusters.withColumns({"size": F.count("*").over(whole), "rn": F.row_number().over(whole.orderBy(F.desc("value"), "pos"))})
    return best.where("rn = 1").select("entity", "cluster_id", "size", "month_ordinal", "value", F.col(threshold).alias("threshold"))


def singletons(rows: DataFrame, threshold: str = "threshold") -> DataFrame:
    """Every exceedance as a cluster of its own."""
    over = rows.where(F.col("value") > F.col(threshold))
    return over.select("entity", F.row_number().over(in_time()).cast("long").alias("cluster_id"), F.lit(1).cast("long").alias("size"), "month_ordinal", "value", F.col(threshold).alias("threshold"))


def decluster_typed(events: DataFrame, run: int = 3) -> DataFrame:
    """Clusters of events of one type; a new one on a change of type or a gap of ``run`` months or more."""
    change = F.col("event_type") != F.lag("event_type").over(in_time())
    gap = F.col("month_ordinal") - F.lag("month_ordinal").over(in_time()) - 1 >= run
    clusters = _islands(events, F.coalesce(change | gap, F.lit(True))).withColumnRenamed("island", "cluster_id")
    whole = Window.partitionBy("entity", "cluster_id")
    best = clusters.withColumns({"size": F.count("*").over(whole), "rn": F.row_number().over(whole.orderBy(F.desc("severity"), "month_ordinal"))})
    return best.where("rn = 1").select("entity", "cluster_id", "size", "event_type", "month_ordinal", "severity")


#: Months of a block of decay_index: exp(0.8 * 400) is far from overflow, and what is older than a block is 0.
DECAY_BLOCK = 400


def decay_index(rows: DataFrame, phi: str = "phi", rate: float = 0.8) -> DataFrame:
    """S_k = S_(k-1) exp(-rate gap) + phi_k, as a prefix sum: terms are scaled by exp(rate u) with u from the block's first month.

    The block before adds its sum; blocks further back would add less than exp(-rate DECAY_BLOCK) of theirs.
    """
    t = F.col("month_ordinal") - F.min("month_ordinal").over(by_entity())
    placed = rows.withColumn("t", t).withColumns({"block": F.floor(F.col("t") / DECAY_BLOCK), "u": F.col("t") % DECAY_BLOCK})
    scaled = F.col(phi) * F.exp(rate * F.col("u"))
    here = F.sum(scaled).over(Window.partitionBy("entity", "block").orderBy("month_ordinal").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum(scaled).over(by_entity().orderBy("block").rangeBetween(-1, -1))
    index = F.exp(-rate * F.col("u")) * (here + F.coalesce(before, F.lit(0.0)) * F.exp(F.lit(-rate * DECAY_BLOCK)))
    return placed.withColumn("decay_index", index).drop("t", "block", "u")


def phi(rows: DataFrame, mapping: str = "identity") -> DataFrame:
    """Strengths mapped to event weights: as they are, log1p, or over the entity's mean of positive ones."""
    s = F.col("strength")
    if mapping == "log1p":
        return rows.withColumn("phi", F.log1p(s))
    if mapping == "normalize":
        return rows.withColumn("phi", F.coalesce(ratio(s, F.avg(F.when(s > 0, s)).over(by_entity())), F.lit(0.0)))
    return rows.withColumn("phi", s)


def strengths(labelled: DataFrame) -> DataFrame:
    """Exceedance beyond the threshold of the label's side, 0 for normal months."""
    high, low = F.col("index_value") - F.col("threshold_high"), F.col("threshold_low") - F.col("index_value")
    label_ = F.col("extreme_label")
    return labelled.withColumn("strength", F.when(label_ == "extreme_high", high).when(label_ == "extreme_low", low).otherwise(0.0))


def segments(rows: DataFrame, bridge: Column | None = None) -> DataFrame:
    """Runs of extreme months by row, with one normal month between or after where the decay index is above 1."""
    extreme = F.col("extreme_label") != "normal"
    if bridge is None:
        bridge = F.lag(extreme).over(in_time()) & (F.col("decay_index") > 1)
    placed = rows.withColumns({"pos": F.row_number().over(in_time()), "member": extreme | F.coalesce(bridge, F.lit(False))})
    members = placed.where("member").withColumn("island", F.col("pos") - F.row_number().over(in_time()))
    runs = members.groupBy("entity", "island").agg(
        F.min("month_ordinal").alias("start_ordinal"), F.max("month_ordinal").alias("end_ordinal"), F.count("*").alias("months"),
        F.max((F.col("extreme_label") == "extreme_high").cast("int")).alias("has_high"), F.max((F.col("extreme_label") == "extreme_low").cast("int")).alias("has_low"),
        F.max("decay_index").alias("max_s"), F.avg("decay_index").alias("mean_s"), F.sum("decay_index").alias("sum_s"), F.sum(extreme.cast("long")).alias("n_extremes"),
    )
    kind = F.when((F.col("has_high") == 1) & (F.col("has_low") == 1), "transition").otherwise("unilateral")
    return runs.withColumns({"segment_type": kind, "segment_id": F.row_number().over(by_entity().orderBy("start_ordinal"))}).drop("island")


def bidirectional_bridge(rate: float = 0.8, least: float = 1.0) -> Column:
    """A normal month between two extremes whose decayed strengths support it from both sides."""
    extreme = F.col("extreme_label") != "normal"
    o = F.col("month_ordinal")
    left = F.lag("strength").over(in_time()) * F.exp(-rate * (o - F.lag("month_ordinal").over(in_time())))
    right = F.lead("strength").over(in_time()) * F.exp(-rate * (F.lead("month_ordinal").over(in_time()) - o))
    return ~extreme & F.lag(extreme).over(in_time()) & F.lead(extreme).over(in_time()) & (left + right > least)


def segment_events(rows: DataFrame, segments_: DataFrame) -> DataFrame:
    """In transition segments, runs of one type among the extremes; the strongest month (first of ties) of each."""
    inside = segments_.where("segment_type = 'transition'").select(F.col("entity").alias("of"), "segment_id", "start_ordinal", "end_ordinal")
    hit = rows.where("extreme_label <> 'normal'").join(inside, (F.col("entity") == F.col("of")) & F.col("month_ordinal").between(F.col("start_ordinal"), F.col("end_ordinal")))
    order = Window.partitionBy("entity", "segment_id").orderBy("month_ordinal")
    runs = _islands(hit, F.coalesce(F.col("extreme_label") != F.lag("extreme_label").over(order), F.lit(True)), order)
    best = F.row_number().over(Window.partitionBy("entity", "segment_id", "island").orderBy(F.desc("strength"), "month_ordinal"))
    return runs.withColumn("rn", best).where("rn = 1").select("entity", "segment_id", F.col("island").alias("run_id"), "extreme_label", "month_ordinal", "strength")


def timeline(high: DataFrame, low: DataFrame) -> DataFrame:
    """Two kinds of events as one typed sequence: 0 dry, 1 wet, ordered by time, then kind."""
    at = lambda rows, kind: rows.select("entity", (F.floor(F.col("month_ordinal") / 12) + (F.col("month_ordinal") % 12) / 12.0).alias("time"), F.lit(kind).alias("event_kind"))
    both = at(low, 0).unionByName(at(high, 1))
    return both.withColumn("place", F.row_number().over(by_entity().orderBy("time", "event_kind")))
