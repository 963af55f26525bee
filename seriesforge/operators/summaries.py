"""Summaries of segments, models and events, and lookups by range and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def segment_summary(segments: DataFrame) -> DataFrame:
    """Numbers, mean length and mean strength of segments by type."""
    return segments.groupBy("segment_type").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.avg("months").alias("mean_months"), F.avg("sum_s").alias("mean_strength"), F.sum("n_extremes").alias("n_extremes"))


def model_summary(models: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles of each parameter over all models, one row a parameter."""
    n = len(columns)
    pairs = F.expr(f"stack({n}, {', '.join(f'{chr(39)}{c}{chr(39)}, `{c}`' for c in columns)}) as (parameter, v)")
    quartiles = models.select(pairs).where("v is not null").groupBy("parameter").agg(F.count("*").alias("n"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return quartiles.select("parameter", "n", *[F.col("q")[k].alias(name) for k, name in enumerate(("q1", "median", "q3"))])


def events_per_entity(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Counts for all entities, 0 for those without events."""
    per = events.groupBy("entity").agg(F.count("*").alias("n"))
    return entities.select("entity").join(per, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n"))


def transition_seasonality(transitions: DataFrame) -> DataFrame:
    """Transitions by type and the calendar month in which they end."""
    return transitions.groupBy("transition_type", (F.col("to_ordinal") % 12 + 1).alias("month")).agg(F.count("*").alias("n"))


def amplitude_thresholds(rows: DataFrame, share: str = "share") -> DataFrame:
    """Linear-interpolated quantile of each calendar month's values at a share that the data give (clipped to 0..1).

    rows: entity, month, value and the share, the same for all rows of an entity and month.
    """
    group = Window.partitionBy("entity", "month")
    placed = rows.withColumns({"pos": F.row_number().over(group.orderBy("value")) - 1, "h": (F.count("*").over(group) - 1) * F.least(F.greatest(F.col(share), F.lit(0.0)), F.lit(1.0))})
    at = lambda edge: F.max(F.when(F.col("pos") == edge(F.col("h")), F.col("value")))
    ends = placed.groupBy("entity", "month").agg(at(F.floor).alias("low"), at(F.ceil).alias("high"), F.max("h").alias("h"))
    return ends.select("entity", "month", (F.col("low") + (F.col("h") - F.floor("h")) * (F.col("high") - F.col("low"))).alias("threshold"))


def basin_lookup(points: DataFrame, basins: DataFrame, digits: int = 6) -> DataFrame:
    """The finer basins within the coarser one that each point's code names: a range of codes met as equality of their heads."""
    head = lambda c: F.floor(F.col(c) / F.lit(10**digits)).cast("long")
    left = points.withColumn("_head", head("code"))
    right = basins.select(F.col("code").alias("basin"), "south", "north", "west", "east", head("code").alias("_head"))
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return left.join(right, "_head").where(inside).select("entity", "basin")


def contains(ring: list[tuple[float, float]], lat: str = "lat", lon: str = "lon"):
    """Whether a ring of (lat, lon) corners holds the point: crossings of its edges to the east are odd in number."""
    y, x = F.col(lat), F.col(lon)
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def residual_points(events: DataFrame, rate: str = "rate") -> DataFrame:
    """Probability-probability points of waiting times that should be exponential: each one's own and its plotting place."""
    order = Window.partitionBy("entity").orderBy("month_ordinal")
    waits = events.withColumn("w", (F.col("month_ordinal") - F.lag("month_ordinal").over(order)) * F.col(rate)).where("w is not null")
    by_size = Window.partitionBy("entity").orderBy("w", "month_ordinal")
    n = F.count("*").over(Window.partitionBy("entity"))
    return waits.select("entity", "month_ordinal", (1 - F.exp(-F.col("w"))).alias("model"), (F.row_number().over(by_size) / (n + 1)).alias("empirical"))


def top_values(rows: DataFrame, k: int) -> DataFrame:
    """The k largest values; ties by entity, then the later month."""
    return rows.orderBy(F.desc("value"), "entity", F.desc("month_ordinal")).limit(k).select("entity", "month_ordinal", "value")


def density(cells: DataFrame, value: str = "event_count", radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """Counts of a row/column grid smoothed by a Gaussian over neighbours, over the weights of the cells that are there."""
    import math

    spark = cells.sparkSession
    kernel = spark.createDataFrame([(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)], "dr long, dc long, w double")
    spread = cells.join(kernel, F.lit(True)).select((F.col("row") + F.col("dr")).alias("row"), (F.col("column") + F.col("dc")).alias("column"), (F.col(value) * F.col("w")).alias("wv"), "w")
    sums = spread.groupBy("row", "column").agg(F.sum("wv").alias("wv"), F.sum("w").alias("w"))
    return cells.select("row", "column").join(sums, ["row", "column"]).select("row", "column", ratio(F.col("wv"), F.col("w")).alias("density"))
