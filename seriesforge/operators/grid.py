"""Spatial grid and zonal aggregation, and the joins of grids.

Facts are aggregated by entity before they meet the attributes, so that what is shuffled to the
cells is at most a row an entity.  Cells are joined on whole numbers, not on coordinates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio

CELL = ["cell_x", "cell_y"]


def with_cell(info: DataFrame, size: float = 0.5) -> DataFrame:
    """entity and the whole-number cell of its coordinates."""
    place = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("long")
    return info.select("entity", place("lon").alias("cell_x"), place("lat").alias("cell_y"))


def with_edges(cells: DataFrame, size: float = 0.5) -> DataFrame:
    """Cells with the coordinates of their lower edges."""
    edge = lambda c: F.col(c).cast("double") * F.lit(float(size))
    return cells.select(edge("cell_y").alias("cell_lat"), edge("cell_x").alias("cell_lon"), *[c for c in cells.columns if c not in CELL])


def counts(facts: DataFrame, info: DataFrame, keys: list[str] | None = None, size: float = 0.5) -> DataFrame:
    """Entities and events in each cell (and key)."""
    keys = keys or []
    per = facts.groupBy("entity", *keys).agg(F.count("*").alias("n"))
    out = per.join(with_cell(info, size), "entity").groupBy(*CELL, *keys).agg(F.count_distinct("entity").alias("entity_count"), F.sum("n").alias("event_count"))
    return with_edges(out, size)


def per_entity_stats(facts: DataFrame, info: DataFrame, measures: dict[str, Column], keys: list[str] | None = None, size: float = 0.5) -> DataFrame:
    """Mean and median over a cell's entities of sums over each entity's rows."""
    keys = keys or []
    per = facts.groupBy("entity", *keys).agg(*[F.sum(c).alias(k) for k, c in measures.items()])
    stats = [f(k).alias(f"{name}_{k}") for k in measures for name, f in (("mean", F.avg), ("median", F.median))]
    return with_edges(per.join(with_cell(info, size), "entity").groupBy(*CELL, *keys).agg(F.count("*").alias("entity_count"), *stats), size)


def rates(fits: DataFrame, info: DataFrame, size: float = 0.5) -> DataFrame:
    """Share of fits that converged in each cell."""
    joined = fits.join(with_cell(info, size), "entity").groupBy(*CELL)
    return with_edges(joined.agg(F.count("*").alias("n"), F.avg(F.col("converged").cast("double")).alias("convergence_rate")), size)


def medians(fits: DataFrame, info: DataFrame, columns: list[str], keys: list[str] | None = None, size: float = 0.5, means: tuple[str, ...] = ()) -> DataFrame:
    """Medians, and means of some columns, of a cell's converged fits."""
    joined = fits.where("converged").join(with_cell(info, size), "entity").groupBy(*CELL, *(keys or []))
    return with_edges(joined.agg(F.count("*").alias("n"), *[F.median(c).alias(f"median_{c}") for c in columns], *[F.avg(c).alias(f"mean_{c}") for c in means]), size)


def frequencies(fits: DataFrame, info: DataFrame, size: float = 0.5) -> DataFrame:
    """Both tails of one entity and quantile, side by side: a conditional aggregate in place of a self-join."""
    f = ratio(F.col("n_extremes").cast("double"), F.col("n_observations").cast("double"))
    side = lambda tail: F.max(F.when(F.col("tail") == tail, f))
    both = fits.where("converged").groupBy("entity", "threshold_quantile").agg(side("high").alias("high"), side("low").alias("low"))
    total = both.where("high is not null and low is not null").withColumn("total", F.col("high") + F.col("low"))
    out = total.join(with_cell(info, size), "entity").groupBy(*CELL, "threshold_quantile")
    return with_edges(out.agg(F.count("*").alias("n"), F.avg("total").alias("mean_frequency"), F.median("total").alias("median_frequency")), size)


def exceedance_comparison(left: DataFrame, right: DataFrame, info: DataFrame, size: float = 0.5) -> DataFrame:
    """Two labellings (entity, high, low) of the same months: counts, rates and their difference in each cell."""
    cells = with_cell(info, size)

    def side(rows: DataFrame, name: str) -> DataFrame:
        per = rows.groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.col("high").cast("long")).alias("high"), F.sum(F.col("low").cast("long")).alias("low"))
        out = per.join(cells, "entity").groupBy(*CELL)
        return out.agg(*[F.sum(c).alias(f"{name}_{c}") for c in ("n", "high", "low")])

    both = side(left, "a").join(side(right, "b"), CELL)
    rate = lambda k, c: ratio(F.col(f"{k}_{c}").cast("double"), F.col(f"{k}_n").cast("double"))
    return with_edges(both.withColumns({"high_rate_difference": rate("a", "high") - rate("b", "high"), "low_rate_difference": rate("a", "low") - rate("b", "low")}), size)


def clipped_counts(facts: DataFrame, info: DataFrame, size: float = 10.0) -> DataFrame:
    """Counts on a fixed grid whose outermost cells take what lies beyond it."""
    place = lambda c, low, n: F.least(F.greatest(F.floor((F.col(c) - low) / size), F.lit(0)), F.lit(n - 1)).cast("long")
    cells = info.select("entity", place("lat", -90.0, int(180 / size)).alias("row"), place("lon", -180.0, int(360 / size)).alias("column"))
    per = facts.groupBy("entity").agg(F.count("*").alias("n"))
    out = per.join(cells, "entity").groupBy("row", "column").agg(F.count("*").alias("entity_count"), F.sum("n").alias("event_count"))
    return out.withColumn("mean_per_entity", F.col("event_count") / F.col("entity_count"))


STATS = {"median": F.median, "mean": F.avg, "sum": F.sum, "std": F.stddev_pop}


def stats(values: DataFrame, info: DataFrame, wanted: dict[str, tuple[str, str]], size: float = 10.0) -> DataFrame:
    """{result: (column, median | mean | sum | std)} in each cell."""
    joined = values.join(with_cell(info, size), "entity").groupBy(*CELL)
    return with_edges(joined.agg(F.count_distinct("entity").alias("entity_count"), *[STATS[f](c).alias(k) for k, (c, f) in wanted.items()]), size)


def zonal_mean(cells: DataFrame, value: str, band: int = 10, weight: str = "entity_count") -> DataFrame:
    """Means over bands of latitude, weighted."""
    zone = (F.floor(F.col("cell_lat") / band) * band).cast("int").alias("band")
    known = cells.where(F.col(value).isNotNull())
    return known.groupBy(zone).agg(ratio(F.sum(F.col(weight) * F.col(value)), F.sum(weight).cast("double")).alias("zonal_mean"), F.sum(weight).alias("weight"))


def dense(cells: DataFrame, value: str, rows: int, columns: int) -> DataFrame:
    """Every cell of a rows x columns grid, null where nothing is."""
    spark = cells.sparkSession
    spine = spark.range(rows * columns).select((F.col("id") / columns).cast("long").alias("row"), (F.col("id") % columns).alias("column"))
    return spine.join(cells.select("row", "column", value), ["row", "column"], "left")


def merge_grids(grids: list[DataFrame], names: list[str], measure: str = "event_count") -> DataFrame:
    """All grids' cells in one aggregate on whole millionths of degrees; missing measures are 0, entities the largest of the counts."""
    tagged = [g.select("cell_lat", "cell_lon", F.lit(k).alias("_k"), F.col(measure).alias("_v"), "entity_count") for k, g in enumerate(grids)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    whole = [F.round(F.col(c) * 1_000_000).cast("long").alias(f"_{c}") for c in ("cell_lat", "cell_lon")]
    sums = [F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("_v"))), F.lit(0)).alias(n) for k, n in enumerate(names)]
    out = rows.groupBy(*whole).agg(F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon"), *sums, F.max("entity_count").alias("entity_count"))
    return out.select("cell_lat", "cell_lon", *names, F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


def side_by_side(grids: list[tuple[DataFrame, dict[str, str]]], count: str = "entity_count") -> DataFrame:
    """Columns of several grids, each {column: name in the result}, cell by cell in one aggregate; 0 where a grid lacks the cell."""
    names = [n for _, columns in grids for n in columns.values()]
    rows = []
    for grid, columns in grids:
        own = {n: F.col(c).cast("double") for c, n in columns.items()}
        rows.append(grid.select("cell_lat", "cell_lon", F.col(count).alias("entity_count"), *[own.get(n, F.lit(None).cast("double")).alias(n) for n in names]))
    whole = [F.round(F.col(c) * 1_000_000).cast("long").alias(f"_{c}") for c in ("cell_lat", "cell_lon")]
    out = reduce(lambda a, b: a.unionByName(b), rows).groupBy(*whole)
    sums = out.agg(F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon"), F.max("entity_count").alias("entity_count"), *[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])
    return sums.select("cell_lat", "cell_lon", "entity_count", *names)


def zonal_profile(cells: DataFrame, values: list[str], least: int = 1, band: int = 5, weight: str = "entity_count") -> DataFrame:
    """Weighted means of several columns over bands of latitude, of cells with enough entities."""
    zone = (F.floor(F.col("cell_lat") / band) * band).cast("int").alias("band")
    known = lambda v: F.when(F.col(v).isNotNull(), F.col(weight))
    means = [ratio(F.sum(F.col(weight) * F.col(v)), F.sum(known(v)).cast("double")).alias(v) for v in values]
    return cells.where(F.col(weight) >= least).groupBy(zone).agg(*means, F.sum(weight).alias("weight"))


def busy_cells(cells: DataFrame, least: int) -> DataFrame:
    """Cells with enough entities, and their events per entity."""
    return cells.where(F.col("entity_count") >= least).withColumn("mean_per_entity", F.col("event_count") / F.col("entity_count"))


def high_quantile(rows: DataFrame, q: float, least: float) -> DataFrame:
    """Entities whose quantile of values reaches the least: a filter on an aggregate."""
    return rows.groupBy("entity").agg(F.percentile("value", F.lit(q)).alias("q"), F.count_distinct("value").alias("n_values")).where(F.col("q") >= least)


def coerce(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to the types that results have; columns that aren't named stay."""
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])
