"""Pairs of entities: hierarchical nearest matches, aligned series, similarity, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .series import in_time, zscore_events

LEVELS = 11


def nearest(queries: DataFrame, candidates: DataFrame, most_ratio: float = 10.0) -> DataFrame:
    """For each query the nearest candidate at the finest level of the code that has one of comparable area.

    Both sides are spelt out to their ancestors; a level without a fitting candidate falls through to
    the next coarser one, and a query meets the candidates of one basin only, that of its finest fitting level.
    """
    up = lambda rows, *c: rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level")).select(*c, "level", F.floor(F.col("code") / F.pow(F.lit(10.0), LEVELS - F.col("level"))).cast("long").alias("basin"))
    q = up(queries, "entity", "area", "lat", "lon")
    c = up(candidates.select(F.col("entity").alias("partner"), F.col("area").alias("p_area"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "code"), "partner", "p_area", "p_lat", "p_lon")
    free = F.coalesce(F.col("area") <= 0, F.lit(True)) | F.coalesce(F.col("p_area") <= 0, F.lit(True))
    alike = free | (F.greatest(ratio(F.col("area"), F.col("p_area")), ratio(F.col("p_area"), F.col("area"))) <= most_ratio)
    square = (F.col("lat") - F.col("p_lat")) * (F.col("lat") - F.col("p_lat")) + (F.col("lon") - F.col("p_lon")) * (F.col("lon") - F.col("p_lon"))
    found = _finest(q, c, most_ratio).join(c, ["level", "basin"]).where(alike).withColumn("distance", F.sqrt(square))
    # the best of each query is a maximum, which is taken before the shuffle
    best = found.groupBy("entity").agg(F.min(F.struct(-F.col("level"), "distance", "partner")).alias("m"))
    out = queries.select("entity").join(best, "entity", "left")
    return out.select("entity", F.col("m.partner").alias("partner"), (-F.col("m.col1")).alias("level"), F.col("m.distance").alias("distance"))


def _finest(q: DataFrame, c: DataFrame, most_ratio: float) -> DataFrame:
    """Of each query's levels the finest whose basin has a candidate of comparable area: only there it meets candidates.

    In a basin queries and candidates are sorted by area once, from large to small; the last candidate before a query's
    least comparable area is the smallest that could do.  No query meets a coarse basin's candidates one by one.
    """
    known = F.col("area") > 0
    asking = q.withColumns({"at": F.when(known, F.col("area") / most_ratio), "asks": F.lit(1), "p_area": F.lit(None).cast("double"), "open": F.lit(0)})
    there = c.select("level", "basin", F.col("p_area").cast("double").alias("at"), F.lit(0).alias("asks"), F.when(F.col("p_area") > 0, F.col("p_area")).cast("double").alias("p_area"), F.when(F.col("p_area") > 0, 0).otherwise(1).alias("open"))
    basin = Window.partitionBy("level", "basin")
    both = asking.unionByName(there, allowMissingColumns=True)
    smallest = F.last("p_area", ignorenulls=True).over(basin.orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0))
    marked = both.withColumns({"next": smallest, "any": F.max(1 - F.col("asks")).over(basin), "any_open": F.max("open").over(basin)})
    may = (F.col("any_open") == 1) | (~F.coalesce(known, F.lit(False)) & (F.col("any") == 1)) | (ratio(F.col("next"), F.col("area")) <= most_ratio)
    best = marked.where((F.col("asks") == 1) & may).groupBy("entity").agg(F.max(F.struct("level", "basin", "area", "lat", "lon")).alias("m"))
    return best.select("entity", "m.level", "m.basin", "m.area", "m.lat", "m.lon")


def metrics(rows: DataFrame) -> DataFrame:
    """Population coefficient of variation, range over mean, and the deviation of month-over-month changes in percent."""
    before = F.lag("value").over(in_time())
    change = rows.withColumn("change", ratio(F.col("value") - before, before) * 100)
    mean = F.avg("value")
    return change.groupBy("entity").agg(F.count("*").alias("n_obs"), ratio(F.stddev_pop("value"), mean).alias("cv"), ratio(F.max("value") - F.min("value"), mean).alias("range_ratio"), F.stddev_pop("change").alias("change_std"))


def pair_metrics(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Both partners' metrics and their differences."""
    m = metrics(rows)
    names = [c for c in m.columns if c != "entity"]
    left = pairs.join(m.select("entity", *[F.col(c).alias(f"a_{c}") for c in names]), "entity")
    both = left.join(m.select(F.col("entity").alias("partner"), *[F.col(c).alias(f"b_{c}") for c in names]), "partner")
    return both.withColumns({f"delta_{c}": F.col(f"a_{c}") - F.col(f"b_{c}") for c in names if c != "n_obs"})


def aligned(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Months that both partners have: entity, partner, month_ordinal, x, y."""
    x = pairs.join(rows.select("entity", "month_ordinal", F.col("value").alias("x")), "entity")
    return x.join(rows.select(F.col("entity").alias("partner"), "month_ordinal", F.col("value").alias("y")), ["partner", "month_ordinal"])


def similarity(pairs: DataFrame, rows: DataFrame, lags: int = 12) -> DataFrame:
    """Pearson correlation of the aligned series and cosine of their autocorrelations at lags 1..lags."""
    both = aligned(pairs, rows)
    own = Window.partitionBy("entity", "partner")
    centred = both.withColumns({"n": F.count("*").over(own), "u": F.col("x") - F.avg("x").over(own), "v": F.col("y") - F.avg("y").over(own)})
    ahead = own.orderBy("month_ordinal")
    products = [F.sum(F.col(c) * F.col(f"{c}{k}")).alias(f"{c}_{k}") for c in "uv" for k in range(1, lags + 1)]
    shifted = centred.select("*", *[F.lead(c, k).over(ahead).alias(f"{c}{k}") for c in "uv" for k in range(1, lags + 1)])
    sums = shifted.groupBy("entity", "partner").agg(F.max("n").alias("n"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.sum(F.col("u") * F.col("v")).alias("uv"), *products)
    norm = lambda c: F.sqrt(sum((F.col(f"{c}_{k}") * F.col(f"{c}_{k}") for k in range(1, lags + 1)), F.lit(0.0)))
    dot = sum((F.col(f"u_{k}") * F.col(f"v_{k}") for k in range(1, lags + 1)), F.lit(0.0))
    cosine = F.when((F.col("n") > lags) & (F.col("uu") > 0) & (F.col("vv") > 0), ratio(dot, norm("u") * norm("v")))
    return sums.select("entity", "partner", "n", F.when(F.col("n") >= 2, ratio(F.col("uv"), F.sqrt(F.col("uu") * F.col("vv")))).alias("pearson"), F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)).alias("acf_cosine"))


def pair_events(pairs: DataFrame, rows: DataFrame, limit: float = 3.0) -> DataFrame:
    """Numbers of both partners' outlying months and of those that only one of them has."""
    events = zscore_events(rows, limit).select("entity", "month_ordinal")
    months = pairs.join(events, "entity").select("entity", "partner", "month_ordinal", F.lit(1).alias("a"), F.lit(0).alias("b"))
    others = pairs.join(events.withColumnRenamed("entity", "partner"), "partner").select("entity", "partner", "month_ordinal", F.lit(0).alias("a"), F.lit(1).alias("b"))
    seen = months.unionByName(others).groupBy("entity", "partner", "month_ordinal").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    per = seen.groupBy("entity", "partner").agg(F.sum("a").alias("a_events"), F.sum("b").alias("b_events"), F.sum(F.when(F.col("b") == 0, 1).otherwise(0)).alias("only_a"), F.sum(F.when(F.col("a") == 0, 1).otherwise(0)).alias("only_b"))
    return pairs.join(per, ["entity", "partner"], "left").select("entity", "partner", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("a_events", "b_events", "only_a", "only_b")])


def event_share(rows: DataFrame, limit: float = 3.0) -> DataFrame:
    """Months more than ``limit`` sample standard deviations from each entity's mean, and their share of all its months."""
    n = rows.groupBy("entity").agg(F.count("*").alias("n_obs"))
    events = zscore_events(rows, limit, F.stddev_samp).groupBy("entity").agg(F.count("*").alias("n_events"))
    out = n.join(events, "entity", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return out.select("entity", "n_events", "n_obs", (F.col("n_events") / F.col("n_obs")).alias("anomaly_ratio"))


def by_kind(info: DataFrame, basins: DataFrame, first: bool, limit: int | None = None) -> DataFrame:
    """Entities of the first kind, or of the others up to an id, with the basin that each has a row for."""
    rows = info.where(F.col("kind") == 1 if first else F.col("kind") > 1)
    rows = rows if limit is None else rows.where(F.col("entity") < limit)
    return rows.join(basins.where("basin is not null").select("entity", "basin"), "entity").select("entity", "kind", "basin", "lat", "lon", "area")


def without_anomalous(pairs: DataFrame, anomalous: DataFrame) -> DataFrame:
    """Pairs of which neither side is anomalous."""
    bad = anomalous.select("entity").distinct()
    return pairs.join(bad, "entity", "left_anti").join(bad.withColumnRenamed("entity", "partner"), "partner", "left_anti")


def label_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Months that two labellings share: where both say high, low or normal, and where they differ."""
    both = left.select("entity", "month_ordinal", F.col("extreme_label").alias("a")).join(right.select("entity", "month_ordinal", F.col("extreme_label").alias("b")), ["entity", "month_ordinal"])
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    same = lambda k: (F.col("a") == k) & (F.col("b") == k)
    return both.groupBy("entity").agg(F.count("*").alias("n"), count(same("extreme_high"), "high_agree"), count(same("extreme_low"), "low_agree"), count(same("normal"), "normal_agree"), count(F.col("a") != F.col("b"), "differ"))
