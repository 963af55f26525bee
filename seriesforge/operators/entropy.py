"""Apportionment entropy, trend tests and their regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import plogp, ratio
from ..functions.ranks import with_place


def overall_entropy(rows: DataFrame) -> DataFrame:
    """Entropy of the monthly means above their smallest, over log2 12; a month without values counts as 0."""
    months = rows.groupBy("entity", "month").agg(F.avg("value").alias("m")).groupBy("entity")
    means = months.agg(F.collect_list("m").alias("m"))  # twelve at most
    filled = F.concat("m", F.array_repeat(F.lit(0.0), (F.lit(12) - F.size("m")).cast("int")))
    above = means.select("entity", F.transform(filled, lambda x: x - F.array_min(filled)).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate("s", F.lit(0.0), lambda a, x: a + plogp(x / F.nullif(F.col("total"), F.lit(0.0))))
    return above.withColumn("total", total).where("total > 0").select("entity", (bits / F.log2(F.lit(12.0))).alias("ae"))


def annual_entropy(rows: DataFrame, least_months: int = 10) -> DataFrame:
    """The same for each year with enough months, and its difference from the entity's mean."""
    year = Window.partitionBy("entity", "year")
    s = F.col("value") - F.min("value").over(year)
    shares = rows.withColumns({"s": s, "n": F.count("*").over(year)}).where(F.col("n") >= least_months)
    out = shares.withColumn("p", ratio(F.col("s"), F.sum("s").over(year))).where("p is not null").groupBy("entity", "year").agg((F.sum(plogp(F.col("p"))) / F.log2(F.lit(12.0))).alias("ae"))
    return out.withColumn("ae_anomaly", F.col("ae") - F.avg("ae").over(Window.partitionBy("entity")))


def trend(years: DataFrame, value: str, least_years: int = 20) -> DataFrame:
    """Mann-Kendall S and Z with corrected ties and Sen's slope over positions, for entities with enough years."""
    placed = years.where(F.col(value).isNotNull()).select("entity", F.row_number().over(Window.partitionBy("entity").orderBy("year")).alias("i"), F.col(value).alias("x"))
    n = placed.groupBy("entity").agg(F.count("*").alias("n"), F.avg("x").alias("mean")).where(F.col("n") >= least_years)
    kept = placed.join(n.select("entity"), "entity", "left_semi")
    later = kept.select(F.col("entity").alias("of"), F.col("i").alias("j"), F.col("x").alias("y"))
    # pairs of an entity's own years: as many as years are few
    pairs = kept.join(later, (F.col("entity") == F.col("of")) & (F.col("i") < F.col("j")))
    slopes = pairs.groupBy("entity").agg(F.sum(F.signum(F.col("y") - F.col("x"))).cast("long").alias("s"), F.percentile((F.col("y") - F.col("x")) / (F.col("j") - F.col("i")), F.lit(0.5)).alias("slope"))
    t = F.col("t")
    ties = kept.groupBy("entity", "x").agg(F.count("*").alias("t")).groupBy("entity").agg(F.sum(t * (t - 1) * (2 * t + 5)).alias("ties"))
    v = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("ties")) / 18.0
    z = F.when(F.col("s") == 0, 0.0).otherwise(ratio(F.col("s") - F.signum(F.col("s")), F.sqrt(v)))
    out = n.join(slopes, "entity").join(ties, "entity").withColumn("z", z)
    label = F.when(F.col("z") > 1.959963984540054, "increasing").when(F.col("z") < -1.959963984540054, "decreasing").otherwise("no trend")
    return out.select("entity", "n", "s", "z", "slope", label.alias("trend"), (ratio(F.col("slope"), F.col("mean")) * 1000).alias("change_per_decade_pct"))


def regression(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson and Spearman correlation and the least-squares line of y on x."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def average_rank(c: str, name: str) -> DataFrame:
        """Ranks of distinct values from their counts: only the values, not the rows, are sorted."""
        counts = with_place(known.groupBy(c).agg(F.count("*").alias("n")), c, "n")
        return counts.select(F.col(c).alias(f"of_{c}"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))

    ranked = known.join(average_rank(x, "rank_x"), F.col(x) == F.col(f"of_{x}")).join(average_rank(y, "rank_y"), F.col(y) == F.col(f"of_{y}"))
    return ranked.agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("rank_x", "rank_y").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def without_outliers(rows: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Drops rows whose absolute value lies outside the quartiles by more than factor times their distance; nulls stay."""
    q = rows.agg(F.percentile(F.abs(column), F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    spread = factor * (F.col("q3") - F.col("q1"))
    inside = F.abs(column).between(F.col("q1") - spread, F.col("q3") + spread)
    return rows.join(q, F.lit(True)).where(F.col(column).isNull() | inside).drop("q1", "q3")


def amplitude_ratio(rows: DataFrame) -> DataFrame:
    """Deviation of annual means over the mean, null unless the mean is positive."""
    annual = rows.groupBy("entity", "year").agg(F.avg("value").alias("m")).groupBy("entity").agg(F.stddev_pop("m").alias("sd"))
    mean = rows.groupBy("entity").agg(F.avg("value").alias("mean"))
    return annual.join(mean, "entity").select("entity", F.when(F.col("mean") > 0, F.col("sd") / F.nullif("mean", F.lit(0.0))).alias("amplitude"))
