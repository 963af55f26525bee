"""Quality metrics, filters as bits of a mask, and comparison with reference areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import agreement_class, flag_is_set, ratio

ZERO_QUANTILE, FLAT, AREA_RATIO, OUTSIDE_RANGE, LOW_VOLATILITY, SHIFT = 1, 2, 4, 8, 16, 32


def levels(rows: DataFrame, q: float = 0.8) -> DataFrame:
    """Median, mean, quantile, least and largest value of each entity."""
    v = "value"
    return rows.groupBy("entity").agg(F.count(v).alias("n_obs"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.percentile(v, F.lit(q)).alias("q"), F.min(v).alias("least"), F.max(v).alias("largest"))


def value_counts(rows: DataFrame, digits: int | None = None) -> DataFrame:
    value = F.col("value") if digits is None else F.round("value", digits)
    return rows.where(F.col("value").isNotNull()).groupBy("entity", value.alias("value")).agg(F.count("*").alias("n"))


def value_stats(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Of each entity's distribution of values: numbers, the commonest value's count and the Shannon entropy.

    With counts n of total T the entropy is log2 T - sum(n log2 n) / T: one aggregate, no join with the total.
    """
    n = F.col("n")
    out = value_counts(rows, digits).groupBy("entity").agg(F.sum("n").alias("total"), F.count("*").alias("n_unique"), F.max("n").alias("most"), F.sum(n * F.log2(n)).alias("weighted"))
    return out.select("entity", "total", "n_unique", "most", (F.log2("total") - F.col("weighted") / F.col("total")).alias("entropy"))


def flatness(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Observations, distinct values, and the shares of the commonest and of distinct values."""
    return value_stats(rows, digits).select("entity", F.col("total").alias("n_obs"), "n_unique", (F.col("most") / F.col("total")).alias("dominant_ratio"), (F.col("n_unique") / F.col("total")).alias("unique_ratio"))


def _cv() -> Column:
    """Sample coefficient of variation, for two observations or more with a positive mean."""
    return F.when((F.col("n_obs") >= 2) & (F.col("mean") > 0), F.col("sd") / F.nullif("mean", F.lit(0.0)))


def volatility(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Shannon entropy of the distribution of values times the sample coefficient of variation."""
    spread = rows.groupBy("entity").agg(F.count("value").alias("n_obs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    out = spread.join(value_stats(rows, digits), "entity", "left").withColumn("cv", _cv())
    return out.select("entity", "n_obs", "cv", F.when(F.col("cv").isNotNull(), F.col("entropy")).alias("entropy"), (F.col("entropy") * F.col("cv")).alias("h_cv"))


def penalised_changes(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """Relative changes between successive months that aren't frozen; their deviation counts less the more months repeat the one before."""
    from .series import in_time, without_frozen

    moving = without_frozen(rows, frozen)
    before = F.lag("value").over(in_time())
    steps = moving.withColumn("before", before).withColumn("place", F.row_number().over(in_time())).where("place > 1")
    change = (F.col("value") - F.col("before")) / F.nullif("before", F.lit(0.0))
    moves = steps.groupBy("entity").agg(F.coalesce(F.stddev_samp(change), F.lit(0.0)).alias("std_change"), F.sum(F.coalesce(F.col("value") == F.col("before"), F.lit(False)).cast("long")).alias("n_zero_delta"), F.count("*").alias("n_transitions"))
    per_value = moving.groupBy("entity", "value").agg(F.count("*").alias("n"))
    values = per_value.groupBy("entity").agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_distinct"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.max("n") / F.sum("n")).alias("dominant_ratio"))
    held = rows.join(frozen, ["entity", "month_ordinal"], "left_semi").groupBy("entity").agg(F.count("*").alias("n_frozen"))
    out = values.join(moves, "entity").join(held, "entity", "left")
    penalised = F.when(F.col("n_zero_delta") > 0, F.col("std_change") / F.sqrt(F.col("n_zero_delta").cast("double"))).otherwise(F.col("std_change"))
    return out.select("entity", "n_obs", "n_distinct", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).alias("cv"), "dominant_ratio", "std_change", "n_zero_delta", "n_transitions", penalised.alias("penalised_volatility"), F.coalesce("n_frozen", F.lit(0)).alias("n_frozen"))


def classify(rows: DataFrame, info: DataFrame, shifted: DataFrame | None = None, frozen: DataFrame | None = None) -> DataFrame:
    """Every entity's flags: a bit for each filter that it fails, with what the filters looked at.

    Median, mean and quantile are of all months; shares, range and volatility are of those that aren't frozen.
    """
    from .series import without_frozen

    v = "value"
    base = rows.groupBy("entity").agg(F.median(v).alias("median"), F.avg(v).alias("mean_area"), F.percentile(v, F.lit(0.8)).alias("q"))
    moving = rows if frozen is None else without_frozen(rows, frozen)
    spread = moving.groupBy("entity").agg(F.count(v).alias("n_obs"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("largest"), F.stddev_samp(v).alias("sd"))
    shares = value_stats(moving).select("entity", (F.col("most") / F.col("total")).alias("dominant_ratio"), "entropy")
    metrics = base.join(spread, "entity", "left").join(shares, "entity", "left").withColumn("h_cv", F.col("entropy") * _cv())
    known = metrics.join(info.select("entity", F.col("area").alias("atlas")), "entity", "left")
    known = known.withColumn("degraded", F.lit(False)) if shifted is None else known.join(shifted.select("entity", (F.col("shift_label") == "degraded").alias("degraded")), "entity", "left")
    area_ratio = F.when(F.col("atlas") > 0, F.col("median") / F.nullif("atlas", F.lit(0.0)))
    bits = {
        ZERO_QUANTILE: F.col("q") == 0,
        FLAT: F.col("dominant_ratio") >= 0.8,
        AREA_RATIO: area_ratio.isNull() | (area_ratio < 0.1) | (area_ratio > 10),
        OUTSIDE_RANGE: (F.col("atlas") > 0) & ((F.col("atlas") < 0.5 * F.col("least")) | (F.col("atlas") > 1.5 * F.col("largest"))),
        LOW_VOLATILITY: F.col("h_cv") <= 0.001,
        SHIFT: F.col("degraded"),
    }
    mask: Column = sum((F.when(F.coalesce(test, F.lit(False)), F.lit(bit)).otherwise(F.lit(0)) for bit, test in bits.items()), F.lit(0))
    return known.select("entity", "mean_area", F.col("median").alias("median_area"), F.coalesce("atlas", F.lit(0.0)).alias("atlas_area"), mask.cast("int").alias("flags"))


def route(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities of good quality, anomalous ones)."""
    return classified.where("flags = 0").drop("flags"), classified.where("flags > 0")


def recompute_bit(status: DataFrame, fresh: DataFrame, bit: int) -> DataFrame:
    """status (entity, flags) with a filter's bit as fresh (entity, hit) has it, and where each entity moves, if anywhere.

    Entities that fresh lacks stay as they are; flags 0 mean good quality.
    """
    joined = status.join(fresh.select("entity", F.col("hit").alias("_hit")), "entity", "left")
    flags = F.when(F.col("_hit"), F.col("flags").bitwiseOR(F.lit(bit))).when(~F.col("_hit"), F.col("flags").bitwiseAND(F.lit(~bit))).otherwise(F.col("flags")).cast("int")
    way = F.when((F.col("flags") == 0) & (F.col("_new") > 0), "to anomalies").when((F.col("flags") > 0) & (F.col("_new") == 0), "to quality").when(F.col("flags") != F.col("_new"), "flags").otherwise("unchanged")
    return joined.withColumn("_new", flags).withColumn("route", way).select("entity", F.col("_new").alias("flags"), "route")


def sync_shift(status: DataFrame, labels: DataFrame) -> DataFrame:
    """status (entity, flags) brought in line with shift labels, and where each entity moves.

    Degraded entities get the shift flag; others lose it only where it is their only flag.
    """
    joined = status.join(labels.select("entity", F.col("shift_label").alias("_label")), "entity", "left")
    degraded = F.col("_label") == "degraded"
    flags = F.when(degraded, F.col("flags").bitwiseOR(F.lit(SHIFT))).when(F.col("_label").isin("stable", "intermittent") & (F.col("flags") == SHIFT), F.lit(0)).otherwise(F.col("flags")).cast("int")
    way = F.when(flags == F.col("flags"), "unchanged").when(F.col("flags") == 0, "to anomalies").when(flags == 0, "to quality").otherwise("flags")
    return joined.select("entity", flags.alias("flags"), way.alias("route"))


def outside_extremes(rows: DataFrame, info: DataFrame, scale: float = 1.0) -> DataFrame:
    """Whether each entity's reference area lies outside the least and largest value; never for an area of 0 or less."""
    ends = rows.groupBy("entity").agg((F.min("value") / scale).alias("least"), (F.max("value") / scale).alias("largest"))
    area = F.col("area")
    outside = F.when(area <= 0, F.lit(False)).otherwise((area < F.col("least")) | (area > F.col("largest")))
    return info.select("entity", "area").join(ends, "entity").select("entity", "least", "largest", outside.alias("is_outside"))


def month_variance_ratio(rows: DataFrame) -> DataFrame:
    """Largest over smallest deviation of the calendar months' logarithms, those above 0; 1 where fewer than two are."""
    logs = rows.where("value > 0").groupBy("entity", "month").agg(F.stddev_pop(F.log("value")).alias("sd"))
    spread = F.when(F.col("sd") > 1e-9, F.col("sd"))
    ends = logs.groupBy("entity").agg(F.count(spread).alias("n"), F.max(spread).alias("high"), F.min(spread).alias("low"))
    return ends.select("entity", F.when(F.col("n") > 1, F.col("high") / F.col("low")).otherwise(F.lit(1.0)).alias("variance_ratio"))


def flag_sets(classified: DataFrame) -> DataFrame:
    """How many entities have each combination of flags."""
    return classified.groupBy("flags").agg(F.count("*").alias("n"), *[F.max(flag_is_set(F.col("flags"), b).cast("int")).alias(f"bit_{b}") for b in (1, 2, 4, 8, 16, 32)])


def compare_areas(classified: DataFrame) -> DataFrame:
    """Ratio, relative difference, log2 ratio and agreement of measured and reference area."""
    r = F.when(F.col("atlas_area") > 0, F.col("median_area") / F.nullif("atlas_area", F.lit(0.0)))
    out = classified.withColumn("area_ratio", r)
    return out.select("entity", "median_area", "atlas_area", "area_ratio", (F.col("area_ratio") - 1).alias("relative_difference"), F.when(F.col("area_ratio") > 0, F.log2("area_ratio")).alias("log2_ratio"), agreement_class(F.col("area_ratio")).alias("agreement"))


def comparison_summary(compared: DataFrame, good: float = 2.0) -> DataFrame:
    """One row: percentiles of the ratio, mean and population deviation of its logarithm, and who over- or underestimates."""
    r = F.col("area_ratio")
    q = compared.agg(F.count("*").alias("n"), F.percentile(r, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"), F.avg("log2_ratio").alias("mean_log2"), F.stddev_pop("log2_ratio").alias("std_log2"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in (("over", r > good), ("under", r < 1 / good), ("within", r.between(1 / good, good)))])
    return q.select("n", *[F.col("q")[k].alias(f"p{p:02d}") for k, p in enumerate((5, 25, 50, 75, 95))], (F.col("q")[3] - F.col("q")[1]).alias("iqr"), "mean_log2", "std_log2", "over", "under", "within")


def agreement_counts(compared: DataFrame) -> DataFrame:
    """Counts of all three classes, 0 for those without entities."""
    spine = compared.sparkSession.createDataFrame([("good",), ("moderate",), ("poor",)], "agreement string")
    return spine.join(compared.groupBy("agreement").agg(F.count("*").alias("n")), "agreement", "left").select("agreement", F.coalesce("n", F.lit(0)).alias("n"))


def ratio_bins(compared: DataFrame) -> DataFrame:
    """Counts of max(r, 1/r) in [1, 2), [2, 5), [5, 10) and from 10 on."""
    r = F.greatest("area_ratio", ratio(F.lit(1.0), F.col("area_ratio")))
    name = F.when(r < 2, "1-2").when(r < 5, "2-5").when(r < 10, "5-10").otherwise("10+")
    return compared.where("area_ratio > 0").groupBy(name.alias("bin")).agg(F.count("*").alias("n"))


def legacy_volatility(rows: DataFrame) -> DataFrame:
    """Sample deviation of relative changes over the root of the number of months without change."""
    from .series import in_time

    before = F.lag("value").over(in_time())
    change = rows.withColumns({"change": ratio(F.col("value") - before, before), "same": (F.col("value") == before).cast("int")})
    out = change.groupBy("entity").agg(F.stddev_samp("change").alias("sd"), F.sum("same").alias("zeros"))
    return out.select("entity", (F.col("sd") / F.sqrt(F.greatest(F.col("zeros"), F.lit(1)))).alias("penalised"))


def recheck_zero_quantile(rows: DataFrame, flags: DataFrame, q: float = 0.8) -> DataFrame:
    """Entities flagged for a zero quantile whose quantile isn't zero any more."""
    zero = rows.groupBy("entity").agg(F.percentile("value", F.lit(q)).alias("q")).where("q > 0")
    return flags.where(flag_is_set(F.col("flags"), ZERO_QUANTILE)).join(zero, "entity", "left_semi").select("entity", F.col("flags").bitwiseAND(F.lit(~ZERO_QUANTILE)).alias("flags"))
