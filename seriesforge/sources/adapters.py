"""The engine's tables as views of the star schema: monthly series, attributes, frozen months and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(rows: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """entity, year, month, month_ordinal, value: exact monthly sums of a money column."""
    year, month = F.year(time), F.month(time)
    summed = rows.groupBy(F.col(entity).cast("long").alias("entity"), year.alias("year"), month.alias("month")).agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("value"))
    rows = summed.select("entity", "year", "month", (F.col("year") * 12 + F.col("month") - 1).alias("month_ordinal"), "value")
    # dealt by entity once, after the sums: every window, group and join by entity after it finds its rows together
    return rows.repartition("entity")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice")


def gappy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, area, lat, lon, kind and the eleven-digit hierarchical code."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    e = F.col("s_suppkey")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        e.alias("entity"), F.col("s_acctbal").alias("area"),
        ((e * 37 % 1800).cast("double") / 10 - 90).alias("lat"), ((e * 73 % 3600).cast("double") / 10 - 180).alias("lon"),
        (F.col("s_nationkey") % 3 + 1).alias("kind"),
        (F.lit(10_000_000_000) * (F.col("n_regionkey") + 1) + F.lit(100_000_000).cast("long") * F.col("n_nationkey") + e).alias("code"),
    )


def frozen(series_: DataFrame) -> DataFrame:
    return series_.where((F.col("entity") + F.col("month_ordinal")) % 17 < 2).select("entity", "month_ordinal")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), "value", "event_type")


def status(info_: DataFrame) -> DataFrame:
    broken = F.col("entity") % 7 == 0
    return info_.select("entity", F.when(broken, "error").otherwise("done").alias("status"), F.when(broken, F.concat(F.lit("failed for "), F.col("entity").cast("string"))).alias("error_message"))


def flags(info_: DataFrame) -> DataFrame:
    """A table of entities with bitmask flags, for the ledger operators."""
    return info_.select("entity", (F.col("entity") % 8).cast("int").alias("flags"))


def tail_fits(series_: DataFrame) -> DataFrame:
    """Deterministic stand-ins for fitted tails: two tails and two quantiles for each entity."""
    base = series_.groupBy("entity").agg(F.count("*").alias("n_observations"), F.max("value").alias("top"), F.min("value").alias("low"))
    tails = F.explode(F.array(F.struct(F.lit("high").alias("tail"), F.lit(0).alias("k")), F.struct(F.lit("low").alias("tail"), F.lit(1).alias("k")))).alias("t")
    quantiles = F.explode(F.array(F.lit("0.9500"), F.lit("0.9800"))).alias("q")
    rows = base.select("*", tails).select("*", quantiles)
    e, k = F.col("entity"), F.col("t.k")
    return rows.select(
        "entity", F.col("t.tail").alias("tail"), F.col("q").cast("decimal(5,4)").alias("threshold_quantile"),
        ((e + k) % 5 != 0).alias("converged"), ((e + k) % 9 + 1).alias("n_extremes"), "n_observations",
        ((e % 11).cast("double") / 20 - 0.25).alias("xi"), ((e % 13 + 1).cast("double") * 2).alias("sigma"),
        F.when(k == 0, F.col("top")).otherwise(F.col("low")).alias("threshold"),
    )
