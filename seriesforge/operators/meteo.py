"""Daily records: checks, monthly aggregation, alignment with monthly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself; an error names the columns that it lacks."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def preprocess(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops rows without a key, and feature columns that are null throughout (found by one aggregate)."""
    kept = require(rows, keys).dropna(subset=list(keys))
    features = [c for c in kept.columns if c not in keys]
    counts = kept.agg(*[F.count(c).alias(c) for c in features]).first().asDict() if features else {}
    return kept.select(*keys, *[c for c in features if counts[c]])


def to_monthly(rows: DataFrame, sums: dict[str, str], means: dict[str, str], day: str = "day") -> DataFrame:
    """Sums and means of the given columns by entity and month; a day that is no date is an error."""
    checked = F.when(F.col(day).isNotNull(), F.to_date(day)).otherwise(F.raise_error(F.lit("a day is missing")).cast("date"))
    aggregates = [F.sum(F.col(c).cast("decimal(18,4)")).cast("double").alias(k) for k, c in sums.items()] + [F.avg(c).alias(k) for k, c in means.items()]
    dated = rows.withColumn("_day", checked)
    return dated.groupBy("entity", F.year("_day").alias("year"), F.month("_day").alias("month")).agg(*aggregates, F.count("*").alias("n"))


def align(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins monthly frames on keys; of repeated keys on the right the least row counts, clashing columns get a suffix.

    A key repeated on the left is an error, as the result would repeat it.
    """
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns and c not in keys}
    others = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]) if others else right.select(*keys).distinct()
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = left.withColumn("_n", F.when(n == 1, n).otherwise(F.raise_error(F.lit("a key is repeated on the left")).cast("long"))).where("_n = 1").drop("_n")
    return checked.join(once.withColumnsRenamed(clash), list(keys), how)
