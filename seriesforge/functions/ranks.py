"""Places in a global order without a window over all rows: ranges are sorted apart, and the totals before them added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges in which values are sorted.
RANGES = 64


def with_place(rows: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """rows (one a value of the column) with ``upto``: the number, or the weight, of rows up to and with this one.

    Where the ranges' bounds lie doesn't change a place, so approximate quantiles serve.
    """
    amount = F.lit(1) if weight is None else F.col(weight)
    bounds = rows.agg(F.percentile_approx(column, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 1000).alias("_bounds"))
    placed = rows.join(F.broadcast(bounds), F.lit(True)).withColumn("_part", F.size(F.filter("_bounds", lambda b: b < F.col(column)))).drop("_bounds")  # one row
    totals = placed.groupBy("_part").agg(F.sum(amount).alias("_total"))  # RANGES rows
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")
    offsets = totals.select(F.col("_part").alias("_of"), before.alias("_before"))
    here = F.sum(amount).over(Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("_here", here).join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return out.withColumn("upto", F.col("_before") + F.col("_here")).drop("_part", "_of", "_before", "_here")
