"""The daily-to-monthly and grid aggregations over a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and exact sums of each key and window; state is dropped when the watermark passes it."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), key)
    return rows.agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def to_table(totals: DataFrame, path: str, checkpoint: str):
    """Runs through what is there and appends finished windows to a table, each once."""
    return totals.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=path, format="parquet")
