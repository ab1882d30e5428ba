"""Windows over event time for tables that arrive as streams. The engines that this library follows have no streams; these are extras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", step: str = "12 hours", late: str = "1 hour", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and means by sliding window and key, for batches and streams alike; a stream drops rows later than `late`."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")
