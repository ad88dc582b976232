"""Running cell depths from a stream of soundings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_means(soundings: DataFrame, dlon: float, dlat: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, j, i, n, wet_fraction, depth per event-time window and cell.

    soundings has ts, lon, lat and depth (null on land). Rows later than ``late`` are dropped by the watermark; rows
    without ts, lon or lat belong to no cell. The partial sums are combined before the shuffle, so a cell that gets
    most of the soundings sends one row per task.
    """
    cell = soundings.where("ts IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL").withWatermark("ts", late)
    cell = cell.withColumns({"j": F.floor(F.col("lat") / dlat).cast("int"), "i": F.floor(F.col("lon") / dlon).cast("int")})
    means = cell.groupBy(F.window("ts", window).alias("w"), "j", "i").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("depth").isNotNull().cast("double")).alias("wet_fraction"), F.avg("depth").alias("depth")
    )
    return means.select(F.col("w.start").alias("window_start"), "j", "i", "n", "wet_fraction", "depth")
