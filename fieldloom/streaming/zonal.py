"""Zonal means of a stream of pixel rows (ts, row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def zonal_means(pixels: DataFrame, mask: DataFrame, every: str = "1 day", late: str = "3 days") -> DataFrame:
    """(adm, start, n, mean) of each region and window of event time, emitted once the watermark has passed the window.

    The mask is a static table; state holds one sum and count for each open (region, window), never pixels.
    """
    joined = pixels.where(F.col("value").isNotNull() & ~F.isnan("value")).withWatermark("ts", late).join(mask, ["row", "col"])
    means = joined.groupBy("adm", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return means.select("adm", F.col("w.start").alias("start"), "n", "mean")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a Parquet folder; takes what is there and stops, to be run again as files arrive."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
