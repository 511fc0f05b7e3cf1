"""An extension: curves per event-time window over a stream, as stateful partial sums with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_curves(stream: DataFrame, time: str, value: str, key: str, thresholds: tuple[float, ...], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n, cdf) of a streaming or batch table; rows later than the watermark are dropped by the engine."""
    df = stream.withWatermark(time, late) if stream.isStreaming else stream
    sums = [F.count_if(F.col(value) <= t).alias(f"_{i}") for i, t in enumerate(thresholds)]
    out = df.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), *sums)
    return out.select(F.col("w.start").alias("window_start"), key, "n", F.array(*(100.0 * F.col(f"_{i}") / F.col("n") for i in range(len(thresholds)))).alias("cdf"))
