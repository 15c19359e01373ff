"""The operators that also make sense on streams: sliding features by event time, resampled counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_features(samples: DataFrame, size: str = "2 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(base, window, n, rms, ptp) of a stream of (base, ts, x); rows later than late are dropped by the watermark."""
    w = F.window("ts", size, slide)
    return samples.withWatermark("ts", late).groupBy("base", w.alias("window")).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (F.max("x") - F.min("x")).alias("ptp"))


def marker_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, trial_type, runs): markers per bucket of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("window"), "trial_type").agg(F.count("*").alias("runs"))
