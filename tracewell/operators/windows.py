"""Sliding windows over samples, crop bounds and interval labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import binned, carried


def crop_bounds(runs: DataFrame, intervals: DataFrame, pre: float = 120.0, post: float = 120.0, otherwise: float = 300.0) -> DataFrame:
    """(base, t_min, t_max): from pre before a run's first onset to post after its last offset, inside the run; the
    run's first seconds where it has no valid interval. runs: base, duration_s."""
    good = intervals.where("onset_s is not null and offset_s is not null and offset_s > onset_s")
    ends = good.groupBy("base").agg(F.min("onset_s").alias("on"), F.max("offset_s").alias("off"))
    j = runs.select("base", "duration_s").join(ends, "base", "left")
    lo = F.when(F.col("on").isNotNull(), F.greatest(F.lit(0.0), F.col("on") - pre)).otherwise(F.lit(0.0))
    hi = F.when(F.col("off").isNotNull(), F.least(F.col("off") + post, F.col("duration_s"))).otherwise(F.least(F.col("duration_s"), F.lit(otherwise)))
    return j.select("base", lo.alias("t_min"), hi.alias("t_max"))


def frames(runs: DataFrame, w: int, step: int, sfreq: float, t0: float = 0.0, short: bool = False) -> DataFrame:
    """(base, k, s0, t_start, t_end, t_mid): every whole window of a run (base, n samples); short keeps one cut window
    for a run of fewer than w samples."""
    last = F.floor((F.col("n") - w) / step).cast("long")
    count = F.when(F.col("n") >= w, last) if not short else F.when(F.col("n") >= w, last).when(F.col("n") > 0, F.lit(0).cast("long"))
    out = runs.select("base", "n", F.explode(F.when(count.isNotNull(), F.sequence(F.lit(0).cast("long"), count))).alias("k"))
    s0 = F.col("k") * step
    end = F.least(s0 + w, F.col("n"))
    return out.select("base", "k", s0.alias("s0"), (F.lit(t0) + s0 / F.lit(sfreq)).alias("t_start"), (F.lit(t0) + end / F.lit(sfreq)).alias("t_end"), (F.lit(t0) + (s0 + F.lit((w - 1) / 2)) / F.lit(sfreq)).alias("t_mid"))


def label_windows(windows: DataFrame, intervals: DataFrame, mode: str = "overlap", rows_per_bin: int | None = None) -> DataFrame:
    """windows with y = 1 where some interval of the run overlaps (or, mode midpoint, holds) the window, else 0.

    Some interval that begins before the window's end ends after its start exactly if the latest end of those does. So
    windows and intervals are put in one order, by window end (or middle) and onset, and a running maximum of the ends
    decides: linear in both, whatever overlaps, and nothing is joined. Bounds that are null give 0. With rows_per_bin
    the order is cut in bins of time, and the maximum carried between them, so that no task holds a run.
    """
    overlap = mode == "overlap"
    lo, hi = ("t_start", "t_end") if overlap else ("t_mid", "t_mid")
    names = windows.columns
    w = windows.select("base", F.col(hi).cast("double").alias("_at"), F.lit(0 if overlap else 1).alias("_order"), F.lit(None).cast("double").alias("_end"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    iv = intervals.where("base is not null and onset_s is not null and offset_s is not null")
    iv = iv.select("base", F.col("onset_s").cast("double").alias("_at"), F.lit(1 if overlap else 0).alias("_order"), F.col("offset_s").cast("double").alias("_end"), F.lit(None).cast(w.schema["_row"].dataType).alias("_row"))
    rows = w.unionByName(iv)
    keys = ["base"]
    latest = F.max("_end")
    if rows_per_bin:
        rows = carried(binned(rows, "_at", rows_per_bin), keys, {"_latest": latest}, {"_carried": F.max("_latest")})
        keys = ["base", "bin"]
    order = W.partitionBy(*keys).orderBy(F.asc_nulls_first("_at"), "_order").rowsBetween(W.unboundedPreceding, 0)
    end = latest.over(order)
    end = F.greatest(end, F.col("_carried")) if rows_per_bin else end
    out = rows.withColumn("_end", end).where("_row is not null").select("_row", "_end")
    hit = F.col("_end") > F.col(f"_row.{lo}") if overlap else F.col("_end") >= F.col(f"_row.{lo}")
    return out.select(*(F.col(f"_row.`{c}`") for c in names), F.when(hit & F.col(f"_row.{hi}").isNotNull(), 1).otherwise(0).alias("y"))


def samples(arrays: DataFrame, values: str = "xs") -> DataFrame:
    """(base, ch, i, x) of rows (base, ch, values array): the long form of a signal."""
    return arrays.select("base", "ch", F.posexplode(values).alias("i", "x")).withColumn("i", F.col("i").cast("long")).withColumn("x", F.col("x").cast("double"))


def framed(long: DataFrame, w: int, step: int) -> DataFrame:
    """long samples with the window k they belong to, once per window, and their first and second differences d1 and
    d2 inside the window (null where they would reach over its start)."""
    order = W.partitionBy("base", "ch").orderBy("i")
    n = F.max("i").over(W.partitionBy("base", "ch")) + 1
    s = long.withColumn("n", n).withColumn("d1", F.col("x") - F.lag("x").over(order))
    s = s.withColumn("d2", F.col("d1") - F.lag("d1").over(order))
    lo = F.greatest(F.ceil((F.col("i") - w + 1) / step), F.lit(0))
    hi = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - w) / step))
    s = s.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi")))
    inside = F.col("i") - F.col("k") * step
    return s.select("base", "ch", "k", "i", "x", F.when(inside >= 1, F.col("d1")).alias("d1"), F.when(inside >= 2, F.col("d2")).alias("d2"))


def first_channel(rows: DataFrame) -> DataFrame:
    """The rows (samples or arrays) of each run's first channel, found by an aggregate, so that no task holds a run."""
    return rows.join(rows.groupBy("base").agg(F.min("ch").alias("ch")), ["base", "ch"], "left_semi")


def first_channels(channels: DataFrame, n: int = 16) -> DataFrame:
    """The first n channels in file order, whatever their status."""
    return channels.where(F.col("ch_idx") < n)


def crop_samples(long: DataFrame, bounds: DataFrame, sfreq: float) -> DataFrame:
    """Samples between t_min and t_max of their run, counted anew from 0; bounds: base, t_min, t_max."""
    first = F.ceil(F.col("t_min") * sfreq)
    j = long.join(bounds.select("base", "t_min", "t_max"), "base").where((F.col("i") >= first) & (F.col("i") <= F.col("t_max") * sfreq))
    return j.select("base", "ch", (F.col("i") - first).alias("i"), "x")


def excerpt(long: DataFrame, sfreq: float, seconds: float = 10.0, onsets: DataFrame | None = None) -> DataFrame:
    """So many seconds of each run, counted anew from 0: from its middle; or, where onsets (base, onset_s) is given, from
    its onset on, both ends in, from the run's start where it has none (or one below 0). What lies beyond the end of the
    run is cut off; an onset beyond it leaves nothing."""
    size = int(seconds * sfreq)
    if onsets is None:
        ends = long.groupBy("base").agg((F.max("i") + 1).alias("n"))
        first = ends.select("base", F.greatest(F.floor((F.col("n") - size) / 2), F.lit(0)).alias("begin"), F.lit(size - 1).alias("more"))
    else:
        at = F.when(F.col("onset_s").isNotNull() & ~F.isnan("onset_s"), F.greatest(F.col("onset_s"), F.lit(0.0))).otherwise(F.lit(0.0))
        first = onsets.groupBy("base").agg(F.min("onset_s").alias("onset_s")).select("base", F.ceil(at * sfreq).alias("begin"), (F.floor((at + seconds) * sfreq) - F.ceil(at * sfreq)).alias("more"))
        rest = F.coalesce("begin", F.lit(0)), F.coalesce("more", F.lit(size))
        j = long.join(first, "base", "left").select("base", "ch", "i", "x", rest[0].alias("begin"), rest[1].alias("more"))
        return j.where("i >= begin and i <= begin + more").select("base", "ch", (F.col("i") - F.col("begin")).alias("i"), "x")
    j = long.join(first, "base").where("i >= begin and i <= begin + more")
    return j.select("base", "ch", (F.col("i") - F.col("begin")).alias("i"), "x")
