"""Irregular timestamps: dense counts, rolling statistics, spikes, trend, seasonality, autocorrelation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .profile import summary_with_percentiles
from .scan import in_blocks, numbered


def resample(scans: DataFrame, unit: str = "day", ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bucket, runs): counts per hour or day, 0 where nothing happened, from each key's first to last bucket."""
    n = scans.where(F.col(ts).isNotNull()).groupBy(*keys, F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("runs"))
    span = n.groupBy(*keys).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    spine = span.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return spine.join(n, [*keys, "bucket"], "left").withColumn("runs", F.coalesce("runs", F.lit(0)).cast("long"))


def _frame(keys: tuple[str, ...], back: int):
    return W.partitionBy(*(keys or (F.lit(0),))).orderBy("bucket").rowsBetween(-back, 0)


def _rolled(series: DataFrame, rows: int, keys: tuple[str, ...], per_block: int | None, of) -> DataFrame:
    """series with the columns that of(window) gives over the last rows values. With per_block a series lies in blocks of
    so many rows, each with the rows before it that its frames reach back to: as many tasks as blocks, equal results."""
    if not per_block:
        return series.withColumns(of(_frame(keys, rows - 1)))
    b = in_blocks(numbered(series, [*keys], "bucket", per_block), rows - 1, size=per_block)
    return b.withColumns(of(W.partitionBy(*keys, "block").orderBy("i").rowsBetween(1 - rows, 0))).where("not halo").drop("i", "block", "halo")


def rolling_stats(series: DataFrame, rows: int = 7, keys: tuple[str, ...] = (), per_block: int | None = None) -> DataFrame:
    """series with the mean and sample deviation of the last rows values; one value has no deviation."""
    return _rolled(series, rows, keys, per_block, lambda w: {"roll_mean": F.avg("runs").over(w), "roll_std": F.stddev_samp("runs").over(w)})


def spikes(series: DataFrame, rows: int = 14, least: int = 7, limit: float = 3.0, keys: tuple[str, ...] = (), per_block: int | None = None) -> DataFrame:
    """series with z against the last rows values (least of them at least, deviation above 0, else null) and is_spike."""
    z = lambda w: F.when(F.count("runs").over(w) >= least, (F.col("runs") - F.avg("runs").over(w)) / F.nullif(F.stddev_samp("runs").over(w), F.lit(0.0)))
    s = _rolled(series, rows, keys, per_block, lambda w: {"z": z(w)})
    return s.withColumn("is_spike", F.coalesce(F.abs("z") > limit, F.lit(False)))


def linear_trend(series: DataFrame, keys: tuple[str, ...] = (), least: int = 10, per_block: int | None = None) -> DataFrame:
    """(keys, n, slope, intercept) of runs on their place in time; null under least points. With per_block places are
    counted in blocks of about so many rows."""
    if per_block:
        s = numbered(series, [*keys], "bucket", per_block)
    else:
        s = series.withColumn("i", F.row_number().over(W.partitionBy(*(keys or (F.lit(0),))).orderBy("bucket")) - 1)
    s = s.withColumn("i", F.col("i").cast("double"))
    y = F.col("runs").cast("double")
    few = F.count("*") >= least
    return s.groupBy(*keys).agg(F.count("*").alias("n"), F.when(few, F.regr_slope(y, F.col("i"))).alias("slope"), F.when(few, F.regr_intercept(y, F.col("i"))).alias("intercept"))


def monthly(series: DataFrame) -> DataFrame:
    m = F.date_trunc("month", F.col("bucket")).cast("timestamp_ntz")
    return series.groupBy(m.alias("month")).agg(F.avg("runs").alias("mean_runs"), F.median("runs").alias("median_runs"), F.sum("runs").alias("sum_runs"))


def gaps(scans: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """(key, gap_h): hours between a key's consecutive timestamps."""
    d = F.timestamp_diff("MICROSECOND", F.lag(ts).over(W.partitionBy(key).orderBy(ts)), F.col(ts))
    return scans.where(F.col(ts).isNotNull()).select(key, (d / F.lit(3_600_000_000.0)).alias("gap_h")).where("gap_h is not null")


def gap_profile(g: DataFrame, col: str = "gap_h") -> DataFrame:
    """Count, mean, deviation, extremes, exact quartiles and high percentiles of the gaps, and the mean clipped at p99."""
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    s = summary_with_percentiles(g, [col], tuple(names.values()))
    row = s.select(F.col("count").alias("n"), "mean", "std", "min", "max", *(F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)))
    clipped = g.join(F.broadcast(row.select("p99")), how="cross").agg(F.avg(F.least(F.col(col), F.col("p99"))).alias("mean_clipped"))
    return row.join(F.broadcast(clipped), how="cross")


def by_hour(scans: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, hour, runs) with all 24 hours."""
    n = scans.groupBy(*keys, F.hour(ts).alias("hour")).agg(F.count("*").alias("runs"))
    return _dense(scans, n, "hour", 24, keys)


def by_weekday(scans: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, weekday, runs) with all days, Monday is 0."""
    n = scans.groupBy(*keys, F.weekday(ts).alias("weekday")).agg(F.count("*").alias("runs"))
    return _dense(scans, n, "weekday", 7, keys)


def _dense(scans: DataFrame, n: DataFrame, name: str, size: int, keys: tuple[str, ...]) -> DataFrame:
    of = scans.select(*keys).distinct() if keys else scans.sparkSession.range(1).select()
    spine = of.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name))
    return spine.join(n, [*keys, name], "left").withColumn("runs", F.coalesce("runs", F.lit(0)).cast("long"))


def by_year(scans: DataFrame, ts: str = "ts") -> DataFrame:
    return scans.where(F.col(ts).isNotNull()).groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("runs"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def hour_box(hourly: DataFrame) -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 IQR) of the dense hourly counts, per hour of the day."""
    h = hourly.withColumn("hour", F.hour("bucket"))
    q = h.groupBy("hour").agg(F.percentile("runs", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("hour", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return h.join(q, "hour").groupBy("hour", "q1", "median", "q3").agg(F.min(F.when(F.col("runs") >= F.col("q1") - reach, F.col("runs"))).alias("low"), F.max(F.when(F.col("runs") <= F.col("q3") + reach, F.col("runs"))).alias("high"))


def autocorrelation(series: DataFrame, lags: int = 168, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lag, acf) of each series, with the whole length as denominator; lag 0 is 1, lags beyond a series' end are
    left out. One sort of the dense buckets of a series, which one task takes whole (they are as many as its span has
    hours or days, not as many as it has rows): each point meets the array of those before it, and products are summed
    where they arise, so no product is shuffled. A constant series has no autocorrelation: null."""
    by = keys or ("series",)
    s = series if keys else series.withColumn("series", F.lit(0))
    of = W.partitionBy(*by)
    # An unknown count adds nothing, but keeps its place.
    s = s.select(*by, "bucket", F.coalesce(F.col("runs") - F.avg("runs").over(of), F.lit(0.0)).alias("d"))
    s = s.select(*by, "d", F.reverse(F.collect_list("d").over(of.orderBy("bucket").rowsBetween(-lags, 0))).alias("before"))
    c = s.select(*by, "d", F.posexplode("before").alias("lag", "x")).groupBy(*by, "lag").agg(F.sum(F.col("d") * F.col("x")).alias("c"))
    c = c.withColumn("c0", F.max(F.when(F.col("lag") == 0, F.col("c"))).over(of))
    return c.select(*keys, "lag", F.try_divide("c", F.nullif("c0", F.lit(0.0))).alias("acf"))


def partial_autocorrelation(acf: DataFrame, key: str) -> DataFrame:
    """(key, lag, pacf) by the Levinson-Durbin recursion on each series' few autocorrelations (Yule-Walker)."""

    def levinson(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(float)
        out, phi, err = [1.0], np.zeros(0), 1.0
        for k in range(1, len(r)):
            a = (r[k] - phi @ r[1:k][::-1]) / err if err > 1e-15 else np.nan
            phi = np.append(phi - a * phi[::-1], a)
            err *= 1 - a * a
            out.append(a)
        return pd.DataFrame({key: pdf[key], "lag": pdf["lag"], "pacf": out[: len(pdf)]})

    return acf.groupBy(key).applyInPandas(levinson, f"{key} {dict(acf.dtypes)[key]}, lag int, pacf double")


def seasonal(series: DataFrame, period: int = 24, keys: tuple[str, ...] = (), per_block: int | None = None) -> DataFrame:
    """series with trend, season and residual: a centred moving mean over one period (half weights at the ends of an
    even one), the mean of what is left per phase, made to sum to 0, and the rest. Trend is null near the ends. With
    per_block a series lies in blocks of so many rows and half a period to either side."""
    by = keys or (F.lit(0),)
    half = period // 2
    if per_block:
        s = in_blocks(numbered(series, [*keys], "bucket", per_block), half, half, per_block)
        w = W.partitionBy(*keys, "block").orderBy("i")
    else:
        w = W.partitionBy(*by).orderBy("bucket")
        s = series.withColumn("i", F.row_number().over(w) - 1)
    wide = w.rowsBetween(-half, half)
    total = F.sum("runs").over(wide)
    ends = (F.lag("runs", half).over(w) + F.lead("runs", half).over(w)) / 2
    mean = (total - ends) / period if period % 2 == 0 else total / period
    s = s.withColumn("trend", F.when(F.count("runs").over(wide) == 2 * half + 1, mean)).withColumn("phase", F.pmod(F.col("i"), F.lit(period)))
    s = s.where("not halo").drop("block", "halo") if per_block else s
    # As many means as a period has phases; they come back by phase.
    raw = s.groupBy(*keys, "phase").agg(F.avg(F.col("runs") - F.col("trend")).alias("raw"))
    phases = raw.withColumn("raw", F.col("raw") - F.avg("raw").over(W.partitionBy(*by)))
    s = s.join(phases, [*keys, "phase"]) if keys else s.join(F.broadcast(phases), "phase")
    return s.withColumn("season", F.col("raw")).withColumn("resid", F.col("runs") - F.col("trend") - F.col("season")).drop("raw", "i")


def sparsity(series: DataFrame, keys: tuple[str, ...] = (), burst: int = 2) -> DataFrame:
    """Share of buckets with any run, and the number of buckets with burst runs or more."""
    return series.groupBy(*keys).agg(F.count("*").alias("buckets"), F.avg((F.col("runs") > 0).cast("double")).alias("active_share"), F.count_if(F.col("runs") >= burst).alias("bursts"))
