"""Features of signal windows: amplitude, line length, Hjorth, spectra, robust outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import EPS, array_windows, channel_spectra, window_sums
from .groups import group_percentiles, join_groups
from .windows import first_channel, label_windows

#: The frequency bands in Hz.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 80), "high_gamma": (80, 150)}
#: The bands of the window table.
WINDOW_BANDS = {"1_4": (1, 4), "4_8": (4, 8), "8_13": (8, 13), "13_30": (13, 30), "30_80": (30, 80)}


def sample_sums(f: DataFrame) -> DataFrame:
    """arrays.window_sums() of framed samples (base, ch, k, x, d1, d2), for signals that are not held as arrays."""
    var = lambda c: F.coalesce(F.var_pop(c), F.lit(0.0))
    return f.groupBy("base", "ch", "k").agg(
        F.count("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.abs("d1")).alias("steps"), F.count("d1").alias("n_steps"),
        var("x").alias("v0"), var("d1").alias("v1"), var("d2").alias("v2"),
    )


def _pooled(*more) -> list:
    return [F.sqrt(F.sum("s2") / F.nullif(F.sum("n"), F.lit(0))).alias("rms"), (F.max("hi") - F.min("lo")).alias("ptp"), *more]


def pooled_features(sums: DataFrame) -> DataFrame:
    """(base, k, rms, ptp, line_length): over all channels of a window; line length as the mean of steps."""
    return sums.groupBy("base", "k").agg(*_pooled((F.sum("steps") / F.nullif(F.sum("n_steps"), F.lit(0))).alias("line_length")))


def simple_features(sums: DataFrame) -> DataFrame:
    """(base, k, rms, ptp, line_length): rms and ptp pooled, line length summed per channel and averaged."""
    return sums.groupBy("base", "k").agg(*_pooled(F.avg(F.coalesce("steps", F.lit(0.0))).alias("line_length")))


def channel_features(sums: DataFrame) -> DataFrame:
    """(base, ch, k, rms, ptp, line_length, activity, mobility, complexity); line length as the sum of steps."""
    v0, v1, v2 = (F.col(c) + F.lit(EPS) for c in ("v0", "v1", "v2"))
    mob = F.sqrt(v1 / v0)
    return sums.select(
        "base", "ch", "k", F.sqrt(F.col("s2") / F.nullif(F.col("n"), F.lit(0))).alias("rms"), (F.col("hi") - F.col("lo")).alias("ptp"), F.coalesce("steps", F.lit(0.0)).alias("line_length"),
        v0.alias("activity"), mob.alias("mobility"), (F.sqrt(v2 / v1) / (mob + F.lit(EPS))).alias("complexity"),
    )


def mean_over_channels(c: DataFrame) -> DataFrame:
    names = [x for x in c.columns if x not in ("base", "ch", "k")]
    return c.groupBy("base", "k").agg(*(F.avg(x).alias(x) for x in names))


def spectra(arrays: DataFrame, sfreq: float, nperseg: int, values: str = "xs") -> DataFrame:
    """(base, ch, bin, f, p): one-sided power density by Welch's method, half-overlapping Hann segments without their
    mean, from rows (base, ch, values array)."""
    p = channel_spectra(arrays, sfreq, nperseg, {}, values)
    return p.select("base", "ch", F.posexplode(F.arrays_zip("freqs", "p")).alias("bin", "b")).select("base", "ch", "bin", F.col("b.freqs").alias("f"), F.col("b.p").alias("p"))


def band_power(arrays: DataFrame, sfreq: float, nperseg: int, bands: dict[str, tuple[float, float]] = BANDS, values: str = "xs") -> DataFrame:
    """(base, ch, band, power): trapezoid over the frequencies inside each band, both ends in; no row for a band without
    any. Made where the spectrum is made; nothing is moved."""
    p = channel_spectra(arrays, sfreq, nperseg, bands, values)
    names = F.array(*map(F.lit, bands))
    return p.select("base", "ch", F.inline(F.arrays_zip(names.alias("band"), F.col("powers").alias("power")))).toDF("base", "ch", "band", "power").where("power is not null")


def spectral_entropy(arrays: DataFrame, sfreq: float, nperseg: int, values: str = "xs") -> DataFrame:
    """(base, ch, entropy) of the normalised spectrum, in nats; none for a channel without samples."""
    return channel_spectra(arrays, sfreq, nperseg, {}, values).where("entropy is not null").select("base", "ch", "entropy")


def heavy_summary(arrays: DataFrame, sfreq: float, nperseg: int, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """Per run: mean rms, ptp, spectral entropy, Hjorth values and a mean power for each band. Two passes over the arrays,
    of which only a row for each channel is moved."""
    c = channel_features(window_sums(arrays, None, 1))
    a = c.groupBy("base").agg(F.count("*").alias("n_picks"), *(F.avg(x).alias(f"{x}_mean") for x in ("rms", "ptp", "activity", "mobility", "complexity")))
    p = channel_spectra(arrays, sfreq, nperseg, bands).groupBy("base")
    s = p.agg(F.avg("entropy").alias("spectral_entropy_mean"), *(F.avg(F.get("powers", F.lit(i))).alias(f"bp_mean_{n}") for i, n in enumerate(bands)))
    return a.join(s.select("base", "spectral_entropy_mean", *(f"bp_mean_{n}" for n in sorted(bands))), "base", "left")


def window_table(arrays: DataFrame, w: int, step: int, sfreq: float, bands: dict[str, tuple[float, float]] = WINDOW_BANDS) -> DataFrame:
    """(base, k, mean channel features, spectral_entropy, bp_<band>): spectra are those of the first channel's windows."""
    one = array_windows(first_channel(arrays), w, step)
    p = channel_spectra(one, sfreq, min(w, int(2 * sfreq)), bands, keys=("base", "k"))
    spectral = p.select("base", "k", F.col("entropy").alias("spectral_entropy"), *(F.get("powers", F.lit(i)).alias(f"bp_{n}") for i, n in enumerate(bands)))
    return mean_over_channels(channel_features(window_sums(arrays, w, step))).join(spectral, ["base", "k"], "left")


def with_robust_z(df: DataFrame, cols: list[str], keys: list[str] | None = None, split: bool = False) -> DataFrame:
    """df with z_<col> = 0.6745 (x - median) / (MAD + 1e-12) within keys (a run by default); medians are exact. Plain, the
    distinct values of a group are in one task and rows of a null key go; with split no task holds a group, however
    large, and the null key is a group."""
    keys = keys or ["base"]
    if split:
        j = _joined_medians(df, df, keys, {c: f"med_{c}" for c in cols})
        off = j.select(*keys, *(F.abs(F.col(c) - F.col(f"med_{c}")).alias(c) for c in cols))
        j = _joined_medians(j, off, keys, {c: f"mad_{c}" for c in cols})
    else:
        j = df.join(df.groupBy(*keys).agg(*(F.median(c).alias(f"med_{c}") for c in cols)), keys)
        mad = j.groupBy(*keys).agg(*(F.median(F.abs(F.col(c) - F.col(f"med_{c}"))).alias(f"mad_{c}") for c in cols))
        j = j.join(mad, keys)
    return j.select(*df.columns, *((F.lit(0.6745) * (F.col(c) - F.col(f"med_{c}")) / (F.col(f"mad_{c}") + F.lit(EPS))).alias(f"z_{c}") for c in cols))


def _joined_medians(df: DataFrame, of: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    total = "_rows" + "_" * max(map(len, df.columns))
    m = group_percentiles(of, keys, list(names))
    m = m.select(*keys, F.col("rows").alias(total), *(F.get(c, F.lit(0)).alias(n) for c, n in names.items()))
    return join_groups(df, m, keys, total).drop(total)


def outlier_windows(windows: DataFrame, cols=("rms", "ptp", "line_length"), limit: float = 6.0, split: bool = False) -> DataFrame:
    """windows with the largest absolute robust z of the features within the run, and is_outlier from limit on; with
    split a run may be of any size."""
    z = with_robust_z(windows, list(cols), split=split)
    score = F.greatest(*(F.abs(f"z_{c}") for c in cols)) if len(cols) > 1 else F.abs(f"z_{cols[0]}")
    return z.withColumn("outlier_score", score).withColumn("is_outlier", F.coalesce(score >= limit, F.lit(False))).drop(*(f"z_{c}" for c in cols))


def suspicious_channels(channels: DataFrame, limit: float = 5.0) -> DataFrame:
    """Channels (base, ch, rms, ptp) whose robust z of rms or ptp within the run is beyond limit."""
    return with_robust_z(channels, ["rms", "ptp"]).where((F.abs("z_rms") > limit) | (F.abs("z_ptp") > limit))


def labelled_windows(features: DataFrame, w: int, step: int, sfreq: float, intervals: DataFrame, runs: DataFrame, mode: str = "overlap", t0: float = 0.0, rows_per_bin: int | None = None) -> DataFrame:
    """features (base, k, ...) as shipped: with t_start, t_end, t_mid, the label y from intervals, and the columns of
    runs (base and metadata such as subject, acq, run); a run without metadata keeps its windows."""
    s0 = F.col("k") * step
    timed = features.withColumn("t_start", F.lit(t0) + s0 / F.lit(sfreq)).withColumn("t_end", F.lit(t0) + (s0 + w) / F.lit(sfreq)).withColumn("t_mid", F.lit(t0) + (s0 + F.lit((w - 1) / 2)) / F.lit(sfreq))
    return label_windows(timed, intervals, mode, rows_per_bin).join(runs, "base", "left")


def windowing_info(labelled: DataFrame, not_features: tuple[str, ...] = ("base", "k", "t_mid", "y", "subject", "acq", "run")) -> DataFrame:
    """(base, n_windows, n_features, y_pos, y_neg, positive_rate) of labelled windows; times count as features."""
    n = len([c for c in labelled.columns if c not in not_features])
    return labelled.groupBy("base").agg(F.count("*").alias("n_windows"), F.lit(n).alias("n_features"), F.count_if(F.col("y") == 1).alias("y_pos"), F.count_if(F.col("y") == 0).alias("y_neg"), F.avg("y").alias("positive_rate"))


def signal_summary(runs: DataFrame, heavy: DataFrame, bounds: DataFrame, intervals: DataFrame) -> DataFrame:
    """The run-level table: subject, acq, run, sfreq, n_total_channels and duration_s of runs, the segment's bounds,
    whether the run has an interval, and the features of heavy."""
    both = intervals.where("onset_s is not null and offset_s is not null").select("base").distinct().withColumn("has_onset_offset", F.lit(True))
    out = runs.join(bounds.select("base", F.col("t_min").alias("segment_tmin"), F.col("t_max").alias("segment_tmax")), "base", "left").join(both, "base", "left").join(heavy, "base")
    return out.withColumn("has_onset_offset", F.coalesce("has_onset_offset", F.lit(False)))
