"""Sums of sliding windows and power spectra of channels that are arrays of samples: made inside the array, no sample moves.

A channel is one row (base, ch, values array), or many chunks (base, ch, i0, values array) that blocks() lays out again in
rows of bounded size, each with the samples that its last window or segment needs from the block after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
#: Windows are handled in groups of about so many partial sums.
GROUP = 1 << 20
_SUMS = "k long, n long, s2 double, lo double, hi double, steps double, n_steps long, v0 double, v1 double, v2 double"


def _partial(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Count, sum, sum of squared deviations, sum of squares, least and greatest of each row; NaN does not count."""
    known = ~np.isnan(rows)
    x = np.where(known, rows, 0.0)
    n, s = known.sum(axis=-1), x.sum(axis=-1)
    mean = s / np.maximum(n, 1)
    return n, s, np.where(known, rows - mean[..., None], 0.0).__pow__(2).sum(axis=-1), (x * x).sum(axis=-1), np.where(known, rows, np.inf).min(axis=-1), np.where(known, rows, -np.inf).max(axis=-1)


def _framed(v: np.ndarray, starts: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, ...]:
    """(n, variance, sum of squares, least, greatest, sum) of v[s : s + length] for each start, a multiple of grain: grains
    are summed once and windows put together from them, the odd end of a window apart. Variances are joined by their
    means, so nothing cancels."""
    whole, rest = divmod(length, grain)
    out = []
    grains = _partial(v[: len(v) // grain * grain].reshape(-1, grain)) if whole else None
    size = max(1, GROUP // max(1, whole + rest))
    for a in range(0, len(starts), size):
        s = starts[a : a + size]
        parts = []
        if whole:
            parts.append([np.lib.stride_tricks.sliding_window_view(g, whole)[s // grain] for g in grains])
        if rest:
            parts.append([p[:, None] for p in _partial(v[(s + whole * grain)[:, None] + np.arange(rest)])])
        n, total, m2, s2, lo, hi = (np.concatenate(x, axis=1) for x in zip(*parts, strict=True))
        count, mean = n.sum(axis=1), total.sum(axis=1) / np.maximum(n.sum(axis=1), 1)
        spread = m2.sum(axis=1) + (n * (total / np.maximum(n, 1) - mean[:, None]) ** 2).sum(axis=1)
        out.append((count, spread / np.maximum(count, 1), s2.sum(axis=1), lo.min(axis=1), hi.max(axis=1), total.sum(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _channel_sums(x: np.ndarray, w: int, step: int) -> list[np.ndarray]:
    """The sums of all windows of channels of one length (rows of x), channel by channel. Rows are filled up with unknown
    samples to whole grains; no window reaches them."""
    m, n = x.shape
    first = np.arange(0, n - w + 1, step) if w else np.zeros(0, int)
    if not len(first):
        return [np.zeros(0)] * 10
    grain = int(np.gcd(w, step)) if len(first) > 1 else w
    wide = n + -n % grain
    flat = lambda y: np.pad(y, ((0, 0), (0, wide - y.shape[1])), constant_values=np.nan).ravel()
    starts = (np.arange(m)[:, None] * wide + first).ravel()
    d1 = np.diff(x, axis=1)
    none = np.zeros(len(starts))
    k, v0, s2, lo, hi, _ = _framed(flat(x), starts, w, grain)
    n1, v1 = _framed(flat(d1), starts, w - 1, grain)[:2] if w > 1 else (none, none)
    steps = _framed(flat(np.abs(d1)), starts, w - 1, grain)[5] if w > 1 else none
    v2 = _framed(flat(np.diff(d1, axis=1)), starts, w - 2, grain)[1] if w > 2 else none
    gone = np.where(k > 0, 0.0, np.nan)
    return [np.tile(np.arange(len(first)), m), k, s2 + gone, lo + gone, hi + gone, np.where(n1 > 0, steps, np.nan), n1, v0, v1, v2]


def _each(column: pa.Array) -> Iterator[np.ndarray]:
    """The arrays of a list column as doubles, unknown values as NaN, a null as an empty one."""
    column = column.cast(pa.large_list(pa.float64()))
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return iter(np.split(flat, ends[:-1])) if len(column) else iter(())


def window_sums(arrays: DataFrame, w: int | None, step: int, values: str = "xs", first: str | None = None) -> DataFrame:
    """(base, ch, k, n, s2, lo, hi, steps, n_steps, v0, v1, v2) of every whole window of w samples (None: one window over the
    whole array): known samples, their sum of squares, extremes, the sum and number of absolute differences, and the
    variances of samples, first and second differences (0 where there are none). first names a column with the number of
    the row's first window. Linear in the samples where step divides w; unknown samples (null or NaN) do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [*_each(batch.column(values))]
            lengths, made, of = np.array([len(x) for x in xs], int), [], []
            for n in np.unique(lengths).tolist():
                alike, most = np.flatnonzero(lengths == n), max(1, GROUP // max(n, 1))
                for a in range(0, len(alike), most):
                    some = alike[a : a + most]
                    made.append(_channel_sums(np.stack([xs[i] for i in some]), n if w is None else w, step))
                    of.append(np.repeat(some, len(made[-1][0]) // len(some)))
            if not made:
                continue
            of = np.concatenate(of)
            columns = [np.concatenate(c) for c in zip(*made, strict=True)]
            if first:
                columns[0] = columns[0] + batch.column(first).to_numpy(zero_copy_only=False)[of]
            kinds = [f.split()[1] for f in _SUMS.split(", ")]
            data = [pa.array(c.astype(np.int64)) if kind == "long" else pa.array(c, from_pandas=True) for c, kind in zip(columns, kinds, strict=True)]
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("base").take(of), batch.column("ch").take(of), *data], names=["base", "ch", *(f.split()[0] for f in _SUMS.split(", "))])

    types = dict(arrays.dtypes)
    return arrays.select("base", "ch", values, *([first] if first else [])).mapInArrow(run, f"base {types['base']}, ch {types['ch']}, {_SUMS}")


def array_windows(arrays: DataFrame, w: int, step: int, values: str = "xs") -> DataFrame:
    """(base, ch, k, values): every whole window of a channel as an array of its own; rows are not moved."""
    last = F.floor((F.size(values) - w) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * step + 1, w))
    return arrays.where(F.size(values) >= w).select("base", "ch", F.posexplode(cut).alias("k", values)).withColumn("k", F.col("k").cast("long"))


def blocks(chunks: DataFrame, size: int, halo: int, values: str = "xs") -> DataFrame:
    """(base, ch, block, values) of chunks (base, ch, i0, values) cut anywhere: samples block * size up to (block + 1) * size
    and halo samples more, as far as the channel has them; unknown where no chunk holds a sample. A task gets blocks, not
    channels, so that one channel may be as long as it likes; a sample is moved once, those of a halo twice."""
    end = F.col("i0") + F.size(values)
    b = chunks.where(F.size(values) > 0).withColumn("block", F.explode(F.sequence(F.greatest(F.floor((F.col("i0") - halo) / size), F.lit(0)), F.floor((end - 1) / size))))
    lo = F.greatest(F.col("i0"), F.col("block") * size)
    hi = F.least(end, (F.col("block") + 1) * size + halo)
    piece = F.slice(values, (lo - F.col("i0") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = b.where(lo < hi).select("base", "ch", "block", F.struct((lo - F.col("block") * size).alias("at"), piece.alias("part")).alias("piece"))
    rows = pieces.groupBy("base", "ch", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("pieces"):
                x = np.full(max(p["at"] + len(p["part"]) for p in row.as_py()), np.nan)
                for p in row.as_py():
                    x[p["at"] : p["at"] + len(p["part"])] = p["part"]
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("base"), batch.column("ch"), batch.column("block"), pa.array(out, pa.list_(pa.float64()), from_pandas=True)], names=["base", "ch", "block", values])

    types = dict(chunks.dtypes)
    return rows.mapInArrow(run, f"base {types['base']}, ch {types['ch']}, block long, {values} array<double>")


def chunk_window_sums(chunks: DataFrame, w: int, step: int, values: str = "xs", size: int = 1 << 20) -> DataFrame:
    """window_sums() of channels in chunks."""
    size = max(1, size // step) * step
    rows = blocks(chunks, size, max(w - step, 0), values)
    return window_sums(rows.withColumn("first", F.col("block") * (size // step)), w, step, values, "first")


def _segments(x: np.ndarray, n: int, sfreq: float) -> np.ndarray:
    """Power density of each half-overlapping Hann segment of n samples, without its mean."""
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segs = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(1, n - n // 2)]
    q = np.abs(np.fft.rfft((segs - segs.mean(axis=1, keepdims=True)) * win, axis=1)) ** 2 / (sfreq * (win**2).sum())
    q[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return q


def entropy_of(p: np.ndarray) -> float:
    s = p / (p.sum() + EPS)
    return float(-(s * np.log(s + EPS)).sum())


def powers_of(freqs: np.ndarray, p: np.ndarray, bands: dict[str, tuple[float, float]]) -> list[float | None]:
    """Trapezoid over the frequencies inside each band, both ends in; None without any."""
    out = []
    for lo, hi in bands.values():
        i = np.flatnonzero((freqs >= lo) & (freqs <= hi))
        out.append(float(((p[i][1:] + p[i][:-1]) / 2 * np.diff(freqs[i])).sum()) if len(i) else None)
    return out


_SPECTRUM = "freqs array<double>, p array<double>, entropy double, powers array<double>"


def _spectrum(p: np.ndarray | None, n: int, sfreq: float, bands: dict[str, tuple[float, float]]) -> tuple:
    if p is None:
        return [], [], None, [None] * len(bands)
    freqs = np.fft.rfftfreq(n, 1 / sfreq)
    return freqs.tolist(), p.tolist(), entropy_of(p), powers_of(freqs, p, bands)


def _spectrum_batch(keys: list[pa.Array], names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    lists = pa.list_(pa.float64())
    freqs, p, entropy, powers = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([*keys, pa.array(freqs, lists), pa.array(p, lists), pa.array(entropy, pa.float64()), pa.array(powers, lists)], names=[*names, "freqs", "p", "entropy", "powers"])


def channel_spectra(arrays: DataFrame, sfreq: float, nperseg: int, bands: dict[str, tuple[float, float]], values: str = "xs", keys: tuple[str, ...] = ("base", "ch")) -> DataFrame:
    """(keys, freqs, p, entropy, powers): one-sided power density by Welch's method of each array, the entropy of its shares
    in nats, and the power in each band (null without a frequency in it). Fewer than nperseg samples are one segment of
    all there is; none have an empty spectrum. Rows are not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in _each(batch.column(values)):
                n = min(nperseg, len(x))
                rows.append(_spectrum(_segments(x, n, sfreq).mean(axis=0) if n else None, n, sfreq, bands))
            yield _spectrum_batch([batch.column(k) for k in keys], [*keys], rows)

    types = dict(arrays.dtypes)
    return arrays.select(*keys, values).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + f", {_SPECTRUM}")


def chunk_spectra(chunks: DataFrame, sfreq: float, nperseg: int, bands: dict[str, tuple[float, float]], values: str = "xs", size: int = 1 << 20) -> DataFrame:
    """channel_spectra() of channels in chunks: every block adds up the segments that start in it, and sums of a channel's
    blocks are merged bin by bin. Segments with unknown samples are left out."""
    hop = max(1, nperseg - nperseg // 2)
    size = max(-(-nperseg // hop), size // hop) * hop
    rows = blocks(chunks, size, nperseg - hop, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, count, used = [], [], []
            for block, x in zip(batch.column("block").to_pylist(), _each(batch.column(values)), strict=True):
                # Only a first block may hold a channel that is shorter than a segment.
                n = nperseg if len(x) >= nperseg else len(x) if block == 0 else 0
                q = _segments(x, n, sfreq) if n else np.zeros((0, 0))
                q = q[~np.isnan(q).any(axis=1)]
                p.append(q.sum(axis=0).tolist() if len(q) else [])
                count.append(len(q))
                used.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("base"), batch.column("ch"), pa.array(used, pa.int64()), pa.array(count, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["base", "ch", "used", "segments", "p"])

    types = dict(chunks.dtypes)
    keys = f"base {types['base']}, ch {types['ch']}"
    sums = rows.mapInArrow(run, f"{keys}, used long, segments long, p array<double>").where("segments > 0")
    by_bin = sums.select("base", "ch", "used", "segments", F.posexplode("p").alias("bin", "q")).groupBy("base", "ch", "used", "bin").agg(F.sum("q").alias("q"), F.sum("segments").alias("segments"))
    whole = by_bin.groupBy("base", "ch", "used").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", (F.col("q") / F.col("segments")).alias("q")))), lambda r: r["q"]).alias("p"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_spectrum(x, n, sfreq, bands) for n, x in zip(batch.column("used").to_pylist(), _each(batch.column("p")), strict=True)]
            yield _spectrum_batch([batch.column("base"), batch.column("ch")], ["base", "ch"], out)

    return whole.mapInArrow(finish, f"{keys}, {_SPECTRUM}")
