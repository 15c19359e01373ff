import numpy as np

from tracewell.operators import arrays as ar
from tracewell.operators import features as fe
from tracewell.operators import profile as pr
from tracewell.operators import selection as sel
from tracewell.operators import timeline as tl
from tracewell.operators import windows as wi


def _long(spark, x):
    return wi.samples(_arrays(spark, x))


def _arrays(spark, x):
    return spark.createDataFrame([(0, c, [None if v is None else float(v) for v in row]) for c, row in enumerate(x)], "base int, ch int, xs array<double>")


def test_framing_counts_and_labels(spark):
    runs = spark.createDataFrame([(1, 142200), (2, 338175), (3, 100)], "base int, n long")
    iv = spark.createDataFrame([(1, 58.95, 79.875), (2, 66.825, 275.85), (3, None, 2.0)], "base int, onset_s double, offset_s double")
    f = wi.frames(runs, 2000, 1000, 1000.0)
    over = {r.base: (r["n"], r["pos"]) for r in wi.label_windows(f, iv).groupBy("base").agg({"y": "sum", "k": "count"}).toDF("base", "pos", "n").collect()}
    assert over == {1: (141, 23), 2: (337, 211)}
    mid = {r[0]: r[1] for r in wi.label_windows(f, iv, "midpoint", rows_per_bin=30).groupBy("base").agg({"y": "sum"}).collect()}
    assert mid == {1: 21, 2: 209}
    assert wi.frames(runs, 2000, 1000, 1000.0, short=True).where("base = 3").count() == 1


def test_overlap_label_cases(spark):
    w = spark.createDataFrame([(0, k, float(a), float(b), (a + b) / 2) for k, (a, b) in enumerate([(0, 2), (9, 11), (10, 12), (19, 21), (20, 22)])], "base int, k int, t_start double, t_end double, t_mid double")
    iv = spark.createDataFrame([(0, 10.0, 20.0)], "base int, onset_s double, offset_s double")
    assert [r.y for r in wi.label_windows(w, iv).orderBy("k").collect()] == [0, 1, 1, 1, 0]


def test_channel_features_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=(3, 70))
    got = {(r.ch, r.k): r for r in fe.channel_features(ar.window_sums(_arrays(spark, x), 16, 8)).collect()}
    assert len(got) == 3 * 7
    for (c, k), r in got.items():
        w = x[c, k * 8 : k * 8 + 16]
        d1, d2 = np.diff(w), np.diff(w, 2)
        v0, v1, v2 = w.var() + 1e-12, d1.var() + 1e-12, d2.var() + 1e-12
        mob = np.sqrt(v1 / v0)
        want = [np.sqrt((w**2).mean()), np.ptp(w), np.abs(d1).sum(), v0, mob, np.sqrt(v2 / v1) / (mob + 1e-12)]
        assert np.allclose([r.rms, r.ptp, r.line_length, r.activity, r.mobility, r.complexity], want)


def test_step_larger_than_window_leaves_gaps(spark):
    got = wi.framed(_long(spark, [range(10)]), 2, 4).groupBy("k").count().collect()
    assert sorted((r.k, r["count"]) for r in got) == [(0, 2), (1, 2), (2, 2)]


def plain_welch(x, sfreq, n):
    """The rules of Welch's method, one segment after the other."""
    n = min(n, len(x))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    q = []
    for s in range(0, len(x) - n + 1, max(1, n - n // 2)):
        seg = x[s : s + n]
        q.append(np.abs(np.fft.rfft((seg - seg.mean()) * win)) ** 2 / (sfreq * (win**2).sum()))
    p = np.mean(q, axis=0)
    p[1 : -1 if n % 2 == 0 else None] *= 2
    return p


def test_spectrum_power_and_entropy_equal_plain_forms(spark):
    x = np.random.default_rng(2).normal(size=(2, 77))
    arr = _arrays(spark, x)
    bands = {"b": (1, 4), "none": (0.1, 0.2), "point": (2, 2)}
    for r in ar.channel_spectra(arr, 16.0, 32, bands).collect():
        p = plain_welch(x[r.ch], 16.0, 32)
        assert np.allclose(p, r.p) and np.allclose(r.freqs, np.arange(17) * 0.5)
        share = p / p.sum()
        assert np.isclose(r.entropy, -(share * np.log(share)).sum())
        assert np.isclose(r.powers[0], ((p[3:9] + p[2:8]) / 2 * 0.5).sum()) and r.powers[1] is None and r.powers[2] == 0
    assert {(r.ch, r.band) for r in fe.band_power(arr, 16.0, 32, bands).collect()} == {(c, b) for c in (0, 1) for b in ("b", "point")}
    assert fe.spectral_entropy(arr, 16.0, 32).count() == 2


def test_channels_in_chunks_equal_whole_ones(spark):
    """Cut in 7 chunks at uneven places, shorter and longer than a segment, in blocks of several sizes; one short channel."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=500)
    ends = [0, 3, 60, 61, 200, 333, 480, 500]
    rows = [("r", 0, a, x[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)] + [("r", 1, 0, x[:9].tolist()), ("r", 1, 9, x[9:20].tolist()), ("r", 2, 0, [])]
    chunks = spark.createDataFrame(rows, "base string, ch int, i0 long, xs array<double>").repartition(3)
    whole = spark.createDataFrame([("r", 0, x.tolist()), ("r", 1, x[:20].tolist())], "base string, ch int, xs array<double>")
    for n, size in ((32, 1), (31, 64), (50, 100), (32, 1 << 20)):
        got = {r.ch: r for r in ar.chunk_spectra(chunks, 16.0, n, {"b": (1, 4)}, size=size).collect()}
        assert set(got) == {0, 1}
        for c, v in ((0, x), (1, x[:20])):
            assert np.allclose(got[c].p, plain_welch(v, 16.0, n)), (n, size, c)
    for w, step, size in ((16, 8, 24), (20, 7, 1), (10, 25, 100), (500, 1, 50)):
        key = lambda r: (r.ch, r.k)
        a = sorted(ar.chunk_window_sums(chunks, w, step, size=size).collect(), key=key)
        b = sorted(ar.window_sums(whole, w, step).collect(), key=key)
        assert [key(r) for r in a] == [key(r) for r in b] and len(a) >= 1
        assert all(np.allclose(r[3:], q[3:]) for r, q in zip(a, b, strict=True))


def test_window_sums_equal_sample_sums(spark):
    """Windows whose length the step does not divide, unknown samples, arrays that are empty or null."""
    rng = np.random.default_rng(6)
    x = [[None if rng.random() < 0.1 else float(v) + 1e3 for v in rng.normal(size=n)] for n in (90, 41, 5, 0)]
    arr = _arrays(spark, x).unionByName(spark.createDataFrame([(0, 9, None)], "base int, ch int, xs array<double>"))
    for w, step in ((16, 8), (10, 4), (7, 3), (1, 1), (2, 5), (5, 5), (40, 1)):
        key = lambda r: (r.ch, r.k)
        a = sorted(ar.window_sums(arr, w, step).collect(), key=key)
        b = sorted(fe.sample_sums(wi.framed(wi.samples(arr), w, step)).collect(), key=key)
        assert [key(r) for r in a] == [key(r) for r in b]
        for r, q in zip(a, b, strict=True):
            for m, n in zip(r[3:], q[3:], strict=True):
                assert (m is None) == (n is None) and (m is None or np.isclose(m, n, rtol=1e-7)), (w, step, r, q)
    plan = fe.channel_features(ar.window_sums(arr, 16, 8))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_excerpt_starts_at_the_onset(spark):
    long = wi.samples(spark.createDataFrame([(b, 0, [float(i) for i in range(100)]) for b in range(6)], "base int, ch int, xs array<double>"))
    onsets = spark.createDataFrame([(0, None), (1, 9.5), (2, 3.0), (3, -2.0), (4, 50.0)], "base int, onset_s double")
    got = {b: sorted(r.x for r in wi.excerpt(long, 10.0, 1.0, onsets).where(f"base = {b}").collect()) for b in range(6)}
    first = [float(i) for i in range(11)]
    assert got == {0: first, 1: [95.0, 96.0, 97.0, 98.0, 99.0], 2: [float(i) for i in range(30, 41)], 3: first, 4: [], 5: first}
    assert sorted(r.x for r in wi.excerpt(long, 10.0, 1.0).where("base = 0").collect()) == [float(i) for i in range(45, 55)]


def test_duplicates_of_null_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (None, 2, "c"), (None, None, "d"), (2, 2, "e"), (None, None, "f")], "x int, y int, _times string")
    got = {r[2]: r.is_duplicate for r in pr.duplicate_rows(df, ["x", "y"]).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": True}


def test_robust_z(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4, 100)] + [(1, 5.0)] * 3, "base int, x double")
    z = fe.with_robust_z(df, ["x"])
    assert abs(z.where("base = 0").agg({"z_x": "max"}).first()[0] - 0.6745 * 97) < 1e-6
    assert {r.z_x for r in z.where("base = 1").collect()} == {0.0}


def test_spikes(spark):
    s = spark.sql("select date'2024-01-01' + i as bucket, if(i = 13, 1, 0) as runs from (select explode(sequence(0, 13)) as i)")
    got = {r.bucket.day: (r.z, r.is_spike) for r in tl.spikes(s).collect()}
    assert abs(got[14][0] - 13 / np.sqrt(14)) < 1e-9 and got[14][1]
    assert got[3] == (None, False) and got[10] == (None, False)


def test_partial_autocorrelation_solves_yule_walker(spark):
    rng = np.random.default_rng(3)
    x = np.zeros(600)
    for i in range(2, 600):
        x[i] = 0.6 * x[i - 1] - 0.3 * x[i - 2] + rng.normal()
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, bucket int, runs double")
    acf = tl.autocorrelation(s, 6, ("k",))
    d = x - x.mean()
    r = np.array([(d[: 600 - k] * d[k:]).sum() for k in range(7)]) / (d * d).sum()
    assert np.allclose([row.acf for row in acf.orderBy("lag").collect()], r)
    got = [row.pacf for row in tl.partial_autocorrelation(acf, "k").orderBy("lag").collect()]
    for k in range(1, 7):
        toeplitz = r[np.abs(np.subtract.outer(range(k), range(k)))]
        assert np.isclose(got[k], np.linalg.solve(toeplitz, r[1 : k + 1])[-1])


def test_percentiles_are_exact(spark):
    """With brackets from the sketch, and where a column is its own bracket; ties, a constant, nulls."""
    rng = np.random.default_rng(5)
    shares = (0.0, 0.25, 0.5, 0.99, 1.0)
    cols = {"far": rng.lognormal(0, 3, 5000), "ties": rng.integers(0, 4, 5000).astype(float), "same": np.full(5000, 2.5)}
    rows = [(*(float(v) for v in r), None, float(i) if i < 2 else None) for i, r in enumerate(zip(*cols.values(), strict=True))]
    df = spark.createDataFrame(rows, "far double, ties double, same double, none double, two double").repartition(7)
    cols["two"] = np.array([0.0, 1.0])
    for accuracy in (1000, 10_000):
        got = {r["column"]: r["values"] for r in pr.summary_with_percentiles(df, df.columns, shares, accuracy).collect()}
        assert got.pop("none") is None and got.keys() == cols.keys()
        for c, x in cols.items():
            assert np.allclose(got[c], np.quantile(x, shares), rtol=1e-12), (c, accuracy)
    empty = tl.gap_profile(spark.createDataFrame([], "gap_h double")).collect()
    assert len(empty) == 1 and empty[0]["n"] == 0 and empty[0]["p50"] is None and empty[0]["mean_clipped"] is None


def test_autocorrelation_of_unknown_counts_and_short_series(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), ("b", 0, 2.0), ("b", 1, 2.0)], "k string, bucket int, runs double")
    got = {(r.k, r.lag): r.acf for r in tl.autocorrelation(s, 5, ("k",)).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 0.0, ("a", 2): -0.5, ("b", 0): None, ("b", 1): None}


def test_diverse_selection_caps_subjects(spark):
    df = spark.createDataFrame([(i, i % 3, float(-i)) for i in range(12)], "base int, subject int, score double")
    got = [r.base for r in sel.select_diverse(df, 5).collect()]
    assert got == [0, 1, 2, 3, 4]
    assert len({(r.base) for r in sel.tiered_fill(df, [df.base < 2, df.base < 4, df.base >= 0], full=3, least=6).collect()}) == 6


def test_diverse_selection_ties_by_the_score_shown(spark, tmp_path):
    """Runs of equal scores whose sums differ in the last bits: 4 lines of which 2 are bad, and 5 of which 3 are."""
    from tracewell.plans import catalog

    lines = [(o, i + 1, 0, "R" if i < bad else "N", "F") for o, n, bad in ((1, 4, 2), (2, 5, 3), (3, 6, 4), (4, 7, 5), (5, 4, 2), (6, 5, 3)) for i in range(n)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o, "1-URGENT", 1.0) for o in range(1, 7)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    raw = {r.score for r in catalog._scored(spark, str(tmp_path)).collect()}
    got = catalog.queries()["select_diverse"](spark, str(tmp_path)).collect()
    assert len(raw) > 1 and [(r.base, r.score) for r in got] == [(o, 30.04) for o in range(1, 7)]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "base int, ch int, xs array<double>")
    assert wi.framed(wi.samples(e), 4, 2).count() == 0
    assert ar.window_sums(e, 4, 2).count() == 0 and fe.spectra(e, 16.0, 32).count() == 0 and fe.heavy_summary(e, 16.0, 32).count() == 0
    s = spark.createDataFrame([], "ts timestamp_ntz")
    assert tl.resample(s, "day").count() == 0 and tl.by_hour(s).count() == 24


def test_pacf_query_spans_a_week(spark):
    from pyspark.sql import functions as F

    from tracewell.plans import catalog

    from .conftest import SMALL

    got = catalog.queries()["pacf"](spark, SMALL).groupBy("event_type").agg(F.max("lag").alias("last"), F.count("*").alias("n")).collect()
    assert got and all(r["last"] == 168 and r["n"] == 169 for r in got)


def test_short_channels_have_a_spectrum(spark):
    """A channel of fewer samples than a segment is one segment of all it has."""
    rng = np.random.default_rng(2)
    rows = [("r", 0, rng.normal(size=64).tolist()), ("r", 1, rng.normal(size=16).tolist()), ("r", 2, [])]
    got = fe.spectra(spark.createDataFrame(rows, "base string, ch int, xs array<double>"), 16.0, 32).toPandas()
    assert got.groupby("ch").size().to_dict() == {0: 17, 1: 9}
    x = np.array(rows[1][2])
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    q = np.abs(np.fft.rfft((x - x.mean()) * win)) ** 2 / (16 * (win**2).sum())
    q[1:-1] *= 2
    assert np.allclose(got[got.ch == 1].sort_values("bin").p, q)


def test_run_level_summary_has_all_columns(spark):
    rng = np.random.default_rng(3)
    arrays = spark.createDataFrame([("a", c, rng.normal(size=400).tolist()) for c in range(2)] + [("b", 0, rng.normal(size=400).tolist())], "base string, ch int, xs array<double>")
    runs = spark.createDataFrame([("a", "s1", "ecog", "01", 400.0, 5, 1.0), ("b", "s2", "seeg", "02", 400.0, 3, 1.0)], "base string, subject string, acq string, run string, sfreq double, n_total_channels int, duration_s double")
    pairs = spark.createDataFrame([("a", 0.2, 0.6), ("b", 0.1, None)], "base string, onset_s double, offset_s double")
    heavy = fe.heavy_summary(arrays, 400.0, 200, fe.BANDS)
    got = {r.base: r for r in fe.signal_summary(runs, heavy, wi.crop_bounds(runs, pairs), pairs).collect()}
    assert len(got["a"]) == 10 + 3 + 6 + 3 + 1 and (got["a"].has_onset_offset, got["b"].has_onset_offset) == (True, False)
    assert got["a"].n_picks == 2 and got["a"].segment_tmin == 0.0 and got["a"].segment_tmax == 1.0
    assert all(getattr(got["a"], f"bp_mean_{b}") > 0 for b in fe.BANDS)
    x = [np.array(r.xs) for r in arrays.where("base = 'a'").collect()]
    assert np.isclose(got["a"].rms_mean, np.mean([np.sqrt(np.mean(v * v)) for v in x]))


def test_labels_equal_all_pairs(spark):
    """Overlapping, nested, touching, empty and inverted intervals, null bounds and bases, a run with most of the rows."""
    rng = np.random.default_rng(7)
    base = lambda: [0, 0, 0, 1, None][rng.integers(5)]
    at = lambda: None if rng.random() < 0.05 else float(rng.integers(0, 400)) / 4
    iv = [(base(), at(), at()) for _ in range(25)] + [(0, 10.0, 10.0), (0, 20.0, 30.0), (0, 30.0, 40.0)]
    ws = [(base(), k, a, a + 2.0, a + 1.0) for k, a in enumerate(float(rng.integers(0, 440)) / 4 for _ in range(400))] + [(0, 900, None, None, None)]
    w = spark.createDataFrame(ws, "base int, k int, t_start double, t_end double, t_mid double").repartition(3)
    i = spark.createDataFrame(iv, "base int, onset_s double, offset_s double").repartition(3)
    known = [x for x in iv if None not in x]
    for mode in ("overlap", "midpoint"):
        hit = lambda r, x: r[0] == x[0] and r[2] is not None and ((x[1] < r[3] and x[2] > r[2]) if mode == "overlap" else x[1] <= r[4] <= x[2])  # noqa: B023, E731
        want = {r[1]: int(any(hit(r, x) for x in known)) for r in ws}
        for rows in (None, 1, 7, 10_000):
            got = wi.label_windows(w, i, mode, rows)
            assert got.columns == [*w.columns, "y"] and {r.k: r.y for r in got.collect()} == want, (mode, rows)


def test_series_in_blocks_equal_whole_ones(spark):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(k, datetime(2024, 3, 1) + timedelta(hours=h), int(rng.integers(0, 9))) for k, n in (("a", 300), ("b", 40), ("c", 1)) for h in range(n)]
    s = spark.createDataFrame(rows, "k string, bucket timestamp_ntz, runs long").repartition(3)
    for of in (lambda n: tl.rolling_stats(s, 7, ("k",), n), lambda n: tl.spikes(s, 14, 7, 2.0, ("k",), n), lambda n: tl.seasonal(s, 24, ("k",), n), lambda n: tl.rolling_stats(s.where("k = 'a'"), 7, (), n), lambda n: tl.seasonal(s.where("k = 'a'"), 7, (), n), lambda n: tl.linear_trend(s, ("k",), 10, n)):
        whole = of(None)
        key = [c for c in ("k", "bucket") if c in whole.columns]
        want = whole.orderBy(*key).toPandas()
        for n in (1, 9, 64, 10_000):
            got = of(n).select(*whole.columns).orderBy(*key).toPandas()
            assert len(got) == len(want)
            for c in whole.columns:
                same = np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True) if got[c].dtype.kind == "f" else (got[c] == want[c]).all()
                assert same, (n, c)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = tl.rolling_stats(s.where("k = 'a'"), 7, (), 20).select(F.spark_partition_id()).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
