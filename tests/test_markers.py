import random

import pytest

from tracewell.operators import markers as mk


def _classes(spark, texts, rules=mk.RULES_V2):
    df = spark.createDataFrame([(x,) for x in texts], "trial_type string")
    return {r.trial_type: (r.is_onset, r.is_offset) for r in mk.classify(df, rules).collect()}


def test_classification(spark):
    on = ["sz onset", "Onset", "SZ EVENT # (PB SZ)", "eeg sz start", "Z ELECTROGRAPHIC ONS", "??clinical onset??"]
    off = ["offset", "sz offset", "Z ELECTROGRAPHIC END", "eeg sz end", "offset with attenuat", "onset to offset"]
    none = ["A1+A2 OFF", "+0.000000", "Schedule", "MARK ON", None, ""]
    got = _classes(spark, on + off + none)
    assert all(got[x] == (True, False) for x in on)
    assert all(got[x] == (False, True) for x in off)
    assert all(got[x] == (False, False) for x in none)
    old = _classes(spark, ["eeg sz end", "Z ELECTROGRAPHIC ONS"], mk.RULES_V1)
    assert old == {"eeg sz end": (True, False), "Z ELECTROGRAPHIC ONS": (False, False)}


def _pairs(ons, offs):
    out, j = [], 0
    offs = sorted(offs)
    for t in sorted(ons):
        while j < len(offs) and offs[j] <= t:
            j += 1
        if j == len(offs):
            break
        out.append((t, offs[j]))
        j += 1
    return out


FIXED = [([1, 5], [3, 9]), ([1, 2], [3]), ([4], [2, 4, 6]), ([1, 2, 10], [3, 4, 5]), ([5, 5], [7, 7]), ([5], [7, 7]), ([], [1]), ([3], [])]


def _events(cases):
    rows = []
    for base, (ons, offs) in enumerate(cases):
        both = [(float(t), "onset") for t in ons] + [(float(t), "offset") for t in offs]
        random.Random(base).shuffle(both)
        rows += [(base, i, str(t), kind) for i, (t, kind) in enumerate(both)]
    return rows


def test_pairing_equals_the_loop(spark):
    rng = random.Random(7)
    cases = FIXED + [([rng.randint(0, 12) for _ in range(rng.randint(0, 7))], [rng.randint(0, 12) for _ in range(rng.randint(0, 7))]) for _ in range(400)]
    found = mk.pair_intervals(mk.markers(spark.createDataFrame(_events(cases), "base int, row_idx int, onset string, trial_type string")))
    got = {}
    for r in found.collect():
        got.setdefault(r.base, []).append((r.onset_s, r.offset_s))
        assert r.duration_s == r.offset_s - r.onset_s > 0
    for base, (ons, offs) in enumerate(cases):
        assert sorted(got.get(base, [])) == _pairs(ons, offs), (ons, offs)


def test_quality_flags(spark):
    events = spark.createDataFrame(_events(FIXED), "base int, row_idx int, onset string, trial_type string")
    runs = spark.createDataFrame([(i,) for i in range(len(FIXED) + 1)], "base int")
    qc = {r.base: r for r in mk.marker_qc(runs, events).collect()}
    assert [qc[i].has_orphan_offset for i in range(8)] == [False, False, True, True, False, False, True, False]
    assert [qc[i].has_unpaired_onset for i in range(8)] == [False, True, False, True, False, False, False, True]
    assert [qc[i].n_intervals_paired for i in range(8)] == [2, 1, 1, 2, 2, 1, 0, 0]
    assert qc[8].events_exists is False and qc[8].n_onset_markers is None and qc[8].has_orphan_offset is None


def test_quality_equals_the_loop(spark):
    """Offsets of equal time included: one is no orphan where another of its time ends a pair."""
    rng = random.Random(11)
    cases = FIXED + [([rng.randint(0, 9) for _ in range(rng.randint(0, 6))], [rng.randint(0, 9) for _ in range(rng.randint(0, 6))]) for _ in range(200)]
    cases = [c for c in cases if c[0] or c[1]]
    events = spark.createDataFrame(_events(cases), "base int, row_idx int, onset string, trial_type string")
    got = {r.base: r for r in mk.marker_qc(events.select("base"), events).collect()}
    assert len(got) == len(cases)
    for base, (ons, offs) in enumerate(cases):
        r, pairs = got[base], _pairs(ons, offs)
        ends = {b for _, b in pairs}
        assert (r.n_onset_markers, r.n_offset_markers, r.n_intervals_paired) == (len(ons), len(offs), len(pairs))
        assert (r.min_onset_s, r.max_offset_s) == (min(ons, default=None), max(ends, default=None))
        assert r.has_orphan_offset == any(t not in ends for t in offs), (ons, offs)


@pytest.mark.parametrize(("ons", "offs", "want"), [([5, 8], [3, 6, 9], (5.0, 6.0)), ([5], [3], (5.0, None)), ([], [4], (None, None))])
def test_first_onset_offset(spark, ons, offs, want):
    r = mk.first_onset_offset(mk.markers(spark.createDataFrame(_events([(ons, offs)]), "base int, row_idx int, onset string, trial_type string"))).first()
    assert (r.first_onset, r.first_offset) == want


def test_numbers_that_are_none_drop_their_rows(spark):
    rows = [(0, i, t, "onset") for i, t in enumerate(["1.5", "1d", "n/a", None, "nan", " 2 ", "1e1", "x"])]
    got = mk.markers(spark.createDataFrame(rows, "base int, row_idx int, onset string, trial_type string")).collect()
    assert sorted(r.t for r in got) == [1.5, 2.0, 10.0]


def test_pairs_of_a_hot_run_in_bins(spark):
    """One run with most of the markers, ties of onsets and offsets, runs without either: equal to the plain queue, and to
    the form that sorts a run in one task."""
    rng = random.Random(17)
    rows = []
    for i in range(900):
        base = 0 if rng.random() < 0.6 else rng.randrange(1, 6)
        on = rng.random() < (0.5 if base < 4 else float(base == 4))
        rows.append((base, i, float(rng.randrange(200)) * (1 if base else 7), "x", on, not on))
    found = spark.createDataFrame(rows, "base int, row_idx int, t double, trial_type string, is_onset boolean, is_offset boolean").repartition(3)
    want = []
    for base in range(6):
        mine = sorted((r for r in rows if r[0] == base), key=lambda r: (r[2], r[1]))
        offs = [r[2] for r in mine if r[5]]
        for r in mine:
            if r[4]:
                at = next((k for k, t in enumerate(offs) if t > r[2]), None)
                if at is None:
                    break
                want.append((base, r[2], offs[at]))
                offs = offs[at + 1 :]
    for n in (None, 1, 40, 10_000):
        got = sorted((r.base, r.onset_s, r.offset_s) for r in mk.pair_intervals(found, n).collect())
        assert got == sorted(want) and len(want) > 100, n
