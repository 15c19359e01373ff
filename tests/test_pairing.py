import random

import pandas as pd
import pytest

from tracewell.operators import markers as mk
from tracewell.streaming import pairing

SCHEMA = "base string, row_idx int, ts timestamp, trial_type string"
START = 1_704_067_200_000_000


def batch(spark, rows):
    df = spark.createDataFrame(rows, "base string, row_idx int, us long, trial_type string")
    return df.selectExpr("base", "row_idx", "timestamp_micros(us) as ts", "trial_type")


def streamed(spark, folder, parts, late):
    for part in parts:
        batch(spark, part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        pairing.append_available(pairing.pair_stream(stream, late=late), f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out").selectExpr("base", "unix_micros(onset_ts) as a", "unix_micros(offset_ts) as b", "duration_s", "onset_trial_type", "offset_trial_type")
    return sorted(map(tuple, out.collect()), key=str)


def paired(spark, rows):
    found = mk.markers(batch(spark, rows).selectExpr("base", "row_idx", "cast(unix_micros(ts) as double) as onset", "trial_type"))
    pairs = mk.pair_intervals(found).selectExpr("base", "cast(onset_s as long) as a", "cast(offset_s as long) as b", "duration_s / 1e6 as duration_s", "onset_trial_type", "offset_trial_type")
    return sorted(map(tuple, pairs.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    """Runs with ties within a millisecond, repeated rows, a hot run, null bases, times and texts."""
    rng = random.Random(4)
    kinds = ["seizure onset", "eeg sz end", "offset", "none", None]
    out = [(rng.choice(["hot", "hot", "b", "c", "", None]), i, START + rng.randrange(0, 600_000_000), rng.choice(kinds)) for i in range(400)]
    out += [("ties", i % 7, START + 1_000_000 + rng.randrange(0, 5) * 300, rng.choice(kinds)) for i in range(40)]
    return out + out[:30] + [("b", 1, None, "eeg sz end"), ("b", None, START + 5, "seizure onset")]


#: A marker so far behind that the watermark passes all others.
END = ("end", 0, START + 10**11, "seizure onset")


def test_shuffled_and_late_rows_pair_as_in_batch(spark, tmp_path, rows):
    shuffled = random.Random(1).sample(rows, len(rows))
    parts = [shuffled[:200], shuffled[200:350], [*shuffled[350:], END]]
    got = streamed(spark, tmp_path, parts, "11 minutes")
    assert got == paired(spark, rows) and len(got) > 50


def test_pairs_come_as_the_watermark_passes(spark, tmp_path, rows):
    """In order of time up to two minutes' disorder: what a part completes is there before the next one comes."""
    order = sorted((r for r in rows if r[2] is not None), key=lambda r: r[2] + random.Random(str(r)).randrange(0, 100_000_000))
    first = streamed(spark, tmp_path, [order[:250]], "2 minutes")
    all_rows = streamed(spark, tmp_path, [[*order[250:], END]], "2 minutes")
    want = paired(spark, rows)
    assert 0 < len(first) < len(want) and set(first) <= set(want)
    assert all_rows == want


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    a = [("r", 0, START, "seizure onset"), ("r", 1, START + 60_000_000, "eeg sz end"), ("x", 2, START + 600_000_000, "seizure onset")]
    b = [("r", 3, START + 30_000_000, "eeg sz end"), ("r", 4, START + 700_000_000, "seizure onset"), ("r", 5, START + 701_000_000, "eeg sz end"), END]
    got = streamed(spark, tmp_path, [a, b], "10 seconds")
    assert [(r[0], r[1] - START, r[2] - START) for r in got] == [("r", 0, 60_000_000), ("r", 700_000_000, 701_000_000)]


def test_settings_are_as_before(spark, tmp_path):
    key = next(iter(pairing.STORE))
    before = spark.conf.get(key)
    assert streamed(spark, tmp_path, [[]], "1 second") == []
    assert spark.conf.get(key) == before


class Calls:
    """A handle whose states and timers count the calls to them."""

    def __init__(self):
        self.n, self.lists, self.maps, self.timers = 0, {}, {}, []

    def _count(self):
        self.n += 1

    def getListState(self, name, schema):
        return self._State(self, self.lists.setdefault(name, []))

    def getMapState(self, name, key, value):
        return self._State(self, self.maps.setdefault(name, {}))

    def listTimers(self):
        self._count()
        return iter(self.timers)

    def registerTimer(self, at):
        self._count()
        self.timers.append(at)

    class _State:
        def __init__(self, calls, rows):
            self.calls, self.rows = calls, rows

        def __getattr__(self, name):
            own = {
                "appendValue": lambda v: self.rows.append(v), "appendList": lambda v: self.rows.extend(v), "clear": lambda: self.rows.clear(),
                "get": lambda: iter(list(self.rows)), "getValue": lambda k: self.rows.get(k), "updateValue": lambda k, v: self.rows.update({k: v}),
            }
            self.calls._count()
            return own[name]


@pytest.mark.parametrize("runs", [1, 90])
def test_calls_to_the_state_do_not_grow_with_markers(runs):
    """Each of them goes to the JVM and back."""
    calls = Calls()
    p = pairing.Pairing()
    p.init(calls)
    n = 900
    pdf = pd.DataFrame({"run": [f"={i % runs}" for i in range(n)], "at": [START + i for i in range(n)], "row_idx": range(n), "is_onset": [i // runs % 2 == 0 for i in range(n)], "trial_type": "x"})
    list(p.handleInputRows((0,), iter([pdf]), None))
    assert calls.n < 10
    assert calls.timers == [pairing._due(START)]

    class Passed:
        def getCurrentWatermarkInMs(self):
            return START // 1000 + 1

    calls.n = 0
    out = pd.concat(p.handleExpiredTimer((0,), Passed(), None))
    assert len(out) == n // 2 and (out["offset_at"] - out["onset_at"] == runs).all()
    assert calls.n < 10


def test_entries_of_a_state_are_bounded():
    calls = Calls()
    state = calls.getListState("waiting", "markers binary")
    rows = pd.DataFrame({"run": ["=a", ""] * 1250, "at": range(2500), "trial_type": "x"})
    pairing._add(state, rows)
    assert len(calls.lists["waiting"]) == 3 and pairing._read(state, ["run", "at", "trial_type"]).equals(rows)
    pairing._keep(state, rows[:0])
    assert len(pairing._read(state, ["run", "at", "trial_type"])) == 0


def test_runs_that_share_a_bucket_pair_apart(spark, tmp_path, rows):
    """All in one bucket, over several parts with onsets left open between them."""
    order = sorted((r for r in rows if r[2] is not None), key=lambda r: r[2] + random.Random(str(r)).randrange(0, 100_000_000))
    for part in (order[:150], order[150:300], [*order[300:], END]):
        batch(spark, part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        pairing.append_available(pairing.pair_stream(stream, late="2 minutes", buckets=1), f"{tmp_path}/out", f"{tmp_path}/state")
    out = spark.read.parquet(f"{tmp_path}/out").selectExpr("base", "unix_micros(onset_ts) as a", "unix_micros(offset_ts) as b", "duration_s", "onset_trial_type", "offset_trial_type")
    assert sorted(map(tuple, out.collect()), key=str) == paired(spark, rows)
