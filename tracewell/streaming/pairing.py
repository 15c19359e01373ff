"""Markers of a stream paired as they come, late and out of order, into the intervals that the batch pairing finds."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from ..operators.markers import RULES_V2, MarkerRules, classify

#: State of this kind needs the store that keeps single entries.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def pair_stream(events: DataFrame, rules: MarkerRules = RULES_V2, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """(base, onset_ts, offset_ts, duration_s, onset_trial_type, offset_trial_type) of a stream of (base, row_idx, ts,
    trial_type), appended once the watermark has passed the offset: each onset of a run in order takes the first offset
    that is strictly later and not yet taken, as pair_intervals() has it, row_idx deciding ties.

    The watermark is the latest marker's time less late. Markers at or behind it are dropped, all others may come in any
    order: they wait in the state until the watermark has passed them, a timer wakes it, and then they go through their
    run's queue of open onsets. Runs are dealt over buckets by a hash, and those of a bucket share a state and a timer: the
    markers of the last late and the onsets that no offset has taken yet, read whole by one task. A checkpoint holds to its
    buckets. Null times and texts are no markers; rows with a null base are one run. A base is a number or text. Times
    without a zone are taken in the session's. Needs STORE in the settings; append_available() sees to that.
    """
    base, kind = (dict(events.dtypes)[c] for c in ("base", "ts"))
    rows = classify(events.select("base", "row_idx", F.col("ts").cast("timestamp").alias("ts"), "trial_type").withWatermark("ts", late), rules)
    # A text is never null, and the same type in Python whatever the base is.
    run = F.coalesce(F.concat(F.lit("="), F.col("base").cast("string")), F.lit("")).alias("run")
    rows = rows.where("(is_onset or is_offset) and ts is not null").select(run, "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("row_idx").cast("long"), F.lit(-(2**63))).alias("row_idx"), "is_onset", "trial_type")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)))
    out = "run string, onset_at long, offset_at long, onset_trial_type string, offset_trial_type string"
    pairs = rows.groupBy("bucket").transformWithStateInPandas(Pairing(), out, "Append", "EventTime")
    time = lambda c: F.timestamp_micros(c).cast(kind)
    own = F.when(F.col("run") != "", F.substr("run", F.lit(2))).cast(base).alias("base")
    return pairs.select(own, time("onset_at").alias("onset_ts"), time("offset_at").alias("offset_ts"), ((F.col("offset_at") - F.col("onset_at")) / 1e6).alias("duration_s"), "onset_trial_type", "offset_trial_type")


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what a stream has now to the Parquet files in path, and stop. A later call with the same checkpoint goes on
    where this one ended, and so does one after a failure."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _due(at: int) -> int:
    """The first millisecond by which a watermark has passed the microsecond at."""
    return -(-at // 1000)


#: Rows of one entry of a state; Spark sends some hundreds of entries at once.
ENTRY = 1000


def _add(state: ListState, rows: pd.DataFrame) -> None:
    """Rows as entries of bounded size, each an Arrow stream."""
    for i in range(0, len(rows), ENTRY):
        table = pa.Table.from_pandas(rows.iloc[i : i + ENTRY], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        state.appendValue((sink.getvalue().to_pybytes(),))


def _read(state: ListState, columns: list[str]) -> pd.DataFrame:
    parts = [pa.ipc.open_stream(entry).read_pandas() for (entry,) in state.get()]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)


def _keep(state: ListState, rows: pd.DataFrame) -> None:
    """Rows instead of those that are there."""
    state.clear()
    _add(state, rows)


class Pairing(StatefulProcessor):
    """The runs of one bucket: markers that wait for the watermark, and the onsets that are open, in order of each run.

    Each call to the state goes to the JVM and back, and each key costs as much again, so the calls of a batch are as many
    as it has buckets, not runs or markers.
    """

    WAITING = ["run", "at", "row_idx", "is_onset", "trial_type"]
    OPEN = ["run", "at", "trial_type"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "markers binary")
        self.open = handle.getListState("open", "onsets binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                _add(self.waiting, pdf[self.WAITING])
                earliest = int(pdf["at"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(_due(first))
        return iter(())

    def _wake(self, due: int) -> None:
        """Keep one timer, the earliest."""
        set_for = list(self.handle.listTimers())
        if not set_for or due < min(set_for):
            for other in set_for:
                self.handle.deleteTimer(other)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = _read(self.waiting, self.WAITING)
        is_due = waiting["at"] <= passed * 1000
        later = waiting[~is_due]
        pairs = self._pair(waiting[is_due].sort_values(["at", "is_onset", "row_idx"]))
        _keep(self.waiting, later)
        if len(later):
            self.handle.registerTimer(_due(int(later["at"].min())))
        if pairs:
            yield pd.DataFrame(pairs, columns=["run", "onset_at", "offset_at", "onset_trial_type", "offset_trial_type"])

    def _pair(self, ready: pd.DataFrame) -> list[tuple]:
        """Take markers in order of time through their run's queue; offsets before onsets of the same time, which they
        cannot end."""
        known = _read(self.open, self.OPEN)
        queues, pairs, added = defaultdict(deque), [], []
        for run, at, text in zip(*(known[c].tolist() for c in self.OPEN), strict=True):
            queues[run].append((at, text))
        for run, at, _, is_onset, text in zip(*(ready[c].tolist() for c in self.WAITING), strict=True):
            if is_onset:
                queues[run].append((at, text))
                added.append((run, at, text))
            elif queues[run]:
                onset_at, onset_text = queues[run].popleft()
                pairs.append((run, onset_at, at, onset_text, text))
        if pairs:
            _keep(self.open, pd.DataFrame([(run, *onset) for run, queue in queues.items() for onset in queue], columns=self.OPEN))
        else:
            _add(self.open, pd.DataFrame(added, columns=self.OPEN))
        return pairs

    def close(self) -> None:
        pass
