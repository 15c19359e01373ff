import json

import pytest

from tracewell.operators import inventory as inv
from tracewell.operators import markers as mk
from tracewell.operators import windows as wi
from tracewell.sources import files
from tracewell.streaming import stream


@pytest.fixture
def tree(tmp_path):
    one = tmp_path / "sub-a" / "ses-b" / "ieeg"
    one.mkdir(parents=True)
    stem = "sub-a_ses-b_task-ictal_acq-ecog_run-0"
    (one / f"{stem}1_ieeg.vhdr").write_text("x\n[Common Infos]\n")
    (one / f"{stem}1_ieeg.eeg").write_bytes(b"0" * 1_048_577)
    (one / f"{stem}1_events.tsv").write_text("onset\tduration\ttrial_type\n1\t0\tsz onset\n3\t0\tsz offset\nn/a\t0\tsz onset\n")
    (one / f"{stem}1_channels.tsv").write_text("name\ttype\tstatus\tsampling_frequency\nA\tECOG\tgood\tn/a\nB\tECOG\tbad\t1000\n")
    (one / f"{stem}1_ieeg.json").write_text(json.dumps({"SamplingFrequency": -1, "sfreq": 500}))
    (one / f"{stem}2_ieeg.vhdr").write_text("broken")
    (one / f"{stem}2_events.tsv").write_text("trial_type\tonset\noffset\t2\nsz onset\n")
    (one / f"{stem}2_ieeg.json").write_text("{no json")
    (one.parent / "sub-a_ses-b_scans.tsv").write_text("filename\tacq_time\na.vhdr\t2020-01-01T00:00:00\nb.vhdr\tbad\n")
    return str(tmp_path)


def test_ingest(spark, tree):
    found = files.list_files(spark, tree)
    assert "content" not in found.columns
    assert {r.kind for r in found.collect()} == {"vhdr", "eeg", "events", "channels", "json"}
    assert sorted(r.eeg_present for r in files.content_present(found).collect()) == [False, True]
    assert sorted(r.is_valid for r in files.valid_headers(spark, tree).collect()) == [False, True]
    ev = files.events_from_tsv(files.read_tsv(spark, tree))
    assert sorted(((r.onset, r.trial_type) for r in ev.collect()), key=str) == sorted([("1", "sz onset"), ("3", "sz offset"), (None, "sz onset"), ("2", "offset"), (None, "sz onset")], key=str)
    pairs = mk.pair_intervals(mk.markers(ev)).collect()
    assert [(p.onset_s, p.offset_s) for p in pairs] == [(1.0, 3.0)]
    ch = files.channels_from_tsv(files.read_tsv(spark, tree, "*_channels.tsv"))
    assert inv.first_sampling_rate(ch).first().sfreq == 1000.0
    assert [r.n_bad for r in inv.channel_counts(ch).collect()] == [1]
    raw = {r.raw for r in files.read_json(spark, tree).collect()}
    assert "{}" in raw and len(raw) == 2
    scans = {r.filename: r for r in files.scans_from_tsv(files.read_tsv(spark, tree, "*_scans.tsv")).collect()}
    assert scans["a.vhdr"].subject == "a" and scans["a.vhdr"].acq_time.year == 2020 and scans["b.vhdr"].acq_time is None


def test_entities(spark):
    names = ["sub-jh101_ses-presurgery_task-ictal_acq-ecog_run-01_ieeg.vhdr", "sub-x_task-t_ieeg.vhdr", None, "other.txt"]
    got = inv.parse_entities(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert tuple(got[0])[1:] == ("jh101", "presurgery", "ictal", "ecog", "01") and got[1].run is None and got[3].subject is None
    strict = inv.parse_entities_strict(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert strict[0].run_no == 1 and strict[1].subject == "x" and strict[3].subject is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "base int, x string")
    files.write_csv(df, str(tmp_path / "csv"))
    files.write_parquet(df, str(tmp_path / "pq"), "base")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_streaming_features(spark, tmp_path):
    rows = spark.sql("select 'r' as base, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,i) as ts, cast(i % 4 as double) as x from (select explode(sequence(0, 19)) as i)")
    rows.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.sliding_features(src).writeStream.format("memory").queryName("features").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("features").where("n = 2").collect()
    assert got and all(r.ptp in (1.0, 3.0) for r in got)


def test_streaming_marker_counts(spark, tmp_path):
    rows = spark.sql("select if(i % 3 = 0, 'onset', 'offset') as trial_type, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,10*i,0) as ts from (select explode(sequence(0, 17)) as i)")
    rows.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.marker_counts(src).writeStream.format("memory").queryName("marker_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.window.start.hour, r.trial_type, r.runs) for r in spark.table("marker_counts").collect())
    assert got == [(h, k, n) for h in range(3) for k, n in (("offset", 4), ("onset", 2))]


def test_event_paths_and_columns(spark):
    summary = spark.createDataFrame([("a", "x.tsv"), ("b", ""), ("c", None)], "base string, events_tsv string")
    found = spark.createDataFrame([("b", "events", "y.tsv"), ("b", "json", "z.json"), ("d", "events", "w.tsv")], "base string, kind string, path string")
    assert {tuple(r) for r in inv.events_paths(summary, found).collect()} == {("a", "x.tsv"), ("b", "y.tsv"), ("d", "w.tsv")}
    assert inv.first_existing(summary, ["path", "events_tsv", "base"]) == "events_tsv" and inv.first_existing(summary, ["q"]) is None
    assert [tuple(r) for r in inv.missing_columns(summary, ["base", "q"]).collect()] == [("base", True), ("q", False)]
    named = inv.directory_fallback(inv.parse_entities(spark.createDataFrame([("x.vhdr", "/d/sub-q/ses-r/x.vhdr")], "name string, path string"))).first()
    assert (named.subject, named.session) == ("q", "r")


def test_columns_of_one_name(spark, tmp_path):
    (tmp_path / "a_events.tsv").write_text("onset\ttrial_type\tonset\n1\tsz onset\t9\n2\tsz offset\n")
    got = files.events_from_tsv(files.read_tsv(spark, str(tmp_path))).orderBy("row_idx").collect()
    assert [(r.onset, r.trial_type) for r in got] == [("1", "sz onset"), ("2", "sz offset")]


def test_siblings(spark):
    df = spark.createDataFrame([("/d/sub-a_run-01_ieeg",)], "base string")
    assert tuple(df.select(*(files.sibling(df.base, k) for k in ("events", "channels", "vhdr", "json"))).first()) == ("/d/sub-a_run-01_events.tsv", "/d/sub-a_run-01_channels.tsv", "/d/sub-a_run-01_ieeg.vhdr", "/d/sub-a_run-01_ieeg.json")


def test_written_texts_come_back(spark, tmp_path):
    rows = [("sub-a/x_events.tsv", "onset\ttrial_type\n1\tsz onset"), ("sub-b/y_events.tsv", None), ("é_events.tsv", "trial_type\tonset\n"), (None, "lost")]
    df = spark.createDataFrame(rows, "path string, value string").repartition(3)
    for root in (str(tmp_path / "one"), f"file:{tmp_path}/two", f"file://{tmp_path}/three"):
        assert files.write_texts(df, root) == 3
        got = files.events_from_tsv(files.read_tsv(spark, root)).collect()
        assert [(r.onset, r.trial_type) for r in got] == [("1", "sz onset")] and got[0].base.endswith("sub-a/x_ieeg")
        found = files.list_files(spark, root)
        assert {r.length for r in found.collect()} == {27, 17}
    assert files.write_texts(df.where("false"), str(tmp_path / "none")) == 0


def test_participants(spark, tmp_path):
    files.write_texts(spark.createDataFrame([("participants.tsv", "participant_id\tage\tsite\nsub-a\t31\tjh\nsub-b\tn/a\tn/a\n")], "path string, value string"), str(tmp_path))
    got = files.read_participants(spark, str(tmp_path / "participants.tsv"))
    assert dict(got.dtypes)["age"] == "int"
    assert [tuple(r) for r in got.orderBy("participant_id").collect()] == [("sub-a", 31, "jh"), ("sub-b", None, None)]


def test_first_channels(spark):
    ch = spark.createDataFrame([(b, i, s) for b in ("p", "q") for i, s in ((2, "good"), (0, "bad"), (1, None), (None, "good"))], "base string, ch_idx int, status string")
    assert sorted(tuple(r) for r in wi.first_channels(ch, 2).select("base", "ch_idx").collect()) == [("p", 0), ("p", 1), ("q", 0), ("q", 1)]
    assert wi.first_channels(ch).count() == 6
