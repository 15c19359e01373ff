"""Driver queries over the test tables, which stand in for the domain tables, with equivalent SQL for each.

Stand-ins: markers, scans and samples of runs from events and embeddings, runs from orders, channels from lineitem,
participants from customer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import base_name, finite, json_first_number, seconds, to_number
from ..functions.shared import shared_folder
from ..operators import arrays as ar
from ..operators import features as fe
from ..operators import frequent as fq
from ..operators import groups as gr
from ..operators import inventory as inv
from ..operators import markers as mk
from ..operators import profile as pr
from ..operators import selection as sel
from ..operators import stl
from ..operators import timeline as tl
from ..operators import windows as wi
from ..sources import files
from ..streaming import pairing

EPOCH = 1704067200.0  # 2024-01-01, where the events begin
RULES = mk.MarkerRules(onset=r"(?i)\bsignup\b", offset=r"(?i)\berror\b")
#: Marker texts for the stand-in's event types, so that the rule sets meet what they were made for.
TEXTS = {"signup": "SZ EVENT # (EEG SZ)", "error": "eeg sz end", "click": "Z ELECTROGRAPHIC ONS", "view": "offset with attenuat", "purchase": "A1+A2 OFF"}
W, STEP, FS, NPERSEG = 16, 8, 16.0, 32
SMALL_BANDS = {"low": (1.0, 4.0), "high": (4.0, 8.0)}

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def doubles(df: DataFrame, *names: str) -> DataFrame:
    """Counts that can be null as double, the type in which every client reads them alike."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# --- adapters -------------------------------------------------------------------------------------------------------
def events(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").alias("base"), F.col("event_id").alias("row_idx"), (seconds(F.col("ts")) - EPOCH).alias("onset"), F.col("event_type").alias("trial_type"))


def marks(spark, d) -> DataFrame:
    return mk.markers(events(spark, d), RULES)


def texts(spark, d) -> DataFrame:
    e = t(spark, d, "events")
    said = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in TEXTS.items()), F.col("event_type"))
    return e.select(F.col("user_id").alias("base"), F.col("event_id").alias("row_idx"), said.alias("trial_type"))


def user_runs(spark, d) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("base"))


def channels(spark, d) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "bad").otherwise("good")
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("base"), F.col("l_linenumber").alias("ch_idx"), F.col("l_suppkey"), status.alias("status"), F.when(F.col("l_linestatus") == "F", "ECOG").otherwise("SEEG").alias("type"))


def names(spark, d) -> DataFrame:
    o = t(spark, d, "orders")
    acq = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("_acq-"), F.when(F.col("o_orderkey") % 3 == 0, "seeg").otherwise("ecog"))).otherwise("")
    run = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("_run-"), F.lpad((F.col("o_orderkey") % 4).cast("string"), 2, "0"))).otherwise("")
    name = F.concat(F.lit("sub-jh"), F.col("o_custkey").cast("string"), F.lit("_ses-presurgery_task-ictal"), acq, run, F.lit("_ieeg"))
    return o.select(F.col("o_orderkey").alias("base"), name.alias("stem"), F.concat(name, F.lit(".vhdr")).alias("name"))


NAMES_SQL = """names AS (SELECT o_orderkey AS base, stem, stem || '.vhdr' AS name FROM (SELECT o_orderkey, 'sub-jh' || o_custkey || '_ses-presurgery_task-ictal' ||
  CASE WHEN o_orderkey % 7 <> 0 THEN '_acq-' || CASE WHEN o_orderkey % 3 = 0 THEN 'seeg' ELSE 'ecog' END ELSE '' END ||
  CASE WHEN o_orderkey % 5 <> 0 THEN '_run-' || lpad((o_orderkey % 4)::VARCHAR, 2, '0') ELSE '' END || '_ieeg' AS stem FROM orders))"""


def summary(spark, d) -> DataFrame:
    """Runs are orders; labels are made from lineitem: an onset is a returned line, an offset a later line of status F."""
    o = t(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("base"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderpriority") == "1-URGENT", "ECOG").when(F.col("o_orderpriority") == "2-HIGH", "seeg").when(F.col("o_orderpriority") != "5-LOW", F.lower(F.substring("o_orderpriority", 3, 4))).alias("acq"), (F.col("o_totalprice") > 200000).alias("eeg_present"))
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("base"), F.col("l_linenumber").alias("row_idx"), F.col("l_linenumber").cast("double").alias("onset"), F.when(F.col("l_returnflag") == "R", "signup").when(F.col("l_linestatus") == "F", "error").otherwise("none").alias("trial_type"))
    return inv.run_summary(runs, channels(spark, d), mk.first_onset_offset(mk.markers(li, RULES)))


SUMMARY_SQL = """ch AS (SELECT l_orderkey AS base, count(*) AS n_channels, count(*) FILTER (l_returnflag = 'R') AS n_bad, count(*) FILTER (l_returnflag <> 'R') AS n_good FROM lineitem GROUP BY 1),
fon AS (SELECT l_orderkey AS base, min(l_linenumber)::DOUBLE AS first_onset FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
lab AS (SELECT fon.base, first_onset, (SELECT min(l_linenumber)::DOUBLE FROM lineitem l WHERE l.l_orderkey = fon.base AND l_returnflag <> 'R' AND l_linestatus = 'F' AND l_linenumber > first_onset) AS first_offset FROM fon),
summary AS (SELECT o_orderkey AS base, o_custkey AS subject, CASE WHEN o_orderpriority = '1-URGENT' THEN 'ECOG' WHEN o_orderpriority = '2-HIGH' THEN 'seeg' WHEN o_orderpriority <> '5-LOW' THEN lower(substr(o_orderpriority, 3, 4)) END AS acq, o_totalprice > 200000 AS eeg_present,
  n_channels, n_bad, n_good, first_onset, first_offset, first_onset IS NOT NULL AS has_onset, first_offset IS NOT NULL AS has_offset
  FROM orders LEFT JOIN ch ON ch.base = o_orderkey LEFT JOIN lab ON lab.base = o_orderkey)"""


def signal(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("label").alias("base"), F.col("vec_id").alias("ch"), F.col("embedding").alias("xs"))


def long(spark, d) -> DataFrame:
    return wi.samples(signal(spark, d))


def framed(spark, d) -> DataFrame:
    return ar.window_sums(signal(spark, d), W, STEP)


LONG_SQL = "long AS (SELECT label AS base, vec_id AS ch, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
FRAMED_SQL = (
    LONG_SQL
    + f""", dif AS (SELECT *, x - lag(x) OVER w AS d1 FROM long WINDOW w AS (PARTITION BY base, ch ORDER BY i)),
dif2 AS (SELECT *, d1 - lag(d1) OVER w AS d2 FROM dif WINDOW w AS (PARTITION BY base, ch ORDER BY i)),
framed AS (SELECT base, ch, k, i, x, CASE WHEN i - k * {STEP} >= 1 THEN d1 END AS d1, CASE WHEN i - k * {STEP} >= 2 THEN d2 END AS d2 FROM dif2, (SELECT unnest(range(0, 7)) AS k) WHERE i >= k * {STEP} AND i < k * {STEP} + {W}),
chan AS (SELECT base, ch, k, sqrt(avg(x * x)) AS rms, max(x) - min(x) AS ptp, coalesce(sum(abs(d1)), 0) AS line_length, coalesce(var_pop(x), 0) + 1e-12 AS activity,
  sqrt((coalesce(var_pop(d1), 0) + 1e-12) / (coalesce(var_pop(x), 0) + 1e-12)) AS mobility,
  sqrt((coalesce(var_pop(d2), 0) + 1e-12) / (coalesce(var_pop(d1), 0) + 1e-12)) / (sqrt((coalesce(var_pop(d1), 0) + 1e-12) / (coalesce(var_pop(x), 0) + 1e-12)) + 1e-12) AS complexity FROM framed GROUP BY ALL),
pooled AS (SELECT base, k, sqrt(avg(x * x)) AS rms, max(x) - min(x) AS ptp, avg(abs(d1)) AS line_length FROM framed GROUP BY ALL)"""
)
PSD_SQL = (
    LONG_SQL
    + f""", seg AS (SELECT base, ch, s, i - s * 16 AS j, x FROM long, (SELECT unnest(range(0, 3)) AS s) WHERE i >= s * 16 AND i < s * 16 + {NPERSEG}),
tap AS (SELECT base, ch, s, j, (x - avg(x) OVER (PARTITION BY base, ch, s)) * (0.5 - 0.5 * cos(2 * pi() * j / {NPERSEG})) AS y FROM seg),
pow AS (SELECT base, ch, s, bin, sum(y * cos(2 * pi() * ((bin * j) % {NPERSEG}) / {NPERSEG})) ^ 2 + sum(y * sin(2 * pi() * ((bin * j) % {NPERSEG}) / {NPERSEG})) ^ 2 AS q FROM tap, (SELECT unnest(range(0, 17)) AS bin) GROUP BY ALL),
psd AS (SELECT base, ch, bin, bin * {FS} / {NPERSEG} AS f, avg(q) * (CASE WHEN bin IN (0, 16) THEN 1.0 ELSE 2.0 END) / ({FS} * 12.0) AS p FROM pow GROUP BY base, ch, bin),
band AS (SELECT base, ch, b AS band, coalesce(sum(area), 0) AS power FROM (SELECT base, ch, b, (p + lead(p) OVER w) / 2 * (lead(f) OVER w - f) AS area FROM psd, (VALUES ('low', 1.0, 4.0), ('high', 4.0, 8.0)) v(b, lo, hi) WHERE f >= lo AND f <= hi WINDOW w AS (PARTITION BY base, ch, b ORDER BY f)) GROUP BY ALL),
ent AS (SELECT base, ch, -sum(s * ln(s + 1e-12)) AS entropy FROM (SELECT base, ch, p / (sum(p) OVER (PARTITION BY base, ch) + 1e-12) AS s FROM psd) GROUP BY ALL)"""
)
EV_SQL = "ev AS (SELECT user_id AS base, event_id AS row_idx, epoch_us(ts) / 1e6 - 1704067200.0 AS t, event_type AS trial_type FROM events)"
MARK_SQL = EV_SQL + ", mk AS (SELECT *, trial_type = 'signup' AS is_onset, trial_type = 'error' AS is_offset FROM ev WHERE trial_type IN ('signup', 'error'))"
PAIR_SQL = (
    MARK_SQL
    + """, u AS (SELECT *, sum(is_offset::INT) OVER (PARTITION BY base ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM mk),
onr AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY t, row_idx) - 1 AS i FROM u WHERE is_onset),
onp AS (SELECT *, i + max(f - i) OVER (PARTITION BY base ORDER BY i ROWS UNBOUNDED PRECEDING) AS place FROM onr),
ofr AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY t, row_idx) - 1 AS place FROM mk WHERE is_offset),
pairs AS (SELECT a.base, a.t AS onset_s, b.t AS offset_s, b.t - a.t AS duration_s, a.trial_type AS onset_trial_type, b.trial_type AS offset_trial_type FROM onp a JOIN ofr b USING (base, place))"""
)
QC_SQL = (
    PAIR_SQL
    + """, qc AS (SELECT c.base, r.n_trial_rows IS NOT NULL AS events_exists, n_trial_rows, n_unique_trial_type,
  CASE WHEN r.base IS NOT NULL THEN coalesce(n_on, 0) END AS n_onset_markers, CASE WHEN r.base IS NOT NULL THEN coalesce(n_off, 0) END AS n_offset_markers, CASE WHEN r.base IS NOT NULL THEN coalesce(n_int, 0) END AS n_intervals_paired,
  CASE WHEN r.base IS NOT NULL THEN coalesce(n_on, 0) >= 2 OR coalesce(n_off, 0) >= 2 OR coalesce(n_int, 0) >= 2 END AS multi_seizure_candidate, CASE WHEN r.base IS NOT NULL THEN coalesce(n_on, 0) > coalesce(n_int, 0) END AS has_unpaired_onset,
  CASE WHEN r.base IS NOT NULL THEN EXISTS (SELECT 1 FROM mk o WHERE o.base = c.base AND o.is_offset AND o.t NOT IN (SELECT offset_s FROM pairs p WHERE p.base = c.base)) END AS has_orphan_offset, min_onset_s, max_offset_s
  FROM (SELECT DISTINCT c_custkey AS base FROM customer) c LEFT JOIN (SELECT base, count(*) AS n_trial_rows, count(DISTINCT trial_type) AS n_unique_trial_type FROM ev GROUP BY 1) r ON r.base = c.base
  LEFT JOIN (SELECT base, count(*) FILTER (is_onset) AS n_on, count(*) FILTER (is_offset) AS n_off, min(t) FILTER (is_onset) AS min_onset_s FROM mk GROUP BY 1) m ON m.base = c.base
  LEFT JOIN (SELECT base, count(*) AS n_int, max(offset_s) AS max_offset_s FROM pairs GROUP BY 1) p ON p.base = c.base)"""
)
QC_COLS = "base, events_exists, n_trial_rows::DOUBLE AS n_trial_rows, n_unique_trial_type::DOUBLE AS n_unique_trial_type, n_onset_markers::DOUBLE AS n_onset_markers, n_offset_markers::DOUBLE AS n_offset_markers, n_intervals_paired::DOUBLE AS n_intervals_paired, multi_seizure_candidate, has_unpaired_onset, has_orphan_offset, round(min_onset_s, 6) AS min_onset_s, round(max_offset_s, 6) AS max_offset_s"
FIRST_SQL = MARK_SQL + ", f1 AS (SELECT base, min(t) FILTER (is_onset) AS first_onset FROM mk GROUP BY 1), first AS (SELECT f1.base, first_onset, (SELECT min(t) FROM mk WHERE mk.base = f1.base AND is_offset AND t > first_onset) AS first_offset FROM f1)"
_ONSET2 = mk.RULES_V2.onset.replace("'", "''")


def _classes(rules: mk.MarkerRules) -> str:
    said = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEXTS.items()) + " ELSE event_type END"
    return f"SELECT trial_type, is_onset, is_offset, count(*) AS count FROM (SELECT trial_type, regexp_matches(trial_type, '{rules.onset}') AND NOT regexp_matches(trial_type, '{rules.offset}') AS is_onset, regexp_matches(trial_type, '{rules.offset}') AS is_offset FROM (SELECT {said} AS trial_type FROM events)) GROUP BY ALL"


# --- markers --------------------------------------------------------------------------------------------------------
@query(_classes(mk.RULES_V2))
def marker_classify(spark, d):
    return mk.classify(texts(spark, d)).groupBy("trial_type", "is_onset", "is_offset").agg(F.count("*").alias("count"))


@query(_classes(mk.RULES_V1))
def marker_classify_v1(spark, d):
    return mk.classify(texts(spark, d), mk.RULES_V1).groupBy("trial_type", "is_onset", "is_offset").agg(F.count("*").alias("count"))


@query(f"WITH {PAIR_SQL} SELECT base, round(onset_s, 6) AS onset_s, round(offset_s, 6) AS offset_s, round(duration_s, 6) AS duration_s, onset_trial_type, offset_trial_type FROM pairs")
def marker_pairs(spark, d):
    return mk.pair_intervals(marks(spark, d)).select("base", *r6("onset_s", "offset_s", "duration_s"), "onset_trial_type", "offset_trial_type")


@query(f"WITH {PAIR_SQL} SELECT base, round(onset_s, 6) AS onset_s, round(offset_s, 6) AS offset_s, round(duration_s, 6) AS duration_s, onset_trial_type, offset_trial_type FROM pairs")
def marker_pairs_in_bins(spark, d):
    return mk.pair_intervals(marks(spark, d), rows_per_bin=50).select("base", *r6("onset_s", "offset_s", "duration_s"), "onset_trial_type", "offset_trial_type")


@query(f"WITH {PAIR_SQL} SELECT base, round(onset_s, 6) AS onset_s, round(offset_s, 6) AS offset_s, round(duration_s, 6) AS duration_s, onset_trial_type, offset_trial_type FROM pairs")
def marker_pairs_streamed(spark, d):
    """The same pairs from a stream that is stopped in between, every tenth marker up to 15 days late; a last marker far
    behind all others moves the watermark past them."""
    e = t(spark, d, "events").select(F.col("user_id").alias("base"), F.col("event_id").alias("row_idx"), "ts", F.col("event_type").alias("trial_type"))
    second = (F.dayofmonth("ts") > 15) | (F.col("row_idx") % 10 == 0)
    end = e.agg((F.max("ts") + F.expr("interval 17 days")).alias("ts")).where("ts is not null").select(F.lit(None).cast("long").alias("base"), F.lit(0).cast("long").alias("row_idx"), "ts", F.lit("signup").alias("trial_type"))
    folder = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    for part in (e.where(~F.coalesce(second, F.lit(False))), e.where(second).union(end)):
        part.write.mode("append").parquet(f"{folder}/in")
        pairs = pairing.pair_stream(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), RULES, "16 days")
        pairing.append_available(pairs, f"{folder}/out", f"{folder}/state")
    found = spark.read.schema(pairs.schema).parquet(f"{folder}/out")
    at = lambda c: F.round(seconds(F.col(c)) - EPOCH, 6)
    return found.select("base", at("onset_ts").alias("onset_s"), at("offset_ts").alias("offset_s"), *r6("duration_s"), "onset_trial_type", "offset_trial_type")


@query(f"WITH {FIRST_SQL} SELECT base, round(first_onset, 6) AS first_onset, round(first_offset, 6) AS first_offset FROM first")
def first_onset_offset(spark, d):
    return mk.first_onset_offset(marks(spark, d)).select("base", *r6("first_onset", "first_offset"))


@query(f"WITH {QC_SQL} SELECT {QC_COLS} FROM qc")
def marker_qc_by_run(spark, d):
    qc = mk.marker_qc(user_runs(spark, d), events(spark, d), RULES).withColumns({n: F.round(n, 6) for n in ("min_onset_s", "max_offset_s")})
    return doubles(qc, "n_trial_rows", "n_unique_trial_type", "n_onset_markers", "n_offset_markers", "n_intervals_paired")


@query(f"WITH {QC_SQL} SELECT count(*) AS runs, count(*) FILTER (n_onset_markers > 0) AS with_onset, count(*) FILTER (n_offset_markers > 0) AS with_offset, count(*) FILTER (n_intervals_paired > 0) AS with_interval, count(*) FILTER (multi_seizure_candidate) AS multi, count(*) FILTER (has_unpaired_onset) AS unpaired, count(*) FILTER (has_orphan_offset) AS orphan FROM qc WHERE events_exists")
def qc_totals(spark, d):
    return mk.qc_totals(mk.marker_qc(user_runs(spark, d), events(spark, d), RULES))


@query("SELECT coalesce(event_type, 'nan') AS trial_type, count(*) AS count FROM events GROUP BY 1")
def vocab_all(spark, d):
    return mk.vocabulary(events(spark, d))


@query("SELECT event_type AS trial_type, count(*) AS count FROM events WHERE event_type = 'signup' GROUP BY 1")
def vocab_onset(spark, d):
    return mk.vocabulary(marks(spark, d).where("is_onset"))


@query("SELECT event_type AS trial_type, count(*) AS count FROM events WHERE event_type = 'error' GROUP BY 1")
def vocab_offset(spark, d):
    return mk.vocabulary(marks(spark, d).where("is_offset"))


@query("SELECT event_type AS trial_type, count(*) AS count FROM events WHERE event_type = 'signup' GROUP BY 1")
def vocab_onset_untimed(spark, d):
    """Counted before rows whose time is no number go: every second marker here has none."""
    e = events(spark, d).withColumn("onset", F.when(F.col("row_idx") % 2 == 0, F.col("onset").cast("string")).otherwise("n/a"))
    return mk.vocabulary(mk.classify(e, RULES).where("is_onset"))


@query("SELECT event_type AS trial_type, count(*) AS count FROM events WHERE event_type = 'signup' AND event_id % 2 = 0 GROUP BY 1")
def vocab_onset_timed(spark, d):
    e = events(spark, d).withColumn("onset", F.when(F.col("row_idx") % 2 == 0, F.col("onset").cast("string")).otherwise("n/a"))
    return mk.vocabulary(mk.markers(e, RULES).where("is_onset"))


@query("SELECT text AS trial_type, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def vocab_topn(spark, d):
    return mk.vocabulary(t(spark, d, "documents"), "text", 20)


@query("SELECT coalesce(text, 'nan') AS trial_type, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def vocab_topn_by_hash(spark, d):
    """Nearly all texts occur once, so that no sketch can name the top ones."""
    return fq.top_values(t(spark, d, "documents"), "text", 20, "nan", value="trial_type")


@query("SELECT concat_ws(' ', l_partkey, l_linenumber) AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_values_of_many(spark, d):
    return fq.top_values(t(spark, d, "lineitem").select(F.concat_ws(" ", "l_partkey", "l_linenumber").alias("part_line")), "part_line")


@query("SELECT coalesce(event_type, '<NA>') || ' ' || hour(ts) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_values_by_sketch(spark, d):
    return fq.top_values(t(spark, d, "events").select(F.concat_ws(" ", F.coalesce("event_type", F.lit("<NA>")), F.hour("ts")).alias("type_hour")), "type_hour")


AGREE_SQL = FIRST_SQL + """, summ AS (SELECT base, first_onset + CASE WHEN base % 3 = 0 THEN 0.75 ELSE 0.25 END AS first_onset, CASE WHEN base % 4 = 0 THEN first_onset - 1 ELSE first_offset END AS first_offset FROM first),
agree AS (SELECT base, s.first_onset - f.first_onset AS onset_diff, s.first_offset - f.first_offset AS offset_diff, abs(s.first_onset - f.first_onset) <= 0.5 AS onset_match, abs(s.first_offset - f.first_offset) <= 0.5 AS offset_match FROM summ s JOIN first f USING (base))"""


def _two_sources(spark, d):
    derived = mk.first_onset_offset(marks(spark, d))
    moved = derived.select("base", (F.col("first_onset") + F.when(F.col("base") % 3 == 0, 0.75).otherwise(0.25)).alias("first_onset"), F.when(F.col("base") % 4 == 0, F.col("first_onset") - 1).otherwise(F.col("first_offset")).alias("first_offset"))
    return moved, derived


@query(f"WITH {AGREE_SQL} SELECT count(onset_match) AS onset_compared, count(*) FILTER (onset_match) AS onset_matched, round(avg(onset_match::INT), 6) AS onset_rate, count(offset_match) AS offset_compared, count(*) FILTER (offset_match) AS offset_matched, round(avg(offset_match::INT), 6) AS offset_rate FROM agree")
def label_agreement(spark, d):
    return mk.agreement_rates(mk.label_agreement(*_two_sources(spark, d))).withColumns({n: F.round(n, 6) for n in ("onset_rate", "offset_rate")})


@query(f"WITH {AGREE_SQL} SELECT base, round(abs(offset_diff), 3) AS abs_diff FROM agree WHERE NOT offset_match ORDER BY abs(offset_diff) DESC, base LIMIT 10")
def top_mismatches(spark, d):
    return mk.top_mismatches(mk.label_agreement(*_two_sources(spark, d)), "offset").withColumn("abs_diff", F.round("abs_diff", 3))


@query(f"WITH {AGREE_SQL} SELECT base, round(first_onset, 6) AS first_onset, round(first_offset, 6) AS first_offset FROM summ WHERE first_offset <= first_onset")
def bad_order(spark, d):
    return mk.bad_order(_two_sources(spark, d)[0]).select("base", *r6("first_onset", "first_offset"))


# --- inventory and selection ----------------------------------------------------------------------------------------
_PART = "nullif(regexp_extract(stem, '(?:^|_){}-([^_]+)', 1), '') AS {}"


@query(f"WITH {NAMES_SQL} SELECT base, name, {', '.join(_PART.format(k, v) for k, v in (('sub', 'subject'), ('ses', 'session'), ('task', 'task'), ('acq', 'acq'), ('run', 'run')))} FROM names")
def entity_parse(spark, d):
    return inv.parse_entities(names(spark, d)).drop("stem")


@query(f"WITH {NAMES_SQL}, n AS (SELECT base, CASE WHEN base % 11 = 0 THEN 'x' || name WHEN base % 11 = 1 THEN replace(name, 'sub-', 'sub-a-b.') ELSE name END AS name FROM names), p AS (SELECT base, name, regexp_extract(regexp_replace(name, '\\.[A-Za-z0-9]+$', ''), '^sub-([^_]+)(?:_ses-([^_]+))?(?:_task-([^_]+))?(?:_acq-([^_]+))?(?:_run-(\\d+))?_ieeg$', ['subject', 'session', 'task', 'acq', 'run']) AS m FROM n) SELECT base, name, nullif(m.subject, '') AS subject, nullif(m.session, '') AS session, nullif(m.task, '') AS task, nullif(m.acq, '') AS acq, nullif(m.run, '')::DOUBLE AS run_no FROM p")
def entity_parse_strict(spark, d):
    n = names(spark, d).select("base", F.when(F.col("base") % 11 == 0, F.concat(F.lit("x"), F.col("name"))).when(F.col("base") % 11 == 1, F.replace("name", F.lit("sub-"), F.lit("sub-a-b."))).otherwise(F.col("name")).alias("name"))
    return doubles(inv.parse_entities_strict(n), "run_no")


@query("SELECT event_id, CASE WHEN v > 0 AND isfinite(v) THEN v ELSE CASE WHEN w > 0 THEN w END END AS first_number FROM (SELECT event_id, try_cast(json_extract_string(props, '$.missing') AS DOUBLE) AS v, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS w FROM events)")
def json_first_number_of_props(spark, d):
    return t(spark, d, "events").select("event_id", json_first_number(F.col("props"), ["missing", "k"]).alias("first_number"))


@query("SELECT l_orderkey AS base, count(*) AS n_channels, count(*) FILTER (l_returnflag = 'R') AS n_bad, count(*) FILTER (l_returnflag <> 'R') AS n_good FROM lineitem GROUP BY 1")
def channel_counts(spark, d):
    return inv.channel_counts(channels(spark, d))


@query("SELECT l_orderkey AS base, CASE WHEN l_linestatus = 'F' THEN 'ECOG' ELSE 'SEEG' END AS type, count(*) AS n FROM lineitem GROUP BY ALL")
def type_map_rows(spark, d):
    return inv.type_map(channels(spark, d)).select("base", F.explode("types").alias("type", "n"))


@query("SELECT base, ch_idx, good, rank FROM (SELECT l_orderkey AS base, l_linenumber AS ch_idx, l_suppkey, g AS good, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rank FROM (SELECT *, l_returnflag <> 'R' AND l_linestatus = 'F' AS g, max((l_returnflag <> 'R' AND l_linestatus = 'F')::INT) OVER (PARTITION BY l_orderkey) AS any_good FROM lineitem) WHERE g OR any_good = 0) WHERE rank <= 3")
def good_channels(spark, d):
    return inv.good_channels(channels(spark, d), types=("ECOG",), most=3).select("base", "ch_idx", "good", "rank")


@query(f"WITH {SUMMARY_SQL} SELECT base, subject, acq, eeg_present, n_channels::DOUBLE AS n_channels, n_bad::DOUBLE AS n_bad, n_good::DOUBLE AS n_good, first_onset, first_offset, has_onset, has_offset FROM summary")
def run_inventory(spark, d):
    return doubles(summary(spark, d), "n_channels", "n_bad", "n_good")


@query(f"WITH {SUMMARY_SQL} SELECT count(*) AS runs, count(DISTINCT subject) AS subjects, count(*) FILTER (has_onset) AS onset_runs, count(*) FILTER (has_offset) AS offset_runs, count(*) FILTER (has_onset AND has_offset) AS both_runs, count(*) FILTER (eeg_present) AS present_runs, count(*) FILTER (has_onset AND has_offset AND eeg_present) AS ready_runs, round(count(*) FILTER (has_onset) * 100.0 / count(*), 6)::DOUBLE AS onset_pct, round(count(*) FILTER (has_onset AND has_offset) * 100.0 / count(*), 6)::DOUBLE AS both_pct, round(count(*) FILTER (eeg_present) * 100.0 / count(*), 6)::DOUBLE AS present_pct FROM summary")
def coverage(spark, d):
    return inv.coverage(summary(spark, d))


@query(f"WITH {SUMMARY_SQL} SELECT coalesce(acq, '<NA>') AS acq, count(*) AS runs, count(*) FILTER (has_onset) AS onset_runs, count(*) FILTER (has_onset AND has_offset) AS both_runs, count(*) FILTER (eeg_present) AS present_runs, median(n_channels) AS median_channels, median(n_bad) AS median_bad FROM summary GROUP BY 1")
def summary_by_group(spark, d):
    return inv.summary_by_group(summary(spark, d))


SCORED_SQL = SUMMARY_SQL + """, scored AS (SELECT *, 10.0 * has_onset::INT + 15.0 * (has_onset AND has_offset)::INT + coalesce(n_channels, 0)::DOUBLE / 50 - coalesce(n_bad, 0)::DOUBLE / 50 + 2.0 * coalesce(lower(acq) IN ('ecog', 'seeg'), false)::INT + 3.0 * (NOT eeg_present)::INT AS score,
  10.0 * (has_onset AND has_offset)::INT + coalesce(lower(acq) IN ('ecog', 'seeg'), false)::INT + coalesce(n_channels, 0)::DOUBLE / 100 AS signal_score, 10.0 * (has_onset AND has_offset)::INT AS report_score FROM summary)"""


def _scored(spark, d):
    s = summary(spark, d)
    return s.withColumn("score", sel.shortlist_score(s)).withColumn("signal_score", sel.signal_score(s)).withColumn("report_score", sel.report_score(s))


@query(f"WITH {SCORED_SQL} SELECT base, round(score, 6) AS score, round(signal_score, 6) AS signal_score, round(report_score, 6) AS report_score FROM scored")
def score_candidates(spark, d):
    return _scored(spark, d).select("base", *r6("score", "signal_score", "report_score"))


@query(f"WITH {SCORED_SQL} SELECT base, eeg_present, n_channels FROM scored ORDER BY eeg_present DESC, n_channels DESC NULLS LAST, base LIMIT 20")
def top_runs(spark, d):
    return sel.top(_scored(spark, d), 20, F.desc("eeg_present"), F.desc_nulls_last("n_channels"), "base").select("base", "eeg_present", "n_channels")


@query(f"WITH {SCORED_SQL} SELECT base, subject, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, base) AS r FROM scored) WHERE r <= 2 ORDER BY score DESC, base LIMIT 15")
def select_diverse(spark, d):
    """Ranked within a subject by the score, among all by the score as it is shown."""
    shown = _scored(spark, d).withColumn("shown", F.round("score", 6))
    return sel.select_diverse(shown, 15, order="shown").select("base", "subject", F.col("shown").alias("score"))


TIER_SQL = SCORED_SQL + """, a AS (SELECT *, 1 AS pool FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, base) AS r FROM scored WHERE n_channels >= 7 AND eeg_present AND has_onset AND has_offset AND lower(acq) = 'ecog') WHERE r <= 2 ORDER BY score DESC, base LIMIT 15),
b AS (SELECT *, 2 AS pool FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, base) AS r FROM scored WHERE n_channels >= 6 AND has_offset AND lower(acq) = 'seeg' AND base NOT IN (SELECT base FROM a)) WHERE r <= 2 ORDER BY score DESC, base LIMIT 10),
ab AS (SELECT * FROM a UNION ALL SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (ORDER BY score DESC, base) + (SELECT count(*) FROM a) AS nth FROM b) WHERE nth <= 10),
c AS (SELECT *, 3 AS pool FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, base) AS r FROM scored WHERE base NOT IN (SELECT base FROM ab)) WHERE r <= 2 ORDER BY score DESC, base LIMIT 10),
abc AS (SELECT * FROM ab UNION ALL SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (ORDER BY score DESC, base) + (SELECT count(*) FROM ab) AS nth FROM c) WHERE nth <= 10)"""


@query(f"WITH {TIER_SQL} SELECT base, subject, round(score, 6) AS score, pool FROM abc")
def tiered_fill(spark, d):
    first = (F.col("n_channels") >= 7) & F.col("eeg_present") & F.col("has_onset") & F.col("has_offset") & (F.lower("acq") == "ecog")
    second = (F.col("n_channels") >= 6) & F.col("has_offset") & (F.lower("acq") == "seeg")
    return sel.tiered_fill(_scored(spark, d), [first, second, F.lit(True)]).select("base", "subject", F.round("score", 6).alias("score"), "pool")


@query(f"WITH {SCORED_SQL}, x AS (SELECT base, CASE WHEN eeg_present AND has_offset AND n_channels > 20 THEN 0 WHEN eeg_present THEN 1 END AS tier FROM scored) SELECT base, tier FROM x WHERE tier = (SELECT min(tier) FROM x)")
def candidate_fallback(spark, d):
    s = _scored(spark, d)
    return sel.first_tier(s, F.col("eeg_present") & F.col("has_offset") & (F.col("n_channels") > 20), F.col("eeg_present")).select("base", "tier")


@query("SELECT o_orderkey AS path, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS eeg_present FROM orders")
def manifest_presence(spark, d):
    listed = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("path"))
    return inv.present_by_manifest(t(spark, d, "orders").select(F.col("o_orderkey").alias("path")), listed)


@query("SELECT o_orderkey AS path, o_totalprice * 10 > 1048576 AS eeg_present FROM orders")
def manifest_empty_presence(spark, d):
    """An empty manifest: sizes decide."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_totalprice") * 10).alias("bytes"))
    return inv.present_by_manifest(o, o.where("path < 0"), size=F.col("bytes")).select("path", "eeg_present")


@query("SELECT o_orderkey AS path, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS eeg_present FROM orders")
def manifest_over_size(spark, d):
    """A manifest with paths decides alone, whatever the sizes."""
    listed = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("path"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_totalprice") * 10).alias("bytes"))
    return inv.present_by_manifest(o, listed, size=F.col("bytes")).select("path", "eeg_present")


@query("WITH ch AS (SELECT l_orderkey AS base, min(l_discount) AS v FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS f FROM lineitem WHERE l_discount > 0) WHERE l_linenumber = f GROUP BY 1) SELECT o_orderkey AS base, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 + 500.0 ELSE v END AS sfreq FROM orders LEFT JOIN ch ON ch.base = o_orderkey")
def sampling_rate(spark, d):
    """The sidecar's rate where it has one (every third run), else the first of the channels."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("base"), F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct((F.col("o_orderkey") % 7 + 500.0).alias("SamplingFrequency")))).otherwise("{}").alias("raw"))
    c = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("base"), F.col("l_linenumber").alias("ch_idx"), F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("n/a").alias("sampling_frequency"))
    return inv.sampling_rate(o, o, c)


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 1 THEN o_totalprice::VARCHAR || 'd' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS price FROM orders")
def numbers_from_text(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, "n/a").when(F.col("o_orderkey") % 4 == 1, F.concat(F.col("o_totalprice").cast("string"), F.lit("d"))).otherwise(F.col("o_totalprice").cast("string"))
    return t(spark, d, "orders").select("o_orderkey", to_number(text).alias("price"))


@query("SELECT user_id AS base, event_type AS trial_type, count(*) AS n FROM events WHERE event_type IN ('signup', 'error') AND event_id % 5 <> 0 GROUP BY ALL")
def events_of_tables(spark, d):
    """Rows as read from tables by header: base from the path, missing onsets null."""
    e = t(spark, d, "events")
    path = F.concat(F.lit("/data/sub-"), F.col("user_id").cast("string"), F.lit("_events.tsv"))
    cells = e.select(path.alias("path"), F.col("event_id").alias("row_idx"), F.create_map(F.lit("onset"), F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string")), F.lit("trial_type"), F.col("event_type")).alias("cells"))
    m = mk.markers(files.events_from_tsv(cells), RULES)
    return m.groupBy(F.regexp_extract("base", r"sub-(\d+)_ieeg", 1).cast("long").alias("base"), "trial_type").agg(F.count("*").alias("n"))


@query(f"WITH {NAMES_SQL}, r AS (SELECT base, '/data/' || left(stem, length(stem) - 5) AS root FROM names) SELECT base, root || '_ieeg' AS run, root || '_events.tsv' AS events, root || '_channels.tsv' AS channels, root || '_ieeg.vmrk' AS vmrk FROM r")
def run_paths(spark, d):
    """Any kind of file leads to its run, and the run to all kinds."""
    root = F.concat(F.lit("/data/"), F.expr("left(stem, length(stem) - 5)"))
    tail = F.when(F.col("base") % 3 == 0, "_events.tsv").when(F.col("base") % 3 == 1, "_channels.tsv").otherwise("_ieeg.eeg")
    n = names(spark, d).select("base", files.run_base(F.concat(root, tail)).alias("run"))
    return n.select("base", "run", *(files.sibling(F.col("run"), k).alias(k) for k in ("events", "channels", "vmrk")))


@query("SELECT o_orderkey AS base, o_orderkey % 4 <> 0 AND o_totalprice * 10 > 1048576 AS eeg_present FROM orders")
def content_by_size(spark, d):
    """Every run has a header file; only a signal file of some size is content, and every fourth run has none."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("base"), (F.col("o_totalprice") * 10).alias("length"))
    found = o.withColumn("kind", F.lit("vhdr")).unionByName(o.where("base % 4 <> 0").withColumn("kind", F.lit("eeg")))
    return files.content_present(found)


@query(f"WITH {NAMES_SQL}, c AS (SELECT base, o_custkey FROM names JOIN orders ON o_orderkey = base) SELECT base, CASE WHEN base % 2 = 0 THEN 'd' ELSE 'jh' END || o_custkey AS subject, CASE WHEN base % 2 = 0 THEN 'dir' ELSE 'presurgery' END AS session FROM c")
def directory_entities(spark, d):
    """Every second name tells neither subject nor session: its directories do."""
    bare = F.regexp_replace("name", "^sub-[^_]+_ses-[^_]+_", "")
    n = names(spark, d).select("base", F.when(F.col("base") % 2 == 0, bare).otherwise(F.col("name")).alias("name"), F.regexp_extract("stem", "^sub-jh([0-9]+)_", 1).alias("cust"))
    n = n.withColumn("path", F.concat(F.lit("C:\\ds\\sub-d"), F.col("cust"), F.lit("\\ses-dir/ieeg/"), F.col("name")))
    return inv.directory_fallback(inv.parse_entities(n)).select("base", "subject", "session")


@query("WITH f AS (SELECT l_orderkey AS base, max(l_returnflag) AS found FROM lineitem WHERE l_quantity > 40 GROUP BY 1), s AS (SELECT o_orderkey AS base, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS named FROM orders) SELECT base, coalesce(named, found) AS events_tsv FROM s FULL JOIN f USING (base) WHERE coalesce(named, found) IS NOT NULL")
def events_paths(spark, d):
    """The path that the summary names (empty or null where it names none), else the one among the files."""
    named = t(spark, d, "orders").select(F.col("o_orderkey").alias("base"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "O", "").alias("events_tsv"))
    found = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("base"), F.when(F.col("l_quantity") > 40, "events").otherwise("channels").alias("kind"), F.col("l_returnflag").alias("path"))
    return inv.events_paths(named, found)


@query("SELECT user_id::VARCHAR AS subject, count(*) AS scans, count(*) FILTER (event_id % 3 <> 0) AS dated, min(ts) FILTER (event_id % 3 <> 0) AS first_ts FROM events GROUP BY 1")
def scans_of_tables(spark, d):
    """Rows as read from scan tables by header: subjects from the directories, dates that are none null."""
    when = F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("n/a")
    path = F.concat(F.lit("/data/sub-"), F.col("user_id").cast("string"), F.lit("/ses-1/scans.tsv"))
    cells = t(spark, d, "events").select(path.alias("path"), F.create_map(F.lit("filename"), F.col("event_type"), F.lit("acq_time"), when).alias("cells"))
    return files.scans_from_tsv(cells).groupBy("subject").agg(F.count("*").alias("scans"), F.count("acq_time").alias("dated"), F.min("acq_time").alias("first_ts"))


@query("SELECT 'sub-' || l_orderkey || '_ieeg' AS base, count(*) AS n_channels, count(*) FILTER (l_returnflag = 'R') AS n_bad, count(*) FILTER (l_returnflag <> 'R') AS n_good FROM lineitem GROUP BY l_orderkey")
def channels_of_tables(spark, d):
    path = F.concat(F.lit("sub-"), F.col("l_orderkey").cast("string"), F.lit("_channels.tsv"))
    status = F.when(F.col("l_returnflag") == "R", "BAD").otherwise("good")
    cells = t(spark, d, "lineitem").select(path.alias("path"), F.col("l_linenumber").alias("row_idx"), F.create_map(F.lit("name"), F.col("l_linestatus"), F.lit("status"), status).alias("cells"))
    return inv.channel_counts(files.channels_from_tsv(cells))


@query("SELECT o_orderkey AS base, o_custkey AS subject FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def runs_with_onset(spark, d):
    """Runs of one table that another one knows, each once."""
    hit = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("base"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("base"), F.col("o_custkey").alias("subject")).join(hit, "base", "left_semi")


@query("WITH b AS (SELECT o_orderkey AS base FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) SELECT base, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS vhdr, (SELECT max(l_returnflag) FROM lineitem WHERE l_orderkey = base AND l_quantity > 40) AS events FROM b LEFT JOIN orders ON o_orderkey = base GROUP BY base")
def union_bases(spark, d):
    a = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("base"), F.lit("vhdr").alias("kind"), F.col("o_orderpriority").alias("path"))
    b = t(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("base"), F.lit("events").alias("kind"), F.col("l_returnflag").alias("path"))
    return inv.union_of_kinds(a.unionByName(b), ("vhdr", "events"))


@query("SELECT o_orderkey AS base, (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS has_interval FROM orders")
def membership_flag(spark, d):
    hit = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("base")).distinct().withColumn("has_interval", F.lit(True))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("base")).join(hit, "base", "left").withColumn("has_interval", F.coalesce("has_interval", F.lit(False)))


@query(f"WITH {NAMES_SQL} SELECT base, name FROM names WHERE regexp_matches(name, '_acq-.*_ieeg\\.vhdr')")
def filter_by_filename(spark, d):
    n = names(spark, d).select("base", F.concat(F.lit("a\\b/"), F.col("name")).alias("name"))
    return n.where(F.coalesce(F.col("name").rlike(r"_acq-.*_ieeg\.vhdr"), F.lit(False))).select("base", base_name(F.col("name")).alias("name"))


@query("SELECT l_orderkey AS base, min(l_discount) FILTER (l_discount > 0 AND l_linenumber = first_line) AS sfreq FROM (SELECT *, min(CASE WHEN l_discount > 0 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS first_line FROM lineitem) GROUP BY 1")
def sampling_rate_fallback(spark, d):
    c = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("base"), F.col("l_linenumber").alias("ch_idx"), F.when(finite(F.col("l_discount")) & (F.col("l_discount") > 0), F.col("l_discount")).alias("sampling_frequency"))
    return inv.first_sampling_rate(c)


# --- windows and labels ---------------------------------------------------------------------------------------------
@query(f"WITH {PAIR_SQL}, dur AS (SELECT base, max(t) AS duration_s FROM ev GROUP BY 1), e AS (SELECT base, min(onset_s) AS a, max(offset_s) AS b FROM pairs WHERE offset_s > onset_s GROUP BY 1) SELECT base, round(CASE WHEN a IS NOT NULL THEN greatest(0.0, a - 3600) ELSE 0 END, 6) AS t_min, round(CASE WHEN b IS NOT NULL THEN least(b + 3600, duration_s) ELSE least(duration_s, 300) END, 6) AS t_max FROM dur LEFT JOIN e USING (base)")
def crop_bounds(spark, d):
    dur = events(spark, d).groupBy("base").agg(F.max("onset").alias("duration_s"))
    return wi.crop_bounds(dur, mk.pair_intervals(marks(spark, d)), 3600.0, 3600.0).select("base", *r6("t_min", "t_max"))


FRAME_SQL = PAIR_SQL + """, n AS (SELECT base, floor(max(t) / 3600)::BIGINT + 1 AS n FROM ev GROUP BY 1),
fr AS (SELECT base, k, k * 12 AS s0, (k * 12) * 3600.0 AS t_start, (k * 12 + 24) * 3600.0 AS t_end, (k * 12 + 11.5) * 3600.0 AS t_mid FROM (SELECT base, n, unnest(range(0, CASE WHEN n >= 24 THEN (n - 24) // 12 + 1 ELSE 0 END)) AS k FROM n))"""


def _hour_frames(spark, d):
    """Runs sampled once an hour, in windows of a day that move by half a day."""
    n = events(spark, d).groupBy("base").agg((F.floor(F.max("onset") / 3600) + 1).alias("n"))
    return wi.frames(n, 24, 12, 1 / 3600.0)


@query(f"WITH {FRAME_SQL} SELECT base, k, s0, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, round(t_mid, 3) AS t_mid FROM fr")
def window_frames(spark, d):
    return _hour_frames(spark, d).select("base", "k", "s0", *(F.round(c, 3).alias(c) for c in ("t_start", "t_end", "t_mid")))


@query(f"WITH {FRAME_SQL} SELECT base, k, max(CASE WHEN onset_s <= t_mid AND t_mid <= offset_s THEN 1 ELSE 0 END) AS y FROM fr LEFT JOIN pairs USING (base) GROUP BY ALL")
def label_midpoint(spark, d):
    return wi.label_windows(_hour_frames(spark, d), mk.pair_intervals(marks(spark, d)), "midpoint").select("base", "k", "y")


@query(f"WITH {FRAME_SQL} SELECT base, k, max(CASE WHEN onset_s <= t_mid AND t_mid <= offset_s THEN 1 ELSE 0 END) AS y FROM fr LEFT JOIN pairs USING (base) GROUP BY ALL")
def label_midpoint_in_bins(spark, d):
    return wi.label_windows(_hour_frames(spark, d), mk.pair_intervals(marks(spark, d)), "midpoint", rows_per_bin=300).select("base", "k", "y")


@query(f"WITH {FRAME_SQL} SELECT base, k, max(CASE WHEN t_end > onset_s AND t_start < offset_s THEN 1 ELSE 0 END) AS y FROM fr LEFT JOIN pairs USING (base) GROUP BY ALL")
def label_overlap(spark, d):
    return wi.label_windows(_hour_frames(spark, d), mk.pair_intervals(marks(spark, d)), "overlap").select("base", "k", "y")


@query(f"WITH {FRAME_SQL} SELECT base, k, max(CASE WHEN t_end > onset_s AND t_start < offset_s THEN 1 ELSE 0 END) AS y FROM fr LEFT JOIN pairs USING (base) GROUP BY ALL")
def label_overlap_in_bins(spark, d):
    return wi.label_windows(_hour_frames(spark, d), mk.pair_intervals(marks(spark, d)), "overlap", rows_per_bin=300).select("base", "k", "y")


@query(f"WITH {FRAME_SQL}, y AS (SELECT base, k, max(CASE WHEN t_end > onset_s AND t_start < offset_s THEN 1 ELSE 0 END) AS y FROM fr LEFT JOIN pairs USING (base) GROUP BY ALL) SELECT base, count(*) AS n_windows, count(*) FILTER (y = 1) AS y_pos, count(*) FILTER (y = 0) AS y_neg, round(avg(y), 6) AS positive_rate FROM y GROUP BY 1")
def window_counts(spark, d):
    y = label_overlap(spark, d)
    return y.groupBy("base").agg(F.count("*").alias("n_windows"), F.count_if(F.col("y") == 1).alias("y_pos"), F.count_if(F.col("y") == 0).alias("y_neg"), F.round(F.avg("y"), 6).alias("positive_rate"))


# --- features -------------------------------------------------------------------------------------------------------
def _r(names_: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names_.split())


@query(f"WITH {FRAMED_SQL}, ll AS (SELECT base, k, avg(line_length) AS line_length FROM chan GROUP BY ALL) SELECT base, k, round(p.rms, 6) AS rms, round(p.ptp, 6) AS ptp, round(ll.line_length, 6) AS line_length FROM pooled p JOIN ll USING (base, k)")
def window_features_simple(spark, d):
    return fe.simple_features(framed(spark, d)).select("base", "k", *r6("rms", "ptp", "line_length"))


@query(f"WITH {FRAMED_SQL} SELECT base, k, {', '.join(f'round(avg({n}), 6) AS {n}' for n in 'rms ptp line_length activity mobility complexity'.split())} FROM chan GROUP BY base, k")
def window_features_full(spark, d):
    return fe.mean_over_channels(fe.channel_features(framed(spark, d))).select("base", "k", *r6("rms", "ptp", "line_length", "activity", "mobility", "complexity"))


WT_SQL = FRAMED_SQL + f""", w0 AS (SELECT base, k, i - k * {STEP} AS j, x FROM framed WHERE (base, ch) IN (SELECT base, min(ch) FROM framed GROUP BY 1)),
wt AS (SELECT base, k, j, (x - avg(x) OVER (PARTITION BY base, k)) * (0.5 - 0.5 * cos(2 * pi() * j / {W})) AS y FROM w0),
wq AS (SELECT base, k, bin, sum(y * cos(2 * pi() * ((bin * j) % {W}) / {W})) ^ 2 + sum(y * sin(2 * pi() * ((bin * j) % {W}) / {W})) ^ 2 AS q FROM wt, (SELECT unnest(range(0, 9)) AS bin) GROUP BY ALL),
wp AS (SELECT base, k, bin * {FS} / {W} AS f, q * (CASE WHEN bin IN (0, 8) THEN 1.0 ELSE 2.0 END) / ({FS} * 6.0) AS p FROM wq),
wb AS (SELECT base, k, b, sum(area) AS power FROM (SELECT base, k, b, (p + lead(p) OVER w) / 2 * (lead(f) OVER w - f) AS area FROM wp, (VALUES ('low', 1.0, 4.0), ('high', 4.0, 8.0)) v(b, lo, hi) WHERE f >= lo AND f <= hi WINDOW w AS (PARTITION BY base, k, b ORDER BY f)) GROUP BY ALL),
we AS (SELECT base, k, -sum(s * ln(s + 1e-12)) AS spectral_entropy FROM (SELECT base, k, p / (sum(p) OVER (PARTITION BY base, k) + 1e-12) AS s FROM wp) GROUP BY ALL),
wm AS (SELECT base, k, {', '.join(f'avg({n}) AS {n}' for n in 'rms ptp line_length activity mobility complexity'.split())} FROM chan GROUP BY base, k)"""


@query(f"WITH {WT_SQL} SELECT base, k, {_r('rms ptp line_length activity mobility complexity spectral_entropy')}, round(lo.power, 9) AS bp_low, round(hi.power, 9) AS bp_high FROM wm JOIN we USING (base, k) JOIN (SELECT * FROM wb WHERE b = 'low') lo USING (base, k) JOIN (SELECT * FROM wb WHERE b = 'high') hi USING (base, k)")
def window_features_table(spark, d):
    out = fe.window_table(signal(spark, d), W, STEP, FS, SMALL_BANDS)
    return out.select("base", "k", *r6("rms", "ptp", "line_length", "activity", "mobility", "complexity", "spectral_entropy"), *(F.round(c, 9).alias(c) for c in ("bp_low", "bp_high")))


#: Metadata and intervals of the stand-in runs: an interval of a second that begins later with each of four runs.
META_SQL = "meta AS (SELECT DISTINCT label AS base, 'jh' || label AS subject, CASE WHEN label % 2 = 0 THEN 'ecog' ELSE 'seeg' END AS acq, label % 4 AS run FROM embeddings), iv AS (SELECT base, 0.5 + 0.25 * run AS onset_s, 1.5 + 0.25 * run AS offset_s FROM meta WHERE base % 5 <> 0)"


def _meta(spark, d):
    return signal(spark, d).select("base").distinct().select("base", F.concat(F.lit("jh"), F.col("base").cast("string")).alias("subject"), F.when(F.col("base") % 2 == 0, "ecog").otherwise("seeg").alias("acq"), (F.col("base") % 4).alias("run"))


def _intervals(spark, d):
    on = F.lit(0.5) + F.lit(0.25) * F.col("run")
    return _meta(spark, d).where("base % 5 <> 0").select("base", on.alias("onset_s"), (on + 1.0).alias("offset_s"))


TIMES_SQL = f"k * {STEP} / {FS} AS t_start, (k * {STEP} + {W}) / {FS} AS t_end, (k * {STEP} + {(W - 1) / 2}) / {FS} AS t_mid"
TIMED_SQL = f"tm AS (SELECT DISTINCT base, k, {TIMES_SQL} FROM framed), lb AS (SELECT tm.*, coalesce((t_end > onset_s AND t_start < offset_s)::INT, 0) AS y, coalesce((t_mid >= onset_s AND t_mid <= offset_s)::INT, 0) AS y_mid FROM tm LEFT JOIN iv USING (base))"


@query(f"WITH {FRAMED_SQL}, {META_SQL}, {TIMED_SQL}, ll AS (SELECT base, k, avg(line_length) AS line_length FROM chan GROUP BY ALL) SELECT base, k, round(t_mid, 6) AS t_mid_s, round(p.rms, 6) AS rms, round(p.ptp, 6) AS ptp, round(ll.line_length, 6) AS line_length, y_mid AS y FROM pooled p JOIN ll USING (base, k) JOIN lb USING (base, k)")
def window_features_simple_labelled(spark, d):
    out = fe.labelled_windows(fe.simple_features(framed(spark, d)), W, STEP, FS, _intervals(spark, d), _meta(spark, d).select("base"), "midpoint")
    return out.select("base", "k", F.round("t_mid", 6).alias("t_mid_s"), *r6("rms", "ptp", "line_length"), "y")


def _table(spark, d):
    f = fe.window_table(signal(spark, d), W, STEP, FS, SMALL_BANDS)
    return fe.labelled_windows(f, W, STEP, FS, _intervals(spark, d), _meta(spark, d))


@query(f"WITH {WT_SQL}, {META_SQL}, {TIMED_SQL} SELECT base, k, subject, acq, run, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, {_r('rms ptp line_length activity mobility complexity spectral_entropy')}, round(lo.power, 9) AS bp_low, round(hi.power, 9) AS bp_high, y FROM wm JOIN we USING (base, k) JOIN (SELECT * FROM wb WHERE b = 'low') lo USING (base, k) JOIN (SELECT * FROM wb WHERE b = 'high') hi USING (base, k) JOIN lb USING (base, k) JOIN meta USING (base)")
def window_features_labelled(spark, d):
    return _table(spark, d).select("base", "k", "subject", "acq", "run", *r6("t_start", "t_end", "rms", "ptp", "line_length", "activity", "mobility", "complexity", "spectral_entropy"), *(F.round(c, 9).alias(c) for c in ("bp_low", "bp_high")), "y")


@query(f"WITH {FRAMED_SQL}, {META_SQL}, {TIMED_SQL} SELECT base, count(*) AS n_windows, 11 AS n_features, count(*) FILTER (y = 1) AS y_pos, count(*) FILTER (y = 0) AS y_neg, round(avg(y), 6) AS positive_rate FROM lb GROUP BY 1")
def windowing_info(spark, d):
    return fe.windowing_info(_table(spark, d)).withColumn("positive_rate", F.round("positive_rate", 6))


@query(f"WITH {LONG_SQL}, e AS (SELECT base, ch, i - 24 AS i, x FROM long WHERE i >= 24 AND i < 40) SELECT base, ch, round(sqrt(avg(x * x)), 6) AS rms, min(i) AS first_i, max(i) AS last_i FROM e GROUP BY ALL")
def excerpt_rms(spark, d):
    e = wi.excerpt(long(spark, d), FS, 1.0)
    return e.groupBy("base", "ch").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query(f"WITH {LONG_SQL}, o AS (SELECT label AS base, CASE WHEN label % 5 = 1 THEN NULL WHEN label % 5 = 2 THEN -1.0 WHEN label % 5 = 3 THEN 3.5 ELSE 0.77 * (label % 4) END AS onset_s FROM embeddings WHERE label % 5 <> 0 GROUP BY ALL), b AS (SELECT base, ceil(t0 * {FS})::BIGINT AS a, floor((t0 + 1) * {FS})::BIGINT AS z FROM (SELECT DISTINCT base, greatest(coalesce(onset_s, 0), 0) AS t0 FROM long LEFT JOIN o USING (base))) SELECT base, ch, round(sqrt(avg(x * x)), 6) AS rms, min(i - a) AS first_i, max(i - a) AS last_i FROM long JOIN b USING (base) WHERE i >= a AND i <= z GROUP BY ALL")
def excerpt_from_onset(spark, d):
    """Runs without onset or without a row, with an onset before their start, near their end, or inside."""
    k = F.col("base") % 5
    at = F.when(k == 1, F.lit(None).cast("double")).when(k == 2, -1.0).when(k == 3, 3.5).otherwise(F.lit(0.77) * (F.col("base") % 4))
    onsets = signal(spark, d).select("base").distinct().where(k != 0).select("base", at.alias("onset_s"))
    e = wi.excerpt(long(spark, d), FS, 1.0, onsets)
    return e.groupBy("base", "ch").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query(f"WITH {LONG_SQL}, b AS (SELECT label AS base, 0.25 * (label % 4) AS t_min, 2.0 + 0.25 * (label % 4) AS t_max FROM embeddings GROUP BY ALL), c AS (SELECT base, ch, i - ceil(t_min * {FS})::BIGINT AS i, x FROM long JOIN b USING (base) WHERE i >= ceil(t_min * {FS}) AND i <= t_max * {FS}) SELECT base, count(*) AS n, min(i) AS first_i, max(i) AS last_i, round(sum(x), 6) + 0.0 AS total FROM c GROUP BY 1")
def crop_samples(spark, d):
    lo = F.lit(0.25) * (F.col("base") % 4)
    b = signal(spark, d).select("base").distinct().select("base", lo.alias("t_min"), (lo + 2.0).alias("t_max"))
    return wi.crop_samples(long(spark, d), b, FS).groupBy("base").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.round(F.sum("x"), 6).alias("total"))


Z_SQL = FRAMED_SQL + """, med AS (SELECT base, median(rms) AS m1, median(ptp) AS m2, median(line_length) AS m3 FROM pooled GROUP BY 1),
mad AS (SELECT p.base, median(abs(rms - m1)) AS a1, median(abs(ptp - m2)) AS a2, median(abs(line_length - m3)) AS a3 FROM pooled p JOIN med USING (base) GROUP BY 1),
outl AS (SELECT base, k, rms, ptp, line_length, greatest(abs(0.6745 * (rms - m1) / (a1 + 1e-12)), abs(0.6745 * (ptp - m2) / (a2 + 1e-12)), abs(0.6745 * (line_length - m3) / (a3 + 1e-12))) AS outlier_score FROM pooled JOIN med USING (base) JOIN mad USING (base))"""


@query(f"WITH {Z_SQL} SELECT base, k, round(k * {STEP} / {FS}, 6)::DOUBLE AS t_start, round((k * {STEP} + {W}) / {FS}, 6)::DOUBLE AS t_end, {_r('rms ptp line_length outlier_score')}, outlier_score >= 2 AS is_outlier FROM outl")
def window_features_qc(spark, d):
    out = fe.outlier_windows(fe.pooled_features(framed(spark, d)), limit=2.0)
    t0, t1 = F.col("k") * STEP / F.lit(FS), (F.col("k") * STEP + W) / F.lit(FS)
    return out.select("base", "k", F.round(t0, 6).alias("t_start"), F.round(t1, 6).alias("t_end"), *r6("rms", "ptp", "line_length", "outlier_score"), "is_outlier")


@query(f"WITH {FRAMED_SQL} SELECT base, ch, k, {_r('activity mobility complexity')} FROM chan")
def hjorth(spark, d):
    return fe.channel_features(framed(spark, d)).select("base", "ch", "k", *r6("activity", "mobility", "complexity"))


@query(f"WITH {FRAMED_SQL} SELECT base, ch, k, {_r('line_length')} FROM chan")
def line_length(spark, d):
    return fe.channel_features(framed(spark, d)).select("base", "ch", "k", *r6("line_length"))


@query(f"WITH {FRAMED_SQL} SELECT base, k, round(({W - 1} / 2.0 + k * {STEP}) / {FS}, 6)::DOUBLE AS t_mid, round(avg(rms), 6) AS rms FROM chan GROUP BY base, k")
def feature_trajectory(spark, d):
    c = fe.channel_features(framed(spark, d)).groupBy("base", "k").agg(F.avg("rms").alias("rms"))
    return c.select("base", "k", F.round((F.lit((W - 1) / 2) + F.col("k") * STEP) / FS, 6).alias("t_mid"), *r6("rms"))


@query(f"WITH {PSD_SQL} SELECT base, ch, bin, f, round(p, 9) AS p FROM psd")
def psd(spark, d):
    return fe.spectra(signal(spark, d), FS, NPERSEG).withColumn("p", F.round("p", 9))


def _chunks(spark, d) -> DataFrame:
    """Every channel cut in seven chunks of ten samples."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.slice("xs", k * 10 + 1, 10))
    return signal(spark, d).select("base", "ch", F.posexplode(cut).alias("k", "xs")).select("base", "ch", (F.col("k") * 10).alias("i0"), "xs")


@query(f"WITH {PSD_SQL} SELECT base, ch, bin, f, round(p, 9) AS p FROM psd")
def psd_of_chunks(spark, d):
    p = ar.chunk_spectra(_chunks(spark, d), FS, NPERSEG, {}, size=32)
    return p.select("base", "ch", F.posexplode("p").alias("bin", "p"), "freqs").select("base", "ch", "bin", F.get("freqs", F.col("bin")).alias("f"), F.round("p", 9).alias("p"))


@query(f"WITH {FRAMED_SQL} SELECT base, ch, k, {_r('rms ptp line_length activity mobility complexity')} FROM chan")
def window_features_of_chunks(spark, d):
    c = fe.channel_features(ar.chunk_window_sums(_chunks(spark, d), W, STEP, size=24))
    return c.select("base", "ch", "k", *r6("rms", "ptp", "line_length", "activity", "mobility", "complexity"))


@query(f"WITH {PSD_SQL} SELECT base, ch, band, round(power, 9) AS power FROM band")
def bandpower(spark, d):
    return fe.band_power(signal(spark, d), FS, NPERSEG, SMALL_BANDS).withColumn("power", F.round("power", 9))


@query(f"WITH {PSD_SQL} SELECT base, ch, round(entropy, 6) AS entropy FROM ent")
def spectral_entropy(spark, d):
    return fe.spectral_entropy(signal(spark, d), FS, NPERSEG).withColumn("entropy", F.round("entropy", 6))


@query(f"WITH {PSD_SQL}, hd AS (SELECT *, x - lag(x) OVER (PARTITION BY base, ch ORDER BY i) AS d1 FROM long), hd2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY base, ch ORDER BY i) AS d2 FROM hd), hc AS (SELECT base, ch, sqrt(avg(x * x)) AS rms, max(x) - min(x) AS ptp, var_pop(x) + 1e-12 AS v0, var_pop(d1) + 1e-12 AS v1, var_pop(d2) + 1e-12 AS v2 FROM hd2 GROUP BY ALL), hs AS (SELECT base, count(*) AS n_picks, round(avg(rms), 6) AS rms_mean, round(avg(ptp), 6) AS ptp_mean, round(avg(v0), 6) AS activity_mean, round(avg(sqrt(v1 / v0)), 6) AS mobility_mean, round(avg(sqrt(v2 / v1) / (sqrt(v1 / v0) + 1e-12)), 6) AS complexity_mean FROM hc GROUP BY 1) SELECT hs.*, round((SELECT avg(entropy) FROM ent WHERE ent.base = hs.base), 6) AS spectral_entropy_mean, round((SELECT avg(power) FROM band WHERE band.base = hs.base AND band = 'low'), 6) AS bp_mean_low, round((SELECT avg(power) FROM band WHERE band.base = hs.base AND band = 'high'), 6) AS bp_mean_high FROM hs")
def heavy_summary(spark, d):
    out = fe.heavy_summary(signal(spark, d), FS, NPERSEG, SMALL_BANDS)
    return out.select("base", "n_picks", *r6(*(c for c in out.columns if c not in ("base", "n_picks"))))


#: Spectra of whole arrays as of signals at 128 Hz, where the bands of the domain have frequencies.
FAST, WHOLE = 128.0, 64
FAST_SQL = LONG_SQL + f""", dif AS (SELECT *, x - lag(x) OVER w AS d1 FROM long WINDOW w AS (PARTITION BY base, ch ORDER BY i)),
dif2 AS (SELECT *, d1 - lag(d1) OVER w AS d2 FROM dif WINDOW w AS (PARTITION BY base, ch ORDER BY i)),
cs AS (SELECT base, ch, sqrt(avg(x * x)) AS rms, max(x) - min(x) AS ptp, sum(abs(d1)) AS line_length, var_pop(x) + 1e-12 AS v0, var_pop(d1) + 1e-12 AS v1, var_pop(d2) + 1e-12 AS v2 FROM dif2 GROUP BY ALL),
cf AS (SELECT base, ch, rms, ptp, line_length, v0 AS activity, sqrt(v1 / v0) AS mobility, sqrt(v2 / v1) / (sqrt(v1 / v0) + 1e-12) AS complexity FROM cs),
tap AS (SELECT base, ch, i AS j, (x - avg(x) OVER (PARTITION BY base, ch)) * (0.5 - 0.5 * cos(2 * pi() * i / {WHOLE})) AS y FROM long),
psd AS (SELECT base, ch, bin * {FAST} / {WHOLE} AS f, (sum(y * cos(2 * pi() * ((bin * j) % {WHOLE}) / {WHOLE})) ^ 2 + sum(y * sin(2 * pi() * ((bin * j) % {WHOLE}) / {WHOLE})) ^ 2) * (CASE WHEN bin IN (0, {WHOLE // 2}) THEN 1.0 ELSE 2.0 END) / ({FAST} * {WHOLE * 0.375}) AS p FROM tap, (SELECT unnest(range(0, {WHOLE // 2 + 1})) AS bin) GROUP BY base, ch, bin),
ent AS (SELECT base, ch, -sum(s * ln(s + 1e-12)) AS entropy FROM (SELECT base, ch, p / (sum(p) OVER (PARTITION BY base, ch) + 1e-12) AS s FROM psd) GROUP BY ALL)"""


def _band_sql(name: str, lo: float, hi: float) -> str:
    return f"(SELECT base, ch, sum(area) AS {name} FROM (SELECT base, ch, (p + lead(p) OVER w) / 2 * (lead(f) OVER w - f) AS area FROM psd WHERE f >= {lo} AND f <= {hi} WINDOW w AS (PARTITION BY base, ch ORDER BY f)) GROUP BY ALL) b_{name} USING (base, ch)"


_WB = {f"bp_{n}": b for n, b in fe.WINDOW_BANDS.items()}


@query(f"WITH {FAST_SQL}, m AS (SELECT base, {', '.join(f'avg({n}) AS {n}' for n in 'rms ptp line_length activity mobility complexity'.split())} FROM cf GROUP BY 1), one AS (SELECT base, min(ch) AS ch FROM long GROUP BY 1) SELECT base, 0::BIGINT AS k, {_r('rms ptp line_length activity mobility complexity')}, round(entropy, 6) AS spectral_entropy, {', '.join(f'round({n}, 9) AS {n}' for n in _WB)} FROM m JOIN one USING (base) JOIN ent USING (base, ch) {' '.join('JOIN ' + _band_sql(n, *b) for n, b in _WB.items())}")
def window_table_bands(spark, d):
    """The window table with its own five bands."""
    out = fe.window_table(signal(spark, d), WHOLE, WHOLE, FAST)
    return out.select("base", "k", *r6("rms", "ptp", "line_length", "activity", "mobility", "complexity", "spectral_entropy"), *(F.round(c, 9).alias(c) for c in _WB))


_RB = {f"bp_mean_{n}": b for n, b in fe.BANDS.items() if n != "high_gamma"}


@query(f"WITH {FAST_SQL}, {META_SQL}, r AS (SELECT base, subject, acq, run, 3.0 AS duration_s FROM meta), s AS (SELECT base, count(*) AS n_picks, {', '.join(f'round(avg({n}), 6) AS {n}_mean' for n in 'rms ptp activity mobility complexity'.split())}, round(avg(entropy), 6) AS spectral_entropy_mean, {', '.join(f'round(avg({n}), 9) AS {n}' for n in _RB)}, NULL::DOUBLE AS bp_mean_high_gamma FROM cf JOIN ent USING (base, ch) {' '.join('JOIN ' + _band_sql(n, *b) for n, b in _RB.items())} GROUP BY 1) SELECT r.base, subject, acq, run, {FAST}::DOUBLE AS sfreq, n_picks + 1 AS n_total_channels, duration_s::DOUBLE AS duration_s, greatest(0, coalesce(onset_s - 0.25, 0))::DOUBLE AS segment_tmin, CASE WHEN iv.base IS NULL THEN 1.0 ELSE least(offset_s + 0.5, duration_s) END::DOUBLE AS segment_tmax, iv.base IS NOT NULL AS has_onset_offset, s.* EXCLUDE (base) FROM r LEFT JOIN iv USING (base) JOIN s USING (base)")
def run_signal_summary(spark, d):
    """The run-level table of 22 columns and its base; at 128 Hz the highest band has no frequency."""
    arrays = signal(spark, d)
    n = arrays.groupBy("base").agg((F.count("*") + 1).alias("n_total_channels"))
    runs = _meta(spark, d).join(n, "base").withColumn("sfreq", F.lit(FAST)).withColumn("duration_s", F.lit(3.0))
    pairs = _intervals(spark, d)
    out = fe.signal_summary(runs, fe.heavy_summary(arrays, FAST, WHOLE), wi.crop_bounds(runs, pairs, 0.25, 0.5, 1.0), pairs)
    means = [c for c in out.columns if c.endswith("_mean")]
    return out.select("base", "subject", "acq", "run", "sfreq", "n_total_channels", "duration_s", "segment_tmin", "segment_tmax", "has_onset_offset", "n_picks", *r6(*means), *(F.round(c, 9).alias(c) for c in (*_RB, "bp_mean_high_gamma")))


@query(f"WITH {LONG_SQL}, c AS (SELECT base, ch, sqrt(avg(x * x)) AS rms, max(x) - min(x) AS ptp FROM long GROUP BY ALL), med AS (SELECT base, median(rms) AS m1, median(ptp) AS m2 FROM c GROUP BY 1), mad AS (SELECT base, median(abs(rms - m1)) AS a1, median(abs(ptp - m2)) AS a2 FROM c JOIN med USING (base) GROUP BY 1) SELECT base, ch, round(0.6745 * (ptp - m2) / (a2 + 1e-12), 4) AS z_ptp FROM c JOIN med USING (base) JOIN mad USING (base) WHERE abs(0.6745 * (ptp - m2) / (a2 + 1e-12)) > 2")
def robust_z_channels(spark, d):
    c = long(spark, d).groupBy("base", "ch").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (F.max("x") - F.min("x")).alias("ptp"))
    return fe.with_robust_z(c, ["ptp"]).where(F.abs("z_ptp") > 2).select("base", "ch", F.round("z_ptp", 4).alias("z_ptp"))


@query(f"WITH {LONG_SQL}, c AS (SELECT base, ch, sqrt(avg(x * x)) AS rms, max(x) - min(x) AS ptp FROM long GROUP BY ALL), med AS (SELECT base, median(rms) AS m1, median(ptp) AS m2 FROM c GROUP BY 1), mad AS (SELECT base, median(abs(rms - m1)) AS a1, median(abs(ptp - m2)) AS a2 FROM c JOIN med USING (base) GROUP BY 1) SELECT base, ch, round(rms, 6) AS rms, round(ptp, 6) AS ptp FROM c JOIN med USING (base) JOIN mad USING (base) WHERE abs(0.6745 * (rms - m1) / (a1 + 1e-12)) > 2 OR abs(0.6745 * (ptp - m2) / (a2 + 1e-12)) > 2")
def suspicious_channels(spark, d):
    c = long(spark, d).groupBy("base", "ch").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (F.max("x") - F.min("x")).alias("ptp"))
    return fe.suspicious_channels(c, 2.0).select("base", "ch", *r6("rms", "ptp"))


OUT_SQL = "med AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1), mad AS (SELECT user_id, median(abs(value - m)) AS a FROM events JOIN med USING (user_id) GROUP BY 1), z AS (SELECT user_id AS base, event_id, abs(0.6745 * (value - m) / (a + 1e-12)) AS outlier_score FROM events JOIN med USING (user_id) JOIN mad USING (user_id))"


def _outliers(spark, d):
    return fe.outlier_windows(t(spark, d, "events").select(F.col("user_id").alias("base"), "event_id", "value"), ("value",))


@query(f"WITH {OUT_SQL} SELECT base, event_id, round(outlier_score, 4) AS outlier_score FROM z WHERE outlier_score >= 6")
def outlier_windows(spark, d):
    return _outliers(spark, d).where("is_outlier").select("base", "event_id", F.round("outlier_score", 4).alias("outlier_score"))


@query(f"WITH {OUT_SQL} SELECT base, event_id, round(outlier_score, 4) AS outlier_score FROM z WHERE outlier_score >= 6")
def outlier_windows_of_large_runs(spark, d):
    z = fe.outlier_windows(t(spark, d, "events").select(F.col("user_id").alias("base"), "event_id", "value"), ("value",), split=True)
    return z.where("is_outlier").select("base", "event_id", F.round("outlier_score", 4).alias("outlier_score"))


@query("SELECT event_type, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for q, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))) + " FROM events GROUP BY 1")
def value_percentiles_by_type(spark, d):
    p = gr.group_percentiles(t(spark, d, "events"), ["event_type"], ["value"], (0.05, 0.5, 0.95), accuracy=1000)
    return p.select("event_type", F.col("rows").alias("n"), *(F.round(F.get("value", F.lit(i)), 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))))


@query(f"WITH {OUT_SQL} SELECT base, round(avg((outlier_score >= 6)::INT), 6) AS outlier_rate FROM z GROUP BY 1")
def outlier_rate(spark, d):
    return _outliers(spark, d).groupBy("base").agg(F.round(F.avg(F.col("is_outlier").cast("double")), 6).alias("outlier_rate"))


# --- files, written from the tables and read back ---------------------------------------------------------------------
def _recordings(spark: SparkSession, d: str, *kinds: str) -> str:
    """A folder with files of these kinds, a run for each event type and day: tables with their columns in either order
    and unknown values, tables without a needed column, sidecars and headers that are broken, signals of two sizes."""
    e = t(spark, d, "events").withColumn("day", F.date_format("ts", "yyyyMMdd")).withColumn("even", F.dayofmonth("ts") % 2 == 0).withColumn("first", F.dayofmonth("ts") == 1)
    onset = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", onset.alias("onset"))))
    users = F.array_sort(F.collect_set("user_id"))
    runs = e.groupBy("event_type", "day", "even", "first").agg(rows.alias("rows"), users.alias("users"))
    line = lambda *cells: F.concat_ws("\t", *cells)
    table = lambda head, lines: F.concat_ws("\n", F.array(F.lit(head)), lines)
    kind = F.col("event_type")
    two = F.when(kind == "view", table("onset\tduration", F.transform("rows", lambda r: line(r["onset"], F.lit("0")))))
    two = two.when(F.col("even"), table("onset\tduration\ttrial_type", F.transform("rows", lambda r: line(r["onset"], F.lit("0"), kind))))
    of = {
        "events": two.otherwise(table("trial_type\tonset", F.transform("rows", lambda r: line(kind, r["onset"])))),
        "channels": table("name\tstatus\ttype", F.transform("users", lambda u: line(F.concat(F.lit("U"), u.cast("string")), F.when(u % 5 == 0, "bad").otherwise("good"), F.lit("n/a")))),
        "json": F.when(kind == "click", "{no json").otherwise(F.format_string('{"SamplingFrequency": %d}', F.size("rows"))),
        "vhdr": F.when(kind == "error", "broken").otherwise("x\n[Common Infos]\n"),
        "eeg": F.repeat(F.lit("0"), F.when(F.col("first"), 1_048_577).otherwise(9)),
    }
    base = F.format_string("sub-%s/ses-%s/sub-%s_ses-%s_task-t_acq-a_run-01_ieeg", kind, "day", kind, "day")
    texts = runs.select(F.explode(F.array(*(F.struct(files.sibling(base, k).alias("path"), of[k].alias("value")) for k in kinds))).alias("f")).select("f.*")
    root = f"{shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    files.write_texts(texts, root)
    return root


def _run(df: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("base", rf"_?{k}-([^_/]+)_[^/]*$", 1)
    return df.withColumns({"event_type": part("sub"), "day": part("ses")}).drop("base")


RUN_SQL = "e AS (SELECT *, strftime(ts, '%Y%m%d') AS day, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) - 1 AS row_idx FROM events)"


@query(f"WITH {RUN_SQL} SELECT event_type, day, row_idx, CASE WHEN event_id % 7 <> 0 THEN user_id::VARCHAR END AS onset, event_type AS trial_type FROM e WHERE event_type <> 'view'")
def events_from_files(spark, d):
    return _run(files.events_from_tsv(files.read_tsv(spark, _recordings(spark, d, "events"))))


@query(f"WITH {RUN_SQL} SELECT event_type, day, 'U' || user_id AS name, CASE WHEN user_id % 5 = 0 THEN 'bad' ELSE 'good' END AS status, row_number() OVER (PARTITION BY event_type, day ORDER BY user_id) - 1 AS ch_idx FROM (SELECT DISTINCT event_type, day, user_id FROM e)")
def channels_from_files(spark, d):
    read = files.channels_from_tsv(files.read_tsv(spark, _recordings(spark, d, "channels"), "*_channels.tsv"))
    return _run(read.where("type is null and sampling_frequency is null").select("base", "name", "status", F.col("ch_idx").cast("long").alias("ch_idx")))


@query(f"WITH {RUN_SQL} SELECT event_type, day, CASE WHEN event_type <> 'click' THEN count(*)::DOUBLE END AS sfreq FROM e GROUP BY event_type, day")
def sidecars_from_files(spark, d):
    raw = files.read_json(spark, _recordings(spark, d, "json"))
    return _run(raw.select("base", json_first_number("raw", ["SamplingFrequency"]).alias("sfreq")))


@query(f"WITH {RUN_SQL} SELECT DISTINCT event_type, day, event_type <> 'error' AS is_valid FROM e")
def headers_from_files(spark, d):
    return _run(files.valid_headers(spark, _recordings(spark, d, "vhdr")))


@query(f"WITH {RUN_SQL} SELECT DISTINCT event_type, day, day(ts) = 1 AS eeg_present, 3::BIGINT AS n_kinds FROM e")
def listed_files(spark, d):
    found = files.list_files(spark, _recordings(spark, d, "events", "eeg", "json"))
    kinds = found.groupBy("base").agg(F.count_distinct("kind").alias("n_kinds"))
    return _run(files.content_present(found).join(kinds, "base"))


# --- timeline -------------------------------------------------------------------------------------------------------
def _dense(table: str, ts: str, unit: str) -> str:
    return f"n AS (SELECT date_trunc('{unit}', {ts})::TIMESTAMP AS bucket, count(*) AS runs FROM {table} GROUP BY 1), spine AS (SELECT unnest(generate_series((SELECT min(bucket) FROM n), (SELECT max(bucket) FROM n), INTERVAL 1 {unit})) AS bucket), s AS (SELECT bucket, coalesce(runs, 0) AS runs, row_number() OVER (ORDER BY bucket) - 1 AS i FROM spine LEFT JOIN n USING (bucket))"


HOURLY, DAILY = _dense("events", "ts", "hour"), _dense("orders", "o_orderdate", "day")


def _hourly(spark, d):
    return tl.resample(t(spark, d, "events"), "hour")


def _daily(spark, d):
    return tl.resample(t(spark, d, "orders"), "day", "o_orderdate")


@query(f"WITH {HOURLY} SELECT bucket, runs FROM s")
def resample_hourly(spark, d):
    return _hourly(spark, d)


@query(f"WITH {DAILY} SELECT bucket, runs FROM s")
def resample_daily(spark, d):
    return _daily(spark, d)


@query(f"WITH {DAILY} SELECT bucket, runs, round(avg(runs) OVER w, 6) AS roll_mean, round(stddev_samp(runs) OVER w, 6) AS roll_std FROM s WINDOW w AS (ORDER BY bucket ROWS 6 PRECEDING)")
def rolling_stats(spark, d):
    return tl.rolling_stats(_daily(spark, d)).select("bucket", "runs", *r6("roll_mean", "roll_std"))


@query(f"WITH {DAILY} SELECT bucket, runs, round(avg(runs) OVER w, 6) AS roll_mean, round(stddev_samp(runs) OVER w, 6) AS roll_std FROM s WINDOW w AS (ORDER BY bucket ROWS 6 PRECEDING)")
def rolling_stats_in_blocks(spark, d):
    return tl.rolling_stats(_daily(spark, d), per_block=5).select("bucket", "runs", *r6("roll_mean", "roll_std"))


@query(f"WITH {DAILY}, w AS (SELECT bucket, runs, count(*) OVER w AS c, avg(runs) OVER w AS m, stddev_samp(runs) OVER w AS sd FROM s WINDOW w AS (ORDER BY bucket ROWS 13 PRECEDING)) SELECT bucket, runs, round((runs - m) / sd, 6) AS z FROM w WHERE c >= 7 AND sd > 0 AND abs((runs - m) / sd) > 2.5")
def spike_days(spark, d):
    return tl.spikes(_daily(spark, d), limit=2.5).where("is_spike").select("bucket", "runs", *r6("z"))


@query(f"WITH {DAILY}, w AS (SELECT bucket, runs, count(*) OVER w AS c, avg(runs) OVER w AS m, stddev_samp(runs) OVER w AS sd FROM s WINDOW w AS (ORDER BY bucket ROWS 13 PRECEDING)) SELECT bucket, runs, round((runs - m) / sd, 6) AS z FROM w WHERE c >= 7 AND sd > 0 AND abs((runs - m) / sd) > 2.5")
def spike_days_in_blocks(spark, d):
    return tl.spikes(_daily(spark, d), limit=2.5, per_block=5).where("is_spike").select("bucket", "runs", *r6("z"))


@query(f"WITH {DAILY} SELECT count(*) AS n, round(regr_slope(runs, i), 9) AS slope, round(regr_intercept(runs, i), 6) AS intercept FROM s")
def linear_trend(spark, d):
    return tl.linear_trend(_daily(spark, d)).select("n", F.round("slope", 9).alias("slope"), *r6("intercept"))


@query(f"WITH {DAILY} SELECT count(*) AS n, round(regr_slope(runs, i), 9) AS slope, round(regr_intercept(runs, i), 6) AS intercept FROM s")
def linear_trend_in_blocks(spark, d):
    return tl.linear_trend(_daily(spark, d), per_block=5).select("n", F.round("slope", 9).alias("slope"), *r6("intercept"))


@query(f"WITH {DAILY} SELECT date_trunc('month', bucket)::TIMESTAMP AS month, round(avg(runs), 6) AS mean_runs, median(runs) AS median_runs, sum(runs)::BIGINT AS sum_runs FROM s GROUP BY 1")
def monthly_rollup(spark, d):
    return tl.monthly(_daily(spark, d)).withColumn("mean_runs", F.round("mean_runs", 6))


GAP_SQL = "g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS us FROM events), h AS (SELECT us / 3600000000.0 AS gap_h FROM g WHERE us IS NOT NULL)"


@query(f"WITH {GAP_SQL} SELECT count(*) AS n, round(avg(gap_h), 6) AS mean, round(stddev_samp(gap_h), 6) AS std, round(min(gap_h), 6) AS min, round(max(gap_h), 6) AS max, {', '.join(f'round(quantile_cont(gap_h, {q}), 6) AS {n}' for n, q in (('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99)))}, round((SELECT avg(least(gap_h, (SELECT quantile_cont(gap_h, 0.99) FROM h))) FROM h), 6) AS mean_clipped FROM h")
def gap_profile(spark, d):
    p = tl.gap_profile(tl.gaps(t(spark, d, "events"), "user_id"))
    return p.select("n", *r6(*(c for c in p.columns if c != "n")))


@query()
def robust_seasonal_hourly(spark, d):
    return stl.robust_seasonal(_hourly(spark, d), 24).select("bucket", "runs", *r6("trend", "season", "resid", "weight"))


@query("SELECT h AS hour, (SELECT count(*) FROM events WHERE hour(ts) = h) AS runs FROM (SELECT unnest(range(0, 24)) AS h)")
def hour_of_day(spark, d):
    return tl.by_hour(t(spark, d, "events"))


@query("SELECT h AS weekday, (SELECT count(*) FROM orders WHERE isodow(o_orderdate) - 1 = h) AS runs FROM (SELECT unnest(range(0, 7)) AS h)")
def weekday_counts(spark, d):
    return tl.by_weekday(t(spark, d, "orders"), "o_orderdate")


@query("SELECT year(o_orderdate) AS year, count(*) AS runs, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY 1")
def year_counts(spark, d):
    return tl.by_year(t(spark, d, "orders"), "o_orderdate")


@query(f"WITH {HOURLY}, h AS (SELECT hour(bucket) AS hour, runs FROM s), q AS (SELECT hour, quantile_cont(runs, 0.25) AS q1, quantile_cont(runs, 0.5) AS median, quantile_cont(runs, 0.75) AS q3 FROM h GROUP BY 1) SELECT hour, q1, median, q3, min(runs) FILTER (runs >= q1 - 1.5 * (q3 - q1)) AS low, max(runs) FILTER (runs <= q3 + 1.5 * (q3 - q1)) AS high FROM h JOIN q USING (hour) GROUP BY ALL")
def hour_box(spark, d):
    return tl.hour_box(_hourly(spark, d))


@query("SELECT user_id, h AS hour, count(ts) AS runs FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(0, 24)) AS h) LEFT JOIN events e USING (user_id) GROUP BY 1, 2 HAVING false UNION ALL SELECT u.user_id, h, coalesce(c, 0) FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(0, 24)) AS h) LEFT JOIN (SELECT user_id, hour(ts) AS h2, count(*) AS c FROM events GROUP BY ALL) x ON x.user_id = u.user_id AND x.h2 = h")
def subject_hour_profile(spark, d):
    return tl.by_hour(t(spark, d, "events"), keys=("user_id",))


TYPED = "n AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS runs FROM events GROUP BY ALL), ends AS (SELECT event_type, min(bucket) AS a, max(bucket) AS b FROM n GROUP BY 1), spine AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 hour)) AS bucket FROM ends), s AS (SELECT event_type, bucket, coalesce(runs, 0) AS runs, row_number() OVER (PARTITION BY event_type ORDER BY bucket) - 1 AS i FROM spine LEFT JOIN n USING (event_type, bucket))"
ACF_SQL = TYPED + ", m AS (SELECT event_type, avg(runs) AS mean FROM s GROUP BY 1), dv AS (SELECT event_type, i, runs - mean AS d FROM s JOIN m USING (event_type)), c AS (SELECT a.event_type, b.i - a.i AS lag, sum(a.d * b.d) AS c FROM dv a JOIN dv b ON a.event_type = b.event_type AND b.i BETWEEN a.i AND a.i + 168 GROUP BY ALL)"


def _typed(spark, d):
    return tl.resample(t(spark, d, "events"), "hour", keys=("event_type",))


@query(f"WITH {ACF_SQL} SELECT event_type, lag, round(c / (SELECT z.c FROM c z WHERE z.event_type = c.event_type AND z.lag = 0), 6) AS acf FROM c")
def acf(spark, d):
    return tl.autocorrelation(_typed(spark, d), keys=("event_type",)).withColumn("acf", F.round("acf", 6))


PACF_SQL = ACF_SQL.replace("WITH ", "") + """, rho AS (SELECT c.event_type, c.lag, c.c / z.c AS r FROM c JOIN c z ON z.event_type = c.event_type AND z.lag = 0),
rr AS (SELECT event_type, list(r ORDER BY lag) AS r FROM rho GROUP BY 1),
lev(event_type, r, k, phi, err, a) AS (SELECT event_type, r, 0, []::DOUBLE[], 1.0::DOUBLE, 1.0::DOUBLE FROM rr
UNION ALL SELECT event_type, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - b * phi[k + 1 - i]), b), err * (1 - b * b), b
  FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i])), 0)) / err AS b FROM lev WHERE k + 1 < len(r)))"""


@query(f"WITH RECURSIVE {PACF_SQL} SELECT event_type, k AS lag, round(a, 6) AS pacf FROM lev")
def pacf(spark, d):
    p = tl.partial_autocorrelation(tl.autocorrelation(_typed(spark, d), keys=("event_type",)), "event_type")
    return p.withColumn("pacf", F.round("pacf", 6))


SEASON_SQL = TYPED + """, tr AS (SELECT *, i % 24 AS phase, CASE WHEN count(*) OVER w = 25 THEN (sum(runs) OVER w - (lag(runs, 12) OVER o + lead(runs, 12) OVER o) / 2) / 24 END AS trend FROM s WINDOW w AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), o AS (PARTITION BY event_type ORDER BY bucket)),
ph AS (SELECT event_type, phase, avg(runs - trend) AS raw FROM tr GROUP BY ALL), ce AS (SELECT event_type, avg(raw) AS centre FROM ph GROUP BY 1)"""


@query(f"WITH {SEASON_SQL} SELECT event_type, bucket, runs, phase, round(trend, 9) AS trend, round(raw - centre, 9) AS season, round(runs - trend - (raw - centre), 9) AS resid FROM tr JOIN ph USING (event_type, phase) JOIN ce USING (event_type)")
def seasonal_classical(spark, d):
    s = tl.seasonal(_typed(spark, d), 24, ("event_type",))
    return s.select("event_type", "bucket", "runs", "phase", *(F.round(c, 9).alias(c) for c in ("trend", "season", "resid")))


@query(f"WITH {SEASON_SQL} SELECT event_type, bucket, runs, phase, round(trend, 9) AS trend, round(raw - centre, 9) AS season, round(runs - trend - (raw - centre), 9) AS resid FROM tr JOIN ph USING (event_type, phase) JOIN ce USING (event_type)")
def seasonal_in_blocks(spark, d):
    s = tl.seasonal(_typed(spark, d), 24, ("event_type",), per_block=50)
    return s.select("event_type", "bucket", "runs", "phase", *(F.round(c, 9).alias(c) for c in ("trend", "season", "resid")))


@query(f"WITH {TYPED} SELECT event_type, count(*) AS buckets, round(avg((runs > 0)::INT), 6) AS active_share, count(*) FILTER (runs >= 4) AS bursts FROM s GROUP BY 1")
def sparsity(spark, d):
    return tl.sparsity(_typed(spark, d), ("event_type",), 4).withColumn("active_share", F.round("active_share", 6))


# --- profiles -------------------------------------------------------------------------------------------------------
@query("SELECT 'c_custkey' AS \"column\", 0.0::DOUBLE AS missing_pct UNION ALL SELECT 'rich', round(count(*) FILTER (c_acctbal <= 5000) * 100.0 / count(*), 6)::DOUBLE FROM customer")
def missing_by_column(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("rich"))
    return pr.missing_by_column(c).withColumn("missing_pct", F.round("missing_pct", 6))


@query("SELECT c_mktsegment, round(avg((c_acctbal <= 5000)::INT) * 100, 6) AS missing_pct, count(*) AS rows FROM customer GROUP BY 1")
def missing_by_group(spark, d):
    c = t(spark, d, "customer").withColumn("rich", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")))
    return pr.missing_by_group(c, "c_mktsegment", "rich").withColumn("missing_pct", F.round("missing_pct", 6))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS is_duplicate FROM orders")
def duplicates(spark, d):
    return pr.duplicate_rows(t(spark, d, "orders"), ["o_custkey", "o_orderdate"]).select("o_orderkey", "is_duplicate")


@query("SELECT coalesce(CASE WHEN c_nationkey <> 3 THEN c_nationkey END::VARCHAR, '<NA>') AS value, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_counts(spark, d):
    return pr.value_counts(t(spark, d, "customer").withColumn("n", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))), "n")


@query("SELECT round(l_discount, 6) AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def rounded_counts(spark, d):
    return pr.rounded_counts(t(spark, d, "lineitem"), "l_discount")


@query("WITH e AS (SELECT min(o_totalprice) AS a, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders), n AS (SELECT least(floor((o_totalprice - a) / w), 29)::INT AS bin, count(*) AS c FROM orders, e GROUP BY 1) SELECT b AS bin, round(a + b * w, 6) AS lo, round(a + (b + 1) * w, 6) AS hi, coalesce(c, 0) AS count FROM e, (SELECT unnest(range(0, 30)) AS b) LEFT JOIN n ON n.bin = b")
def histogram(spark, d):
    return pr.histogram(t(spark, d, "orders"), "o_totalprice").select("bin", *r6("lo", "hi"), "count")


@query("SELECT 'o_totalprice' AS \"column\", count(*) AS count, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.75), 6) AS p75, max(o_totalprice) AS max FROM orders")
def profile_numbers(spark, d):
    return pr.numeric_profile(t(spark, d, "orders"), ["o_totalprice"]).withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("WITH l AS (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders), n AS (SELECT \"column\", value, count(*) AS n FROM l GROUP BY ALL) SELECT \"column\", sum(n)::BIGINT AS count, count(*) AS \"unique\", (SELECT value FROM n m WHERE m.\"column\" = n.\"column\" ORDER BY m.n DESC, value LIMIT 1) AS top, max(n) AS freq FROM n GROUP BY 1")
def profile_texts(spark, d):
    return pr.text_profile(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
