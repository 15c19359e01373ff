"""Free-text markers: classification by rule sets, pairing into intervals, quality flags, vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import to_number
from .scan import binned, carried


@dataclass(frozen=True)
class MarkerRules:
    """A marker is an offset where offset is found in it, else an onset where onset is found; case is ignored."""

    onset: str
    offset: str


# The two rule sets of the domain.
RULES_V2 = MarkerRules(
    onset=r"(?i)(?:\bonset\b|sz\s*onset|seizure\s*onset|\bsz\s*event\b|eeg\s*sz\s*(?:start|onset)|electrographic\s*(?:onset|ons\b))",
    offset=r"(?i)(?:\boffset\b|sz\s*offset|seizure\s*offset|electrographic\s*end|eeg\s*sz\s*end)",
)
RULES_V1 = MarkerRules(
    onset=r"(?i)(?:\bonset\b|sz\s*onset|seizure\s*onset|\bsz\s*event\b|eeg\s*sz)",
    offset=r"(?i)(?:\boffset\b|sz\s*offset|seizure\s*offset|electrographic\s*end)",
)


def is_onset(text: Column, rules: MarkerRules = RULES_V2) -> Column:
    return F.coalesce(text.rlike(rules.onset) & ~text.rlike(rules.offset), F.lit(False))


def is_offset(text: Column, rules: MarkerRules = RULES_V2) -> Column:
    return F.coalesce(text.rlike(rules.offset), F.lit(False))


def classify(events: DataFrame, rules: MarkerRules = RULES_V2) -> DataFrame:
    """events with is_onset and is_offset; null text is neither."""
    return events.withColumn("is_onset", is_onset(F.col("trial_type"), rules)).withColumn("is_offset", is_offset(F.col("trial_type"), rules))


def markers(events: DataFrame, rules: MarkerRules = RULES_V2) -> DataFrame:
    """(base, row_idx, t, trial_type, is_onset, is_offset) of classified rows whose onset is a number.

    events: base, row_idx, onset (text or number), trial_type.
    """
    t = to_number(F.col("onset")) if dict(events.dtypes)["onset"] == "string" else F.col("onset").cast("double")
    rows = classify(events.select("base", "row_idx", "trial_type", t.alias("t")), rules)
    return rows.where("(is_onset or is_offset) and t is not null").select("base", "row_idx", "t", "trial_type", "is_onset", "is_offset")


def pair_slots(found: DataFrame, rows_per_bin: int | None = None) -> DataFrame:
    """(base, place, onset_s, offset_s, onset_trial_type, offset_trial_type): pairs, onsets and offsets left alone.

    Each onset in order takes the first offset that is strictly later and not yet taken. With f(i) the number of
    offsets not later than onset i, the offset's place is i + max over k <= i of (f(k) - k). Onsets get that place,
    offsets their own, and rows of a run that share a place are a pair: running sums and a grouping over one
    shuffle by base, no loop and no join. File order decides ties.

    With rows_per_bin a run's markers are not sorted by one task but in bins of time: i and f start at the counts of the
    bins before, and the maximum at the greatest of theirs, which is that of their own plus f - k at their start.
    """
    if rows_per_bin:
        return _slots(_placed_in_bins(found, rows_per_bin))
    order = W.partitionBy("base").orderBy("t", "row_idx").rowsBetween(W.unboundedPreceding, 0)
    not_later = W.partitionBy("base").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    on, off = F.col("is_onset").cast("long"), F.col("is_offset").cast("long")
    s = found.withColumn("i", F.sum(on).over(order) - 1).withColumn("j", F.sum(off).over(order) - 1).withColumn("f", F.sum(off).over(not_later))
    place = F.when(F.col("is_onset"), F.col("i") + F.max(F.when(F.col("is_onset"), F.col("f") - F.col("i"))).over(order)).otherwise(F.col("j"))
    return _slots(s.withColumn("place", place))


def _placed_in_bins(found: DataFrame, rows: int) -> DataFrame:
    order = W.partitionBy("base", "bin").orderBy("t", "row_idx").rowsBetween(W.unboundedPreceding, 0)
    not_later = W.partitionBy("base", "bin").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    on, off = F.col("is_onset").cast("long"), F.col("is_offset").cast("long")
    s = binned(found, "t", rows).withColumn("i", F.sum(on).over(order) - 1).withColumn("f", F.sum(off).over(not_later)).withColumn("j", F.sum(off).over(order) - 1)
    sums = {"_on": F.sum(on), "_off": F.sum(off)}
    # The counts before a bin first; then the greatest lead before it, each lifted by what came before its own bin.
    s = carried(s, ["base"], sums, {"on0": F.sum("_on"), "off0": F.sum("_off")}).fillna(0, ["on0", "off0"])
    s = s.withColumn("i", F.col("i") + F.col("on0")).withColumn("j", F.col("j") + F.col("off0"))
    s = s.withColumn("lead", F.when(F.col("is_onset"), F.col("f") + F.col("off0") - F.col("i")))
    s = carried(s, ["base"], {"_most": F.max("lead")}, {"most0": F.max("_most")})
    most = F.greatest(F.col("most0"), F.max("lead").over(order))
    return s.withColumn("place", F.when(F.col("is_onset"), F.col("i") + most).otherwise(F.col("j")))


def _slots(placed: DataFrame) -> DataFrame:
    of = lambda kind, c: F.max(F.when(F.col(f"is_{kind}"), F.col(c)))
    return placed.groupBy("base", "place").agg(of("onset", "t").alias("onset_s"), of("offset", "t").alias("offset_s"), of("onset", "trial_type").alias("onset_trial_type"), of("offset", "trial_type").alias("offset_trial_type"))


def pair_intervals(found: DataFrame, rows_per_bin: int | None = None) -> DataFrame:
    """(base, onset_s, offset_s, duration_s, onset_trial_type, offset_trial_type) of the pairs among pair_slots()."""
    pairs = pair_slots(found, rows_per_bin).where("onset_s is not null and offset_s is not null")
    return pairs.select("base", "onset_s", "offset_s", (F.col("offset_s") - F.col("onset_s")).alias("duration_s"), "onset_trial_type", "offset_trial_type")


def first_onset_offset(found: DataFrame) -> DataFrame:
    """(base, first_onset, first_offset): the first onset, and the first offset strictly after it."""
    with_first = found.withColumn("first_onset", F.min(F.when(F.col("is_onset"), F.col("t"))).over(W.partitionBy("base")))
    return with_first.groupBy("base").agg(F.min("first_onset").alias("first_onset"), F.min(F.when(F.col("is_offset") & (F.col("t") > F.col("first_onset")), F.col("t"))).alias("first_offset"))


def marker_qc(runs: DataFrame, events: DataFrame, rules: MarkerRules = RULES_V2) -> DataFrame:
    """One row per run of runs (base): counts of rows, texts, markers and pairs, and flags; nulls without events. An
    offset is an orphan if no pair ends at its time."""
    rows = events.groupBy("base").agg(F.count("*").alias("n_trial_rows"), F.count_distinct(F.coalesce("trial_type", F.lit("nan"))).alias("n_unique_trial_type"))
    paired = F.col("onset_s").isNotNull() & F.col("offset_s").isNotNull()
    # Slots lie by base already, so that grouping them by time and then by run moves nothing.
    ends = pair_slots(markers(events, rules)).groupBy("base", "offset_s").agg(
        F.count("onset_s").alias("on"), F.count("offset_s").alias("off"), F.count_if(paired).alias("pairs"), F.min("onset_s").alias("first"),
    )
    marks = ends.groupBy("base").agg(
        F.sum("on").alias("n_onset_markers"), F.sum("off").alias("n_offset_markers"), F.sum("pairs").alias("n_intervals_paired"), F.min("first").alias("min_onset_s"),
        F.max(F.when(F.col("pairs") > 0, F.col("offset_s"))).alias("max_offset_s"), F.bool_or((F.col("off") > 0) & (F.col("pairs") == 0)).alias("has_orphan_offset"),
    )
    out = runs.select("base").distinct().join(rows, "base", "left").join(marks, "base", "left")
    known = F.col("n_trial_rows").isNotNull()
    zero = lambda c: F.when(known, F.coalesce(F.col(c), F.lit(0)))
    n_on, n_off, n_int = zero("n_onset_markers"), zero("n_offset_markers"), zero("n_intervals_paired")
    return out.select(
        "base", known.alias("events_exists"), "n_trial_rows", "n_unique_trial_type", n_on.alias("n_onset_markers"), n_off.alias("n_offset_markers"), n_int.alias("n_intervals_paired"),
        ((n_on >= 2) | (n_off >= 2) | (n_int >= 2)).alias("multi_seizure_candidate"), (n_on > n_int).alias("has_unpaired_onset"), F.when(known, F.coalesce("has_orphan_offset", F.lit(False))).alias("has_orphan_offset"), "min_onset_s", "max_offset_s",
    )


def qc_totals(qc: DataFrame) -> DataFrame:
    q = qc.where("events_exists")
    return q.agg(
        F.count("*").alias("runs"), F.count_if(F.col("n_onset_markers") > 0).alias("with_onset"), F.count_if(F.col("n_offset_markers") > 0).alias("with_offset"), F.count_if(F.col("n_intervals_paired") > 0).alias("with_interval"),
        F.count_if("multi_seizure_candidate").alias("multi"), F.count_if("has_unpaired_onset").alias("unpaired"), F.count_if("has_orphan_offset").alias("orphan"),
    )


def vocabulary(rows: DataFrame, col: str = "trial_type", top: int | None = None) -> DataFrame:
    """(trial_type, count) of exact texts, null as 'nan'; top keeps the most frequent, ties by text."""
    v = rows.groupBy(F.coalesce(F.col(col), F.lit("nan")).alias("trial_type")).agg(F.count("*").alias("count"))
    return v if top is None else v.orderBy(F.desc("count"), "trial_type").limit(top)


def label_agreement(summary: DataFrame, derived: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Per run the differences of two label sources; each has base, first_onset, first_offset."""
    a, b = (d.select("base", F.col("first_onset").alias(f"{p}_onset"), F.col("first_offset").alias(f"{p}_offset")) for d, p in ((summary, "summary"), (derived, "derived")))
    j = a.join(b, "base")
    d_on, d_off = F.col("summary_onset") - F.col("derived_onset"), F.col("summary_offset") - F.col("derived_offset")
    return j.withColumn("onset_diff", d_on).withColumn("offset_diff", d_off).withColumn("onset_match", F.abs(d_on) <= tolerance).withColumn("offset_match", F.abs(d_off) <= tolerance)


def agreement_rates(agreed: DataFrame) -> DataFrame:
    """Compared and matching runs, and their share, for onset and offset."""
    cols = []
    for p in ("onset", "offset"):
        m = F.col(f"{p}_match")
        cols += [F.count(m).alias(f"{p}_compared"), F.count_if(m).alias(f"{p}_matched"), F.avg(m.cast("double")).alias(f"{p}_rate")]
    return agreed.agg(*cols)


def top_mismatches(agreed: DataFrame, part: str = "onset", n: int = 10) -> DataFrame:
    d = F.abs(F.col(f"{part}_diff"))
    return agreed.where(~F.col(f"{part}_match")).select("base", d.alias("abs_diff")).orderBy(F.desc("abs_diff"), "base").limit(n)


def bad_order(summary: DataFrame) -> DataFrame:
    """Runs whose offset is not after their onset, both known."""
    return summary.where("first_onset is not null and first_offset is not null and first_offset <= first_onset")
