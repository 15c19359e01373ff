"""Run inventory: entities in names, channel and type counts, sidecar values, the run summary and its coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import entity, null_tokens

ENTITIES = ("sub", "ses", "task", "acq", "run")
STRICT = r"^sub-([^_]+)(?:_ses-([^_]+))?(?:_task-([^_]+))?(?:_acq-([^_]+))?(?:_run-([0-9]+))?_ieeg$"
#: Fixed value: an .eeg file of more than 1 MiB holds content, less is a pointer.
CONTENT_BYTES = 1_048_576
_NAMES = dict(zip(ENTITIES, ("subject", "session", "task", "acq", "run"), strict=True))


def parse_entities(names: DataFrame, col: str = "name") -> DataFrame:
    """subject, session, task, acq and run of names such as sub-a_ses-b_task-c_acq-d_run-01_ieeg.vhdr."""
    stem = F.regexp_replace(F.col(col), r"\.(vhdr|vmrk|eeg|tsv|json)$", "")
    return names.select("*", *(entity(stem, k).alias(v) for k, v in _NAMES.items()))


def parse_entities_strict(names: DataFrame, col: str = "name") -> DataFrame:
    """The same from the whole name at once; all null where it does not follow the pattern; run as a number."""
    stem = F.regexp_replace(F.col(col), r"\.[A-Za-z0-9]+$", "")
    parts = [F.nullif(F.regexp_extract(stem, STRICT, i + 1), F.lit("")).alias(v) for i, v in enumerate(_NAMES.values())]
    return names.select("*", *parts[:-1], F.nullif(F.regexp_extract(stem, STRICT, 5), F.lit("")).cast("int").alias("run_no"))


def directory_fallback(parsed: DataFrame, path: str = "path") -> DataFrame:
    """subject and session from the directories of path where the name has none."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    up = {"subject": r"(?:^|/)sub-([^/]+)/", "session": r"(?:^|/)ses-([^/]+)/"}
    return parsed.withColumns({c: F.coalesce(F.col(c), F.nullif(F.regexp_extract(p, rx, 1), F.lit(""))) for c, rx in up.items()})


def union_of_kinds(files: DataFrame, kinds=("vhdr", "vmrk", "events", "channels", "json")) -> DataFrame:
    """(base, one path column per kind): bases of any of the kinds; the greatest path of a kind wins. files: base, kind, path."""
    wide = files.groupBy("base").pivot("kind", [*kinds]).agg(F.max("path"))
    return wide.where(F.coalesce(*(F.col(k) for k in kinds)).isNotNull())


def channel_counts(channels: DataFrame, status: str = "status") -> DataFrame:
    """(base, n_channels, n_bad, n_good)."""
    s = F.lower(F.col(status))
    return channels.groupBy("base").agg(F.count("*").alias("n_channels"), F.count_if(s == "bad").alias("n_bad"), F.count_if(s == "good").alias("n_good"))


def type_map(channels: DataFrame, col: str = "type") -> DataFrame:
    """(base, types map<string,long>): value counts of a column per run."""
    n = channels.where(F.col(col).isNotNull()).groupBy("base", col).agg(F.count("*").alias("n"))
    return n.groupBy("base").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "n")))).alias("types"))


def good_channels(channels: DataFrame, types=("ECOG", "SEEG"), most: int = 16, fallback: bool = True) -> DataFrame:
    """The first most channels in file order of good status and wanted type; where a run has none, its first ones.

    channels: base, ch_idx, status and type (a missing column skips its filter).
    """
    good = F.lit(True)
    if "status" in channels.columns:
        good = good & (F.lower("status") == "good")
    if "type" in channels.columns:
        good = good & F.upper("type").isin(*types)
    c = channels.withColumn("good", F.coalesce(good, F.lit(False)))
    per_run = W.partitionBy("base")
    wanted = F.col("good") | ((F.count_if("good").over(per_run) == 0) & F.lit(fallback))
    c = c.withColumn("wanted", wanted).where("wanted").drop("wanted")
    return c.withColumn("rank", F.row_number().over(per_run.orderBy("ch_idx"))).where(F.col("rank") <= most)


def run_summary(runs: DataFrame, channels: DataFrame, labels: DataFrame) -> DataFrame:
    """runs joined with its pre-aggregated channels and (base, first_onset, first_offset) labels; runs keep all rows."""
    out = runs.join(channel_counts(channels), "base", "left").join(labels, "base", "left")
    return out.withColumn("has_onset", F.col("first_onset").isNotNull()).withColumn("has_offset", F.col("first_offset").isNotNull())


def coverage(summary: DataFrame, subject: str = "subject", present: str = "eeg_present") -> DataFrame:
    """Counts and percentages of runs with onset, offset, both, content and all of them."""
    on, off, has = F.col("has_onset"), F.col("has_offset"), F.coalesce(F.col(present), F.lit(False))
    n = F.count("*")
    share = lambda c: (F.count_if(c) * F.lit(100.0) / n)
    return summary.agg(
        n.alias("runs"), F.count_distinct(subject).alias("subjects"), F.count_if(on).alias("onset_runs"), F.count_if(off).alias("offset_runs"), F.count_if(on & off).alias("both_runs"),
        F.count_if(has).alias("present_runs"), F.count_if(on & off & has).alias("ready_runs"), F.round(share(on), 6).alias("onset_pct"), F.round(share(on & off), 6).alias("both_pct"), F.round(share(has), 6).alias("present_pct"),
    )


def summary_by_group(summary: DataFrame, key: str = "acq", present: str = "eeg_present") -> DataFrame:
    """Runs, onset runs, both, present, and median channel counts by key; a null key counts as <NA>."""
    return summary.groupBy(F.coalesce(F.col(key), F.lit("<NA>")).alias(key)).agg(
        F.count("*").alias("runs"), F.count_if("has_onset").alias("onset_runs"), F.count_if(F.col("has_onset") & F.col("has_offset")).alias("both_runs"), F.count_if(F.col(present)).alias("present_runs"),
        F.median("n_channels").alias("median_channels"), F.median("n_bad").alias("median_bad"),
    )


def present_by_manifest(runs: DataFrame, manifest: DataFrame, path: str = "path", size: Column | None = None) -> DataFrame:
    """runs with eeg_present: the path is in the manifest. Where the manifest is empty, size (a column of runs) decides,
    if given."""
    m = manifest.select(F.col(path)).distinct().withColumn("listed", F.lit(True))
    found = F.coalesce("listed", F.lit(False))
    if size is None:
        return runs.join(m, path, "left").withColumn("eeg_present", found).drop("listed")
    # One row, whatever the manifest's size.
    some = manifest.limit(1).agg((F.count("*") > 0).alias("any_listed"))
    by_size = F.coalesce(size > CONTENT_BYTES, F.lit(False))
    return runs.join(m, path, "left").join(F.broadcast(some), how="cross").withColumn("eeg_present", F.when(F.col("any_listed"), found).otherwise(by_size)).drop("listed", "any_listed")


def missing_columns(df: DataFrame, expected) -> DataFrame:
    """(column, present) for each expected column: a small report on the schema."""
    return df.sparkSession.createDataFrame([(c, c in df.columns) for c in expected], "column string, present boolean")


def first_sampling_rate(channels: DataFrame) -> DataFrame:
    """(base, sfreq): the first known sampling frequency in file order, the lowest of equal places."""
    v = F.when(null_tokens(F.col("sampling_frequency").cast("string")).isNotNull(), F.col("sampling_frequency").try_cast("double"))
    return channels.groupBy("base").agg(F.min(F.when(v.isNotNull(), F.struct(F.col("ch_idx"), v.alias("v"))))["v"].alias("sfreq"))


def sampling_rate(runs: DataFrame, sidecars: DataFrame, channels: DataFrame) -> DataFrame:
    """(base, sfreq) for every run: SamplingFrequency of its sidecar (base, raw), else the first of its channels."""
    told = sidecars.groupBy("base").agg(F.first(F.get_json_object("raw", "$.SamplingFrequency").try_cast("double"), ignorenulls=True).alias("told"))
    told = told.withColumn("told", F.when(~F.isnan("told"), F.col("told")))
    return runs.select("base").join(told, "base", "left").join(first_sampling_rate(channels), "base", "left").select("base", F.coalesce("told", "sfreq").alias("sfreq"))


def first_existing(df: DataFrame, names) -> str | None:
    """The first of the names that is a column of df."""
    return next((n for n in names if n in df.columns), None)


def events_paths(summary: DataFrame, discovered: DataFrame) -> DataFrame:
    """(base, events_tsv): the path that the summary names, else the one found among the files."""
    found = discovered.where("kind = 'events'").groupBy("base").agg(F.max("path").alias("found"))
    named = summary.select("base", F.nullif("events_tsv", F.lit("")).alias("named"))
    return named.join(found, "base", "full").select("base", F.coalesce("named", "found").alias("events_tsv")).where("events_tsv is not null")
