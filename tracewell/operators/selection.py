"""Choosing runs: scores, tiers, caps per subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def shortlist_score(df: DataFrame) -> Column:
    """10 onset + 15 onset and offset + channels / 50 - bad / 50 + 2 for a known acquisition + 3 where content is missing."""
    on, off = F.col("has_onset"), F.col("has_offset")
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return 10 * _flag(on) + 15 * _flag(on & off) + num("n_channels") / 50 - num("n_bad") / 50 + 2 * _flag(F.lower("acq").isin("ecog", "seeg")) + 3 * _flag(~F.coalesce("eeg_present", F.lit(False)))


def signal_score(df: DataFrame) -> Column:
    """10 for both labels + 1 for an acquisition of ecog or seeg + channels / 100."""
    return 10 * _flag(F.col("has_onset") & F.col("has_offset")) + _flag(F.lower("acq").isin("ecog", "seeg")) + F.coalesce(F.col("n_channels").cast("double"), F.lit(0.0)) / 100


def report_score(df: DataFrame) -> Column:
    return 10 * _flag(F.col("has_onset") & F.col("has_offset"))


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_tier(df: DataFrame, *tiers: Column) -> DataFrame:
    """Rows of the first condition that any row meets; a row counts for the first one it meets itself."""
    tier = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in enumerate(tiers)))
    rows = df.withColumn("tier", tier).where("tier is not null")
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("tier"))), "tier")


def select_diverse(df: DataFrame, n: int, score: str = "score", subject: str = "subject", key: str = "base", most: int = 2, order: str | None = None) -> DataFrame:
    """The n best rows with at most most of a subject; ties by key. The cap is per subject alone, so a rank suffices. Rows
    of all subjects are compared by order where it is given, such as a rounded score, in which sums that differ in the last
    bits alone are ties."""
    r = F.row_number().over(W.partitionBy(subject).orderBy(F.desc(score), key))
    return df.withColumn("subject_rank", r).where(F.col("subject_rank") <= most).orderBy(F.desc(order or score), key).limit(n)


def tiered_fill(df: DataFrame, pools: list[Column], full: int = 15, least: int = 10, **how) -> DataFrame:
    """Up to full rows of the first pool; if they are under least, the next pools fill up to least, each with its own cap."""
    picked = select_diverse(df.where(F.coalesce(pools[0], F.lit(False))), full, **how).withColumn("pool", F.lit(1))
    order = F.row_number().over(W.orderBy("pool", F.desc(how.get("score", "score")), how.get("key", "base")))
    for i, pool in enumerate(pools[1:], 2):
        rest = df.where(F.coalesce(pool, F.lit(False))).join(picked.select(how.get("key", "base")), how.get("key", "base"), "left_anti")
        more = select_diverse(rest, least, **how).withColumn("pool", F.lit(i))
        # At most full + least rows come here.
        picked = picked.unionByName(more.select(*picked.columns)).withColumn("nth", order).where((F.col("pool") < i) | (F.col("nth") <= least)).drop("nth")
    return picked
