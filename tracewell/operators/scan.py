"""Running values over one long series without one task that holds it: rows are dealt to bins of the order, every bin is
summed up in a row, the sums of the bins before are carried to each bin, and rows are finished within their bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a bin should hold; bins are of equal width, so that dense stretches have more.
ROWS = 1_000_000


def binned(df: DataFrame, at: str, rows: int = ROWS) -> DataFrame:
    """df with bin, a number that grows with the column at (a number; null is in the first bin): the whole span is cut
    in equal widths, as many as df has times rows. A key with a third of all rows lies in a third of the bins or more
    if its rows spread like others; rows of one value share a bin."""
    ends = df.agg(F.min(at).cast("double").alias("_a"), F.max(at).cast("double").alias("_b"), F.count("*").alias("_n"))
    # One row, whatever the size.
    width = (F.col("_b") - F.col("_a")) * F.lit(float(rows)) / F.col("_n")
    place = F.when(width > 0, F.floor((F.col(at) - F.col("_a")) / width)).otherwise(F.lit(0))
    return df.join(F.broadcast(ends), how="cross").withColumn("bin", F.coalesce(place, F.lit(0)).cast("long")).drop("_a", "_b", "_n")


def carried(df: DataFrame, keys: list[str], sums: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """df (with bin) and the columns of carry: expressions over the sums of the bins before a row's bin, as window
    functions; sums is aggregated within each (keys, bin). Null where no bin comes before."""
    per_bin = df.groupBy(*keys, "bin").agg(*(c.alias(n) for n, c in sums.items()))
    before = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    known = per_bin
    for name, c in carry.items():
        known = known.withColumn(name, c.over(before))
    known = known.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("bin").alias("_bin"), *carry)
    same = F.col("bin") == F.col("_bin")
    for k in keys:
        same = same & df[k].eqNullSafe(known[f"_k_{k}"])
    return df.join(known, same).drop("_bin", *(f"_k_{k}" for k in keys))


def numbered(df: DataFrame, keys: list[str], order: str, rows: int = ROWS) -> DataFrame:
    """df with i, the place of each row (from 0) within its keys by the column order (a timestamp or a number)."""
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(order).cast("timestamp_ntz"))
    at = since if dict(df.dtypes)[order] in ("timestamp_ntz", "date") else F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else F.col(order)
    b = carried(binned(df.withColumn("_at", at), "_at", rows), keys, {"_n": F.count("*")}, {"_before": F.sum("_n")})
    inside = F.row_number().over(W.partitionBy(*keys, "bin").orderBy(order)) - 1
    return b.withColumn("i", (F.coalesce("_before", F.lit(0)) + inside).cast("long")).drop("_at", "_before", "bin")


def in_blocks(df: DataFrame, before: int, after: int = 0, size: int = ROWS) -> DataFrame:
    """Rows (with i) in blocks of size, each with before rows of the block ahead of it and after rows of the next one:
    block, and halo for rows that are only there for others to look at. A frame of that many rows is whole within."""
    first = F.greatest(F.floor((F.col("i") - after) / size), F.lit(0))
    last = F.floor((F.col("i") + before) / size)
    return df.withColumn("block", F.explode(F.sequence(first, last))).withColumn("halo", F.col("block") != F.floor(F.col("i") / size))
