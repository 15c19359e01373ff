"""Profiles of tables: missing values, value counts, histograms, duplicates, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_by_column(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, missing_pct), from one pass over df, the highest first."""
    cols = cols or df.columns
    row = df.agg(*((F.count_if(F.col(c).isNull()) * F.lit(100.0) / F.count("*")).alias(c) for c in cols))
    return row.unpivot([], cols, "column", "missing_pct").orderBy(F.desc("missing_pct"), "column")


def missing_by_group(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, missing_pct, rows), the highest first."""
    return df.groupBy(key).agg((F.avg(F.col(col).isNull().cast("double")) * 100).alias("missing_pct"), F.count("*").alias("rows")).orderBy(F.desc("missing_pct"), key)


def value_counts(df: DataFrame, col: str, top: int = 20) -> DataFrame:
    """The top values of col as text with their counts, null as <NA>; ties by value."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("<NA>"))
    return df.groupBy(v.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(top)


def rounded_counts(df: DataFrame, col: str, digits: int = 6, top: int = 20) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.round(col, digits).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(top)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, count) of equal widths between the extremes, empty bins too; the last one holds its upper edge."""
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a is not null")
    ends = ends.withColumn("w", F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(F.lit(1.0) / bins))
    at = F.least(F.floor((F.col("x") - F.col("a")) / F.col("w")), F.lit(bins - 1)).cast("int")
    n = x.join(F.broadcast(ends), how="cross").groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    spine = ends.select("a", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = spine.join(F.broadcast(n), "bin", "left")
    return out.select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with is_duplicate, true for all rows of a key that occurs more than once; nulls equal each other. Keys are
    counted with partial sums and only repeated ones come back, so that no task holds the rows of a hot key."""
    names = [f"_key_{i}" for i in range(len(keys))]
    again = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.count("*").alias("_key_times")).where("_key_times > 1")
    same = [df[k].eqNullSafe(again[n]) for k, n in zip(keys, names, strict=True)]
    return df.join(again, same, "left").select(*(df[c] for c in df.columns), again["_key_times"].isNotNull().alias("is_duplicate"))


def summary_with_percentiles(df: DataFrame, cols: list[str], shares: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(column, count, mean, std, min, max, values): values are the exact percentiles at these shares, interpolated;
    null for a column of nulls.

    A sketch of bounded size brackets each percentile: exact ranks lie within 10 / accuracy of the sketched ones, and a
    column of fewer values than accuracy is its own bracket. All values are counted distributed, those below a bracket
    become one count, and only the values within, about a 500th, are ranked. No task holds a column's values.
    """
    x = df.select(*(F.col(c).cast("double").alias(c) for c in cols))
    wide = 10 / accuracy
    lows, highs = [max(s - wide, 0.0) for s in shares], [min(s + wide, 1.0) for s in shares]
    parts = []
    for c in cols:
        small = F.count(c) < accuracy
        low, high = F.percentile_approx(c, F.array(*map(F.lit, lows)), accuracy), F.percentile_approx(c, F.array(*map(F.lit, highs)), accuracy)
        of = [F.struct(F.lit(i).alias("i"), F.lit(s).alias("share"), F.when(small, F.min(c)).otherwise(F.get(low, F.lit(i))).alias("low"), F.when(small, F.max(c)).otherwise(F.get(high, F.lit(i))).alias("high")) for i, s in enumerate(shares)]
        parts.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.array(*of).alias("of")))
    sketch = x.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))
    brackets = sketch.select("column", F.col("count").alias("total"), F.inline("of"))

    n = x.unpivot([], cols, "column", "value").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    near = n.join(F.broadcast(brackets), "column").where("value <= high")
    near = near.groupBy("column", "i", "share", "total", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("column", "i").orderBy(F.asc_nulls_first("value")).rowsBetween(W.unboundedPreceding, 0))
    place = F.col("share") * (F.col("total") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    two = near.withColumn("upto", upto).withColumn("place", place).groupBy("column", "i", "place").agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"))
    part = F.col("place") - F.floor("place")
    value = F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    found = two.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda r: r["v"]).alias("values"))
    return sketch.drop("of").join(F.broadcast(found), "column", "left")


def numeric_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max), exact."""
    s = summary_with_percentiles(df, cols, (0.25, 0.5, 0.75))
    return s.select("column", "count", "mean", "std", "min", *(F.get("values", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))), "max")


def text_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, count, unique, top, freq); the smallest of equally frequent values is top."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in cols)).unpivot([], cols, "column", "value").where("value is not null")
    n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return n.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq"))
