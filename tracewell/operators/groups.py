"""Exact percentiles of groups of any size: no task holds a group's values, and none meets all rows of a hot group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import shared_folder

#: A key with more than one in so many rows is hot. There are fewer of these than the number says, whatever the input.
HOT = 1000
#: A bracket of values is cut in so many widths before anything is ranked.
CUTS = 256


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, (a[p].eqNullSafe(b[q]) for p, q in pairs))


def settled(df: DataFrame) -> DataFrame:
    """df, a row or so a group, written to the shared folder, so that what builds on it neither repeats its work nor
    grows its plan."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def join_groups(df: DataFrame, table: DataFrame, keys: list[str], total: str) -> DataFrame:
    """df with the other columns of table, which is settled and has one row a key, and in total the number of df's rows
    with it; a null key meets the null key, rows without a row in table go. Hot keys, fewer than HOT, are broadcast, so
    that their rows stay where they are; all others meet by key, and none of them has over a HOTth of the rows."""
    names = [f"_j{i}" for i in range(len(keys))]
    t = table.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(c for c in table.columns if c not in keys))
    # Three numbers.
    whole = t.agg(F.sum(total).alias("n"), F.max(total).alias("most"), F.min(total).alias("least")).first()
    bound = (whole["n"] or 0) / HOT
    pairs = list(zip(keys, names, strict=True))
    hot, cold = F.broadcast(t.where(F.col(total) > bound)), t.where(F.col(total) <= bound)
    if (whole["most"] or 0) <= bound:
        return df.join(cold, _same(df, cold, pairs)).drop(*names)
    near = df.join(hot, _same(df, hot, pairs))
    if whole["least"] > bound:
        return near.drop(*names)
    known = F.broadcast(t.where(F.col(total) > bound).select(*names))
    far = df.join(known, _same(df, known, pairs), "left_anti")
    return near.unionByName(far.join(cold, _same(far, cold, pairs))).drop(*names)


def group_percentiles(df: DataFrame, keys: list[str], cols: list[str], shares: tuple[float, ...] = (0.5,), accuracy: int = 10_000) -> DataFrame:
    """(keys, rows, <col>: array of its exact percentiles at shares, interpolated) for every key, the null key too; null
    where a group has no value in a column. rows counts all rows of the group.

    A sketch of bounded size brackets each percentile within 10 / accuracy of its rank (a group of fewer values than
    accuracy is its own bracket). Values below a bracket become one count where they are; those within are counted by
    value, the bracket is cut in CUTS widths, and only the cuts that hold the wanted ranks are ordered, each on its own.
    """
    g = [f"_g{i}" for i in range(len(keys))]
    named = df.select(*(F.col(k).alias(n) for k, n in zip(keys, g, strict=True)), *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)))
    wide = [f"_c{i}" for i in range(len(cols))]
    long = named.unpivot(g, wide, "column", "value")
    x = long.where("value is not null")
    of = [*g, "column"]
    reach = 10 / accuracy
    lows, highs = ([F.lit(min(max(s + d, 0.0), 1.0)) for s in shares] for d in (-reach, reach))
    small = F.count("value") < accuracy
    low, high = F.percentile_approx("value", F.array(*lows), accuracy), F.percentile_approx("value", F.array(*highs), accuracy)
    bracket = [F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.count("value") - 1)).alias("place"), F.when(small, F.min("value")).otherwise(F.get(low, F.lit(i))).alias("low"), F.when(small, F.max("value")).otherwise(F.get(high, F.lit(i))).alias("high")) for i, s in enumerate(shares)]
    sketch = settled(long.groupBy(*of).agg(F.count("*").alias("_rows"), F.count("value").alias("_total"), F.array(*bracket).alias("_of")))

    near = join_groups(x, sketch.where("_total > 0").drop("_rows"), of, "_total").select(*of, "value", F.inline("_of")).where("value <= high")
    near = near.groupBy(*of, "i", "place", "low", "high", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    cut = F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * CUTS)
    near = near.withColumn("cut", F.when(F.col("value").isNull(), F.lit(-1)).otherwise(F.coalesce(cut, F.lit(0))).cast("long"))
    by = [*of, "i", "place"]
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("cut"))
    sums = near.groupBy(*by, "cut").agg(F.sum("n").alias("n")).withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    held = sums.where((F.col("before") <= F.ceil("place")) & (F.col("upto") > F.floor("place")))
    names = [f"_h{i}" for i in range(len(by) + 1)]
    pairs = list(zip([*by, "cut"], names, strict=True))
    held = held.select(*(F.col(a).alias(b) for a, b in pairs), "before")
    inside = near.join(held, _same(near, held, pairs)).drop(*names)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*by, "cut").orderBy("value")))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    part = F.col("place") - F.floor("place")
    value = F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    two = inside.groupBy(*by).agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"))
    one = two.select(*g, "column", "i", value.alias("v"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == c, F.struct("i", "v")))), lambda r: r["v"])
    found = one.groupBy(*g).agg(*(F.nullif(ordered(w), F.array().cast("array<double>")).alias(w) for w in wide))

    counted = sketch.groupBy(*g).agg(F.max("_rows").alias("rows"))
    there = found.select(*(F.col(n).alias(f"_f{i}") for i, n in enumerate(g)), *wide)
    out = counted.join(there, _same(counted, there, [(n, f"_f{i}") for i, n in enumerate(g)]), "left")
    return settled(out.select(*(F.col(n).alias(k) for k, n in zip(keys, g, strict=True)), "rows", *(F.col(w).alias(c) for w, c in zip(wide, cols, strict=True))))
