"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, weight, target): shares of all words by weight, at most cap times a source's own words.

    sizes: (source, source_size). Sources in code point order, null last, take the weights in turn. What a capped
    source leaves is shared again among the others by weight, until none is above its cap. One row per source.
    """
    # Places in order without one task for all sources: sorted ranges are numbered each, after the rows of those before.
    order = F.col("source").asc_nulls_last()
    ranged = materialise(sizes.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    before = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    before = before.select("range", (F.sum("rows").over(W.orderBy("range")) - F.col("rows")).alias("before"))
    sizes = ranged.withColumn("at", F.row_number().over(W.partitionBy("range").orderBy(order))).join(F.broadcast(before), "range").withColumn("turn", F.col("before") + F.col("at") - 1).select("source", "source_size", "turn")
    turn = F.col("turn").cast("int")
    values = F.array(*(F.lit(float(w)) for w in weights))
    t = materialise(sizes.withColumn("weight", F.get(values, turn % len(weights))).drop("turn").withColumn("limit", F.col("source_size") * float(cap)).withColumn("capped", F.lit(False)))
    while True:
        row = t.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))), F.lit(0.0)).alias("used"), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0.0)).alias("open")).first()
        unit = (row["all"] - row["used"]) / row["open"] if row["open"] else 0.0
        above = (~F.col("capped")) & (F.col("weight") * F.lit(unit) > F.col("limit"))
        if not row["open"] or not t.where(above).limit(1).count():
            break
        t = materialise(t.withColumn("capped", F.col("capped") | above))
    return t.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * F.lit(unit)).alias("target"))


def entropy_balance(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5.0, 2.0, 1.0), cap: float = 3.0, tolerance: float = 1e-9, max_rounds: int = 60, row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, rate, copies), a row for each row of docs; and its row, where row_col
    names a column that tells rows of one id apart.

    A document's rate r minimises the sum of r log r - r over all documents, subject to sum(size * r) = target in
    each source and r <= cap. Its dual is convex with one multiplier per source: r = min(cap, exp(lambda * size /
    mean size)). Newton steps, all sources at once, solve it; each sums its gradient and curvature over the
    distinct sizes of the sources with their document counts (an exact summary of the documents, made once by a
    partial aggregate), inside a bracket that halves whenever a step leaves it. A source at its cap has rate cap.

    Rounding: documents of a source are put in order of size, then id; extra copies fall where the running sum of
    fractional rates passes a whole number. Neighbours have nearly the same size, so a source's words miss its
    target by about one document's size at most; then the two documents nearest in size to what is still missing
    (or too much) are rounded the other way. The running sum comes from cell totals plus a place within a
    cell (source, size, salt), so that no source is sorted in one task. The ids decide alone: reruns agree.

    Null or blank text: size 0, one copy. Null source: a source of its own, last in order. Null ids are rows like
    any other, equal ids keep any order since they get the same rate. Empty input: no rows. Other columns of docs
    are not read.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), row.alias("row"))
    base = materialise(base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))))
    cells = materialise(base.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    hist = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = materialise(source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")).drop("docs"), weights, cap))
    means = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    goal = targets.withColumnRenamed("source", "s").join(means, F.col("s").eqNullSafe(means["source"])).drop("source").withColumnRenamed("s", "source")
    goal = materialise(goal.withColumn("full", (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)) | (F.col("source_size") == 0)))

    hist = materialise(hist.withColumnRenamed("source", "h").join(goal.where("not full"), F.col("h").eqNullSafe(F.col("source"))).select("source", (F.col("size") / F.col("mean")).alias("c"), "n", (F.col("target") / F.col("mean")).alias("goal")))
    # In units of a source's mean size; no multiplier is below -700 or above what lifts the smallest document to cap.
    least = hist.where("c > 0").groupBy("source").agg((F.lit(1.0001) * F.log(F.lit(cap)) / F.min("c")).alias("hi"))
    dual = least.select("source", F.lit(0.0).alias("x"), F.lit(-700.0).alias("lo"), "hi", F.lit(False).alias("done"))
    dual = materialise(dual)
    for _ in range(max_rounds):
        raw = F.exp(F.col("c") * F.col("x"))
        held = hist.withColumnRenamed("source", "h").join(dual.where("not done"), F.col("h").eqNullSafe(F.col("source")))
        sums = held.groupBy("source", "x", "lo", "hi").agg(
            (F.sum(F.col("n") * F.col("c") * F.least(raw, F.lit(float(cap)))) - F.max("goal")).alias("g"), F.sum(F.when(raw < cap, F.col("n") * F.col("c") * F.col("c") * raw).otherwise(F.lit(0.0))).alias("h"), F.max("goal").alias("goal")
        )
        sums = sums.withColumn("lo", F.when(F.col("g") < 0, F.col("x")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("g") > 0, F.col("x")).otherwise(F.col("hi")))
        step = F.col("x") - F.try_divide(F.col("g"), F.nullif("h", F.lit(0.0)))
        step = F.when(step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = (F.abs("g") <= F.col("goal") * tolerance) | (F.col("hi") - F.col("lo") < 1e-13)
        moved = sums.select("source", F.when(near, F.col("x")).otherwise(step).alias("x"), "lo", "hi", near.alias("done"))
        dual = materialise(dual.where("done").unionByName(moved))
        if dual.where("not done").isEmpty():
            break

    plan = goal.withColumnRenamed("source", "s").join(dual.select("source", "x"), F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "source_size", "target", "mean", "full", "x")

    def rated(rows: DataFrame) -> DataFrame:
        rate = F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.exp(F.col("size") / F.col("mean") * F.col("x")), F.lit(float(cap))))
        return rows.withColumnRenamed("source", "r").join(plan, F.col("r").eqNullSafe(F.col("source"))).drop("r").withColumn("rate", rate).withColumn("part", F.col("rate") - F.floor("rate"))

    # The running sum goes over the distinct sizes of a source, then over the salts of a size.
    until = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    by_size = rated(cells.groupBy("source", "size").agg(F.sum("n").alias("n"))).withColumn("lower", F.coalesce(F.sum(F.col("n") * F.col("part")).over(until("source", "size")), F.lit(0.0)))
    by_salt = cells.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("k"), F.coalesce(F.sum("n").over(until("source", "size", "salt")), F.lit(0)).alias("rank"))
    begun = by_salt.join(by_size, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))).select("s", "z", "k", "source_size", "target", "rate", "part", (F.col("lower") + F.col("rank") * F.col("part")).alias("before"))
    placed = base.withColumn("place", F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("doc_id", "row")))
    out = placed.join(begun, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("k")))
    passed = F.floor(F.col("before") + F.col("place") * F.col("part") + F.lit(0.5)) - F.floor(F.col("before") + (F.col("place") - 1) * F.col("part") + F.lit(0.5))
    copies = F.least(F.floor("rate") + passed, F.lit(int(cap))).cast("long")
    out = out.withColumn("copies", copies).select("doc_id", "row", "source", "size", "source_size", "target", "rate", "part", "copies")
    for _ in range(2):
        out = _nudged(materialise(out))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "rate", "copies", *(["row"] if row_col else []))


def _nudged(out: DataFrame) -> DataFrame:
    """In each source, round the one row the other way whose size is nearest to what the source lacks or has too much;
    of equal ones that with the smallest id, and of rows of one id any (they are alike)."""
    lack = out.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("lack")).withColumnRenamed("source", "s")
    up = (F.col("lack") > 0) & (F.col("copies") == F.floor("rate")) & (F.col("part") > 0)
    down = (F.col("lack") < 0) & (F.col("copies") > F.floor("rate"))
    gap = F.abs(F.col("size") - F.abs("lack"))
    best = out.join(lack, F.col("source").eqNullSafe(F.col("s"))).where((up | down) & (gap < F.abs("lack"))).groupBy("s").agg(F.min(F.struct(gap.alias("gap"), F.col("doc_id").alias("id"), "row")).alias("best"), F.max(F.signum("lack")).cast("long").alias("by"))
    hit = out.join(best, F.col("source").eqNullSafe(F.col("s")) & (F.col("row") == F.col("best.row")), "left")
    return hit.withColumn("copies", F.greatest(F.col("copies") + F.coalesce("by", F.lit(0)), F.lit(0))).select(*out.columns)
