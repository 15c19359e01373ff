"""The commonest of many long texts, exactly: hashes are counted instead of texts, or only those a sketch names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import settled

#: Distinct values that the sketch can name.
TRACKED = 10_000
#: So many characters of a text go with its hashes, to order texts that are equally frequent.
HEAD = 64


def top_values(df: DataFrame, col: str, top: int = 20, null_as: str = "<NA>", tracked: int = TRACKED, value: str = "value") -> DataFrame:
    """(value, count): the top most frequent values of col as text, ties by text, without a shuffle of all distinct texts.
    Null counts as null_as; an empty table or top 0 gives no rows.

    First a mergeable sketch over hashes names at most tracked candidates, and their rows are counted. The sketch names
    every value with more than 5.25 / tracked of the rows, so if the last of the top candidates has more, none is missed.
    Where it has not, every text is counted by two hashes, with the head of the text. Then only the rows of values that
    can be in the result are counted by whole text. Two texts with equal hashes would show in a smaller last count: then
    all are counted by whole text. Steps run when called, as each needs the one before; df is read once in each.
    """
    x = df.select(F.coalesce(F.col(col).cast("string"), F.lit(null_as)).alias("value"))
    if top < 1:
        return _counted(x, 1, value).limit(0)
    found = _recounted(x, named_by_sketch(x, top, tracked), top, value)
    if found is None:
        found = _recounted(x, named_by_hash(x, top), top, value)
    return _counted(x, top, value) if found is None else found


def _counted(x: DataFrame, top: int, value: str) -> DataFrame:
    return x.groupBy(F.col("value").alias(value)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), value).limit(top)


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64("value").alias("one"), F.xxhash64(F.lit(1), "value").alias("two")


def _last(counts: DataFrame, top: int) -> tuple[int, int]:
    """The smallest of the top counts, and how many there are."""
    row = counts.orderBy(F.desc("count")).limit(top).agg(F.min("count").alias("least"), F.count("*").alias("n")).head()
    return row["least"] or 0, row["n"]


def named_by_sketch(x: DataFrame, top: int, tracked: int) -> tuple[DataFrame, int] | None:
    """Hashes (one) of all of x (value) that can be among the top ones, and the last one's count; None if the sketch
    cannot rule out that it missed one. Candidates are sent to all tasks: tracked hashes at most, whatever the input."""
    sketch = x.select(_hashes()[0]).agg(F.expr(f"approx_top_k(one, {tracked}, {tracked})").alias("named"), F.count("*").alias("total"))
    named = sketch.select("total", F.inline("named")).select("total", F.col("item").alias("one"))
    counts = settled(x.select(_hashes()[0]).join(F.broadcast(named), "one").groupBy("one", "total").agg(F.count("*").alias("count")))
    least, n = _last(counts, top)
    total = counts.agg(F.max("total")).head()[0] or 0
    # The sketch has tracked / 0.75 places or more, misses at most 3.5 / places of the rows of a value, and names what it
    # has counted more often than it can have missed.
    if n < top or least * tracked <= 2 * 3.5 * 0.75 * total:
        return None
    return F.broadcast(counts.where(F.col("count") >= least).select("one")), least


def named_by_hash(x: DataFrame, top: int) -> tuple[DataFrame, int]:
    """Hashes (one, two) of all of x (value) that can be among the top ones, and the last one's count (0 if there are
    fewer): those above it, and of those that reach it the ones whose head is not behind the last place's."""
    counts = settled(x.groupBy(*_hashes(), F.left("value", F.lit(HEAD)).alias("head")).agg(F.count("*").alias("count")))
    least, n = _last(counts, top)
    if n < top:
        return counts.select("one", "two"), 0
    # The last of the top rows in order of count and head: texts that come later in it come later as a whole.
    edge = counts.orderBy(F.desc("count"), "head").limit(top).agg(F.max(F.when(F.col("count") == least, F.col("head")))).head()[0]
    return counts.where((F.col("count") > least) | ((F.col("count") == least) & (F.col("head") <= edge))).select("one", "two"), least


def _recounted(x: DataFrame, named: tuple[DataFrame, int] | None, top: int, value: str) -> DataFrame | None:
    """The top values among the rows of the named hashes; None if the last count is not the one expected."""
    if named is None:
        return None
    hashes, least = named
    keys = hashes.columns
    rows = x.select("value", *_hashes()[: len(keys)]).join(hashes, keys, "left_semi")
    found = settled(_counted(rows, top, value)).orderBy(F.desc("count"), value)
    return found if least == 0 or _last(found, top) == (least, top) else None
