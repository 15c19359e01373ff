"""Benchmark decontamination by spaced seeds, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Positions with 1 are hashed, positions with 0 may differ. Together these find every window of 13 tokens with up to
#: 3 substitutions, and every item of 6 to 12 tokens of which 7 in 10 agree.
MASKS = ("11101", "100111", "1101001", "11000101", "1010011")
#: Items of fewer tokens are too short for the masks: they must stand in a document whole.
SEEDED = 6
#: More seeds than this are joined by a shuffle instead of a broadcast.
BROADCAST_SEEDS = 2_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    # Separators at either end leave an empty piece each.
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.size(values)) if by else values


def _seeded(rows: DataFrame, key: str, masks: Sequence[str]) -> DataFrame:
    """(key, at, seed) for each mask and token position; positions where a mask would reach over the end are left out.

    A mask has four 1s, hashed as two pairs: pairs of one gap are made once for all masks.
    """
    ones = [[i for i, x in enumerate(m) if x == "1"] for m in masks]
    if any(len(o) != 4 or o[0] for o in ones):
        raise ValueError("a mask starts with 1 and has four of them")
    gaps = sorted({g for o in ones for g in (o[1] - o[0], o[3] - o[2])})
    h = rows.select(key, F.transform("tokens", lambda w: F.xxhash64(w)).alias("h"))
    h = h.select(key, F.size("h").alias("n"), *(F.zip_with("h", _shifted(F.col("h"), g), lambda x, y: F.xxhash64(x, y)).alias(f"p{g}") for g in gaps))

    def seed(number: int, one: list[int]) -> Column:
        return F.zip_with(f"p{one[1] - one[0]}", _shifted(F.col(f"p{one[3] - one[2]}"), one[2]), lambda x, y: F.xxhash64(F.lit(number), x, y))

    # The outer form: posexplode() adds a filter on its input's size, which is pushed below and makes all of it again.
    made = (seed(i, o) for i, o in enumerate(ones))
    e = h.select(key, "n", F.concat(*made).alias("seeds")).select(key, "n", F.posexplode_outer("seeds").alias("place", "seed"))
    at = F.col("place") % F.col("n")
    spans = F.array(*(F.lit(len(m)) for m in masks))
    return e.where(at + F.get(spans, (F.col("place") / F.col("n")).cast("int")) <= F.col("n")).select(key, at.alias("at"), "seed")


def _whole_runs(rows: DataFrame, key: str, lengths: Sequence[int]) -> DataFrame:
    """(key, at, whole, run) for each run of so many tokens; whole where the run is all there is."""
    h = rows.select(key, F.transform("tokens", lambda w: F.xxhash64(w)).alias("h"))

    def longer(run: Column, n: int) -> Column:
        return F.zip_with(run, _shifted(F.col("h"), n - 1), lambda x, y: F.xxhash64(F.lit(n), x, y))

    runs = {1: F.transform("h", lambda x: F.xxhash64(F.lit(1), x))}
    for n in range(2, max(lengths) + 1):
        runs[n] = longer(runs[n - 1], n)
    e = h.select(key, F.size("h").alias("n"), F.array(*(F.struct(F.lit(n).alias("tokens"), runs[n].alias("runs")) for n in lengths)).alias("all"))
    e = e.select(key, "n", F.inline("all")).select(key, "n", "tokens", F.posexplode_outer("runs").alias("at", "run"))
    return e.where(F.col("at") + F.col("tokens") <= F.col("n")).select(key, "at", (F.col("tokens") == F.col("n")).alias("whole"), "run")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks: Sequence[str] = MASKS, window: int = 13, share: float = 0.7) -> DataFrame:
    """(doc_id, item_id, start, matched, overlap): a row for each document, benchmark item and alignment that overlap.

    Both sides are cut in lower-cased runs of letters and digits. Fixed masks slide over the tokens; equal hashes of
    the masked tokens propose an alignment of a document and an item. It counts if some window of that many tokens
    of the item (the whole item where it is shorter) agrees with the document in share of its tokens, so single
    substituted words do not hide a passage. start is the token of the document where the item begins (negative if
    its head is missing), matched the number of agreeing tokens, overlap matched / tokens of the item.

    Seeds of the benchmark are counted first: up to BROADCAST_SEEDS they are broadcast, beyond they are joined by a
    shuffle. Documents are only shuffled whole, by id, to be held against the alignments found. An item of fewer than
    SEEDED tokens is found where a document holds it whole, by a hash of the whole run; of its places the first is told.
    Null or empty texts match nothing, null ids are
    left out of the result (there is nothing to name), repeated ids are checked row by row and reported once.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("tokens")).where(F.size("tokens") > 0)
    bench = materialise(_seeded(items.where(F.size("tokens") >= SEEDED), "item_id", masks).select("item_id", F.col("at").alias("item_at"), "seed").distinct())
    few = bench.count() <= BROADCAST_SEEDS
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    cut = base.select("doc_id", tokens(F.col("text")).alias("tokens"))
    hits = _seeded(cut, "doc_id", masks).join(F.broadcast(bench) if few else bench, "seed")
    found = hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    short = items.where(F.size("tokens") < SEEDED)
    # At most SEEDED - 1 lengths; documents are cut in runs only of those that some item has.
    lengths = sorted(r[0] for r in short.select(F.size("tokens")).distinct().collect())
    if lengths:
        runs = materialise(_whole_runs(short, "item_id", lengths).where("whole").select("item_id", "run").distinct())
        runs = F.broadcast(runs) if runs.count() <= BROADCAST_SEEDS else runs
        found = found.unionByName(_whole_runs(cut, "doc_id", lengths).join(runs, "run").groupBy("doc_id", "item_id").agg(F.min("at").alias("start")))
    found = materialise(found.distinct())

    wanted = base.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("tokens"))
    near = found.join(items.select("item_id", F.col("tokens").alias("item")), "item_id").join(wanted, "doc_id")
    n, start = F.size("item"), F.col("start")
    head = F.concat(F.array_repeat(F.lit(None).cast("string"), -start), F.slice("tokens", 1, F.greatest(n + start, F.lit(0))))
    aligned = F.when(start < 0, head).otherwise(F.slice("tokens", start + 1, n))
    near = near.select("doc_id", "item_id", "start", n.alias("n"), "item", aligned.alias("aligned"))
    same = near.select("doc_id", "item_id", "start", "n", F.slice(F.zip_with("item", "aligned", lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), 1, F.col("n")).alias("same"))
    width = F.least(F.lit(window), F.col("n"))
    enough = F.exists(F.sequence(F.lit(1), F.col("n") - width + 1), lambda s: F.aggregate(F.slice("same", s, width), F.lit(0), lambda a, x: a + x) >= F.when(F.col("n") < SEEDED, F.col("n")).otherwise(F.ceil(width * share)))
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    return same.where(enough).select("doc_id", "item_id", "start", matched.alias("matched"), (matched / F.col("n")).alias("overlap")).distinct()
