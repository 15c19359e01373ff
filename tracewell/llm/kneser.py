"""Text quality by an interpolated modified Kneser-Ney model of byte n-grams trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialise

ORDER = 5
#: So many of the commonest n-grams, however large the corpus, are sent to all tasks with their probabilities (8 bytes
#: and 4 for each fold); all others are joined by key.
COMMON = 1 << 20
#: Bits of the bitmap of trusted ids (8 MB): where there are many more of them, it only spares less.
BITMAP = 1 << 26


class Table:
    """Row numbers by key in open addressing, filled and read by whole arrays; keys are not negative, absent ones give -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        place, rows = self._place(keys), np.arange(len(keys), dtype=np.int32)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]  # of several for one place the last stays
            done = self.keys[place] == keys
            self.rows[place[done]] = rows[done]
            keys, rows, place = keys[~done], rows[~done], (place[~done] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * tk.BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.rows[place], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        at = place[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            more = ~hit & (found >= 0)
            left, at = left[more], at[more]
        return out


def codes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The ORDER bytes that end at each byte of the lower-cased text, as one number; zeros stand before its start."""
    low = tk.LOWER[data].astype(np.int64)
    low[~tk.NONSPACE[data]] = 32
    place = np.arange(len(low)) - np.repeat(off[:-1], np.diff(off))
    out = low.copy()
    for back in range(1, ORDER):
        shifted = np.zeros(len(low), np.int64)
        shifted[back:] = low[:-back]
        shifted[place < back] = 0
        out |= shifted << (8 * back)
    return out


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def _counter(folds: int):
    names, width = ["gram", "seen", *(f"n{f}" for f in range(1, folds + 1))], folds + 1

    def made(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        g = k // width
        first = np.flatnonzero(np.diff(g, prepend=-1))
        wide = np.zeros((len(first), width), np.int64)
        wide[np.cumsum(np.diff(g, prepend=-1) != 0) - 1, k % width] = n
        wide[:, 0] = wide.sum(axis=1)
        for a in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(g[first[a : a + 100_000]]), *(pa.array(wide[a : a + 100_000, f]) for f in range(width))], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, seen, n1, ...): distinct n-grams of all texts, with their count in all and in the trusted ones of
        each fold; merged in the task. fold is 0 for texts that are not trusted."""
        keys, counts, held = [], [], 0
        for batch in batches:
            data, off = tk.utf8(batch.column(1))
            fold = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, part, own in tk.slices(data, off):
                k, n = np.unique(codes(part, own) * width + np.repeat(fold[first:end], np.diff(own)), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > 2_000_000:
                    k, n = _merge(keys, counts)
                    if len(k) > 1_000_000:
                        yield from made(k, n)
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [n], len(k)
        if keys:
            yield from made(*_merge(keys, counts))

    return count


def _discounts(counts: DataFrame, models: int) -> list[list[float]]:
    """Per model the modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    row = counts.agg(*(F.count_if(F.col(f"c{m}") == i).alias(f"c{m}_{i}") for m in range(models) for i in range(1, 5))).first()
    out = []
    for m in range(models):
        n = [0, *(row[f"c{m}_{i}"] or 0 for i in range(1, 5))]
        if not n[1] or not n[2]:
            out.append([0.5, 0.75, 0.9])
            continue
        y = n[1] / (n[1] + 2 * n[2])
        made = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.9 for i in range(1, 4)]
        out.append([min(max(d, 0.05), i - 0.05) for i, d in enumerate(made, 1)])
    return out


def log_probabilities(grams: DataFrame, folds: int) -> DataFrame:
    """(gram, seen, logp array<float>) for every gram of the corpus; grams: (gram, seen, n1, ...) as counted.

    logp holds a probability for each of folds + 1 models: first that of all trusted texts, then, for each fold, that
    of the trusted texts outside it. Interpolated modified Kneser-Ney: the highest order uses counts, each lower one
    the number of distinct bytes seen before an n-gram. Orders are built from 1 up by grouped counts and joins on
    shared prefixes and suffixes, all spread by key. An unseen context leaves the lower order's probability as it is.
    """
    models = range(folds + 1)
    mask = lambda k: (1 << (8 * k)) - 1
    every = sum((F.col(f"n{f}") for f in range(1, folds + 1)), F.lit(0))
    top = grams.select("gram", "seen", every.alias("c0"), *((every - F.col(f"n{f}")).alias(f"c{f}") for f in range(1, folds + 1)))
    seen = {ORDER: top.where("c0 > 0").select(F.col("gram").alias("g"), *(f"c{m}" for m in models))}
    for k in range(ORDER - 1, 0, -1):
        seen[k] = materialise(seen[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask(k))).alias("g")).agg(*(F.count_if(F.col(f"c{m}") > 0).alias(f"c{m}") for m in models)))
    below = None
    for k in range(1, ORDER + 1):
        cuts = []
        for m, d in enumerate(_discounts(seen[k], folds + 1)):
            c = F.col(f"c{m}")
            cuts.append(F.when(c >= 3, F.lit(d[2])).when(c == 2, F.lit(d[1])).when(c == 1, F.lit(d[0])).otherwise(F.lit(0.0)))
        context = seen[k].groupBy(F.shiftright("g", 8).alias("h")).agg(*(F.sum(f"c{m}").alias(f"t{m}") for m in models), *(F.sum(cuts[m]).alias(f"s{m}") for m in models))
        wanted = top.select(F.col("gram").bitwiseAND(F.lit(mask(k))).alias("g")).distinct() if k < ORDER else top.select(F.col("gram").alias("g"), "seen")
        p = wanted.join(seen[k], "g", "left").withColumn("h", F.shiftright("g", 8)).join(context, "h", "left")
        if below is None:
            p = p.withColumns({f"l{m}": F.lit(1 / 256) for m in models})
        else:
            p = p.withColumn("s", F.col("g").bitwiseAND(F.lit(mask(k - 1)))).join(below.select(F.col("g").alias("s"), *(F.col(f"p{m}").alias(f"l{m}") for m in models)), "s")
        made = []
        for m in models:
            own = F.coalesce(F.col(f"c{m}") - cuts[m], F.lit(0.0))
            made.append(F.when(F.col(f"t{m}") > 0, (own + F.col(f"s{m}") * F.col(f"l{m}")) / F.col(f"t{m}")).otherwise(F.col(f"l{m}")).alias(f"p{m}"))
        if k < ORDER:
            below = materialise(p.select("g", *made))
        else:
            below = p.select("g", "seen", *made)
    return below.select(F.col("g").alias("gram"), "seen", F.array(*(F.log(f"p{m}").cast("float") for m in models)).alias("logp"))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k1, k2, fold, n, nats, own, grams, times) of each text: its length, the sums over its common n-grams by
        the model of all and by that without its fold, and its other n-grams with their counts."""
        raw, values = shared.value
        table = Table(np.frombuffer(raw, np.int64))
        logp = np.frombuffer(values, np.float32).reshape(len(raw) // 8, -1) if raw else np.zeros((0, 1), np.float32)
        for batch in batches:
            data, off = tk.utf8(batch.column(batch.num_columns - 1))
            fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            nats, own, grams, times = [], [], [], []
            for first, end, part, bounds in tk.slices(data, off):
                c, n = codes(part, bounds), np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                at = table.get(c)
                known = at >= 0
                r, hit = row[known], at[known]
                nats.append(np.bincount(r, logp[hit, 0], len(n)))
                own.append(np.bincount(r, logp[hit, fold[first:end][r]], len(n)))
                rare, where = c[~known], np.searchsorted(row[~known], np.arange(len(n) + 1))
                for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
                    g, k = np.unique(rare[a:b], return_counts=True) if a < b else (rare[:0], rare[:0])
                    grams.append(g)
                    times.append(k)
            lists = []
            for parts in (grams, times):
                ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64())))
            sums = [pa.array(np.concatenate([*x, np.zeros(0)])) for x in (nats, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(off), pa.int64()), *sums, *lists], names=[*batch.schema.names[:-1], "n", "nats", "own", "grams", "times"])

    return score


def _with_fold(base: DataFrame, ids: DataFrame) -> DataFrame:
    """(fold, text) of all rows of base, fold 0 where ids has not their doc_id. A bitmap of the hashed ids, of fixed
    size, is sent to the tasks first, so that only texts whose bit is set are moved to be joined with ids."""
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)) + 1).alias("place")
    bits = ids.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    looked = base.select("doc_id", "fold", "text", place).withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(bits), "bucket", "left")
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    looked = looked.withColumn("maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    sure = looked.where("not maybe").select(F.lit(0).alias("fold"), "text")
    found = looked.where("maybe").select("doc_id", "fold", "text").join(ids.hint("shuffle_hash"), "doc_id", "left")
    return sure.unionByName(found.select(F.when(F.col("trusted"), F.col("fold")).otherwise(0).alias("fold"), "text"))


def quality_by_perplexity(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, low_quantile: float = 0.003, folds: int = 4, common: int = COMMON) -> DataFrame:
    """(doc_id, lang, perplexity, low, threshold, kept), a row for each row of docs.

    trusted: a table of ids (column id_col) whose texts train the model, all of them. perplexity is per byte of the
    lower-cased whole text, by a model that has not seen it: trusted ids are dealt by hash to folds, and a trusted
    text is scored by the counts of the other folds, any other text by all. low and threshold are the two quantiles of
    the trusted documents of the language (of all its documents where none is trusted), so they hold for new text as
    for trusted one; what lies between is kept (text that repeats itself is too predictable). Null, or empty, text: no
    perplexity, not kept. A null language is a language of its own. Null ids are scored but never trusted.

    N-grams are counted by tasks and summed by key. The common ones, a fixed number, are sent to the tasks with
    their probabilities and summed there; a text's other n-grams, made distinct in the task, are joined with the rest
    of the model by n-gram and summed per text, so nothing that grows with the corpus passes through the driver or one
    task and no frequent n-gram is shuffled. Texts with the same id, language and text share a key and come out as
    often as they came in. The result is the same at every value of common.
    """
    spark = docs.sparkSession
    ids = trusted.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    fold = (F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(folds)) + 1).cast("int")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).withColumn("fold", fold)
    marked = _with_fold(base, ids)
    columns = ", ".join(f"n{f} long" for f in range(1, folds + 1))
    counted = marked.mapInArrow(_counter(folds), f"gram long, seen long, {columns}").groupBy("gram")
    grams = materialise(counted.agg(F.sum("seen").alias("seen"), *(F.sum(f"n{f}").alias(f"n{f}") for f in range(1, folds + 1))))
    model = materialise(log_probabilities(grams, folds))
    # Counts in steps of an eighth of a power of two: as many of the upper steps as hold no more than common n-grams.
    step = F.floor(F.log2("seen") * 8)
    steps = sorted(model.groupBy(step.alias("step")).count().collect(), reverse=True)
    held = np.cumsum([r["count"] for r in steps])
    kept = [r["step"] for r, n in zip(steps, held, strict=True) if n <= common]
    sent = model.where(step >= kept[-1] if kept else F.lit(False)).select("gram", "logp").toArrow()
    keys = sent["gram"].to_numpy()
    shared = spark.sparkContext.broadcast((keys.astype(np.int64).tobytes(), sent["logp"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).tobytes()))

    keyed = base.select(*(F.xxhash64(F.lit(i), F.isnull("doc_id"), F.isnull("lang"), F.isnull("text"), "doc_id", "lang", "text").alias(f"k{i}") for i in (1, 2)), "fold", "doc_id", "lang", "text")
    id_type = base.schema["doc_id"].dataType.simpleString()
    scored = materialise(keyed.mapInArrow(_scorer(shared), f"k1 long, k2 long, fold int, doc_id {id_type}, lang string, n long, nats double, own double, grams array<long>, times array<long>"))
    alike = scored.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in ("doc_id", "lang", "n", "nats", "own")), F.count("*").alias("copies"))
    rare = scored.where(F.size("grams") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", "fold", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("k1", "k2", "fold", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))
    met = rare.join(model.select("gram", "logp"), "gram").groupBy("k1", "k2").agg(F.sum(F.col("times") * F.get("logp", F.lit(0)).cast("double")).alias("more"), F.sum(F.col("times") * F.get("logp", F.col("fold")).cast("double")).alias("more_own"))
    each = alike.join(met, ["k1", "k2"], "left").join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    total = F.when(F.col("trusted"), F.col("own") + F.coalesce("more_own", F.lit(0.0))).otherwise(F.col("nats") + F.coalesce("more", F.lit(0.0)))
    perplexity = F.when(F.col("n") > 0, F.exp(-total / F.col("n")))
    each = materialise(each.select("doc_id", "lang", "trusted", perplexity.alias("perplexity"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy"))
    both = [low_quantile, quantile]
    cuts = F.coalesce(F.percentile_approx(F.when(F.col("trusted"), F.col("perplexity")), both, 10000), F.percentile_approx("perplexity", both, 10000))
    by_lang = each.groupBy(F.col("lang").alias("l")).agg(cuts.alias("cuts"))
    out = each.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    low, high = F.get("cuts", F.lit(0)), F.get("cuts", F.lit(1))
    return out.select("doc_id", "lang", "perplexity", low.alias("low"), high.alias("threshold"), F.coalesce(F.col("perplexity").between(low, high), F.lit(False)).alias("kept"))
