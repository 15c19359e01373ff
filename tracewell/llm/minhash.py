"""Near-duplicate documents: MinHash signatures, banding, confirmation on full sets, star-shaped components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialise
from .components import connected_components, joined_components

#: A task that compares members of one bucket takes about so many of them, and of their shingles, twice at most.
BLOCK_DOCS, BLOCK_SHINGLES = 400, 1_000_000
_rng = np.random.default_rng(75)
_MUL = _rng.integers(1, 1 << 63, 512, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 512, dtype=np.uint64)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(rows, n) minima of n multiply-add-shift hashes over each row's set; every set must hold something."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((n, len(sets)), np.uint32)
    for j in range(n):
        out[j] = np.minimum.reduceat(((flat * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) keys: equal where all minima of the band are."""
    x = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * tk.BASE
    for r in range(rows):
        key = tk.mix(key ^ (x[:, :, r] * tk.NEXT_WORD))
    return key.view(np.int64)


def _signer(k: int, bands: int, rows: int, out: pa.Schema):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tk.utf8(batch.column(1))
            for first, end, part, own in tk.slices(data, off):
                sets = tk.shingle_sets(part, own, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                hi, lo = np.zeros(end - first, np.int64), np.zeros(end - first, np.int64)
                sigs, keys = [None] * (end - first), [None] * (end - first)
                if full:
                    sig = minima([sets[i] for i in full], bands * rows)
                    key = band_keys(sig, bands, rows)
                    for at, i in enumerate(full):
                        sigs[i], keys[i] = sig[at].tobytes(), key[at]
                        hi[i] = np.bitwise_xor.reduce(tk.mix(sets[i])).view(np.int64)
                        lo[i] = np.add.reduce(sets[i]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi), pa.array(lo), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=out
                )

    return sign


def _setter(k: int, out: pa.Schema):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tk.utf8(batch.column(1))
            for first, end, part, own in tk.slices(data, off):
                made = [s.tobytes() for s in tk.shingle_sets(part, own, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(made, pa.binary())], schema=out)

    return sets


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal minima of the two signatures."""
    for batch in batches:
        a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
        b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
        est = (a == b).mean(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], names=["a", "b", "est"])


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return confirm


def linked_matrix(rows: list[np.ndarray], cols: list[np.ndarray], percent: int, width: int = 4096) -> np.ndarray:
    """(len(rows), len(cols)) booleans: sets that reach percent of Jaccard similarity, by products of 0/1 matrices."""
    flat = np.concatenate([*rows, *cols])
    owner = np.repeat(np.arange(len(rows) + len(cols)), [len(x) for x in (*rows, *cols)])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[code] > 1
    owner, code = owner[shared], code[shared]
    code = np.unique(code, return_inverse=True)[1]
    common = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (first, first + width))
        m = np.zeros((len(rows) + len(cols), width), np.float32)
        m[owner[a:b], code[a:b] - first] = 1
        common += m[: len(rows)] @ m[len(rows) :].T
    sizes = np.array([[len(x)] for x in rows]) + np.array([len(x) for x in cols])
    return 100 * common >= percent * (sizes - common)


def _closer(percent: int):
    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block of a bucket's outsiders against a block of its members: (component, smallest component it joins)."""
        pdf = pdf.sort_values("doc_id")
        asks = pdf["asks"].to_numpy()
        comp, names = pd.factorize(pdf["component"], sort=True)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        out, members = np.flatnonzero(asks), np.flatnonzero(~asks)
        root = np.arange(len(names))

        def find(u: int) -> int:
            while root[u] != u:
                root[u] = root[root[u]]
                u = root[u]
            return u

        sizes = np.array([len(x) for x in sets])
        for a in range(0, len(out), 512):
            some = out[a : a + 512]
            # A set under percent of the other's size cannot be linked with it.
            fits = members[(100 * sizes[members] >= percent * sizes[some].min()) & (percent * sizes[members] <= 100 * sizes[some].max())]
            for b in range(0, len(fits), 2048):
                part = fits[b : b + 2048]
                i, j = np.nonzero(linked_matrix([sets[x] for x in some], [sets[x] for x in part], percent))
                for u, v in np.unique(np.stack([comp[some[i]], comp[part[j]]], 1), axis=0).tolist():
                    u, v = find(u), find(v)
                    root[max(u, v)] = min(u, v)
        lead = np.array([find(u) for u in range(len(root))], np.int64)
        return pd.DataFrame({"a": names[np.arange(len(root)) != lead], "b": names[lead[np.arange(len(root)) != lead]]})

    return close


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, slack: float = 0.25) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Words are runs of non-space characters, A-Z lower-cased; a document's set holds its distinct k-word shingles
    (its whole sequence when it has fewer words; nothing without words). Two documents are linked when their sets
    reach percent of Jaccard similarity; component_id is the smallest id that links reach.

    Documents of one set are one node. bands x rows minima are banded; in each bucket members are paired with a
    pivot, not with each other. Pairs whose signatures agree in less than percent - slack are left out (six
    standard deviations), the others are confirmed on full sets, first the likeliest pivot of each document, then
    the pivots in other components. Where the members of a bucket are still in several components, those outside
    its largest one are held against all members on full sets, a task for each block of them and block of
    members, and only which components join comes out. So copies never become all pairs, and no link of a bucket is
    lost. A pair at just
    the threshold shares no bucket with probability (1 - 0.75^rows)^bands = 5e-6.

    Null, empty or blank text: no shingles, own component. Null id: no component, kept. Rows with the same id
    count as one document. Only the id and text columns are read, so other columns cannot clash. Long texts are
    worked on whole.
    """
    kind = docs.schema[id_col].dataType
    id_type = kind.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    arrow_id = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    if id_type not in ("bigint", "int", "string"):
        base = base.withColumn("doc_id", F.col("doc_id").cast("bigint"))
        id_type, arrow_id = "bigint", pa.int64()
    signed = pa.schema([("doc_id", arrow_id), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])
    sig = materialise(base.mapInArrow(_signer(k, bands, rows, signed), f"doc_id {id_type}, n_shingles long, hi long, lo long, sig binary, keys array<long>"))

    real = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = materialise(real.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("rep")))
    nodes = real.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    keyed = nodes.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("top")).where("pivot < top").select("key", "pivot")
    members = materialise(keyed.join(pivots, "key"))
    signatures = real.select("doc_id", "sig").dropDuplicates(["doc_id"])
    floor = percent / 100 - slack

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures agree often enough."""
        p = pairs.join(signatures.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a")
        p = p.join(signatures.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
        return p.mapInArrow(_estimates, f"a {id_type}, b {id_type}, est double").where(F.col("est") >= floor)

    star = materialise(likely(members.where("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()))
    ids = members.select("doc_id").distinct()
    made = pa.schema([("doc_id", arrow_id), ("shingles", pa.binary())])
    full = materialise(base.join(ids, "doc_id", "left_semi").mapInArrow(_setter(k, made), f"doc_id {id_type}, shingles binary").dropDuplicates(["doc_id"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        p = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        p = p.join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
        return materialise(p.mapInArrow(_confirmer(percent), f"a {id_type}, b {id_type}, linked boolean"))

    def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        ca, cb = (comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    best = star.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b")
    links = confirmed(best).where("linked").select("a", "b")
    comps = connected_components(links)
    rest = across(star.join(best, ["a", "b"], "left_anti"), comps)
    comps = joined_components(comps, confirmed(rest).where("linked").select("a", "b"))

    # Buckets whose members are still in several components: those outside the bucket's largest component ask all
    # others, in blocks. Sizes are counted first, so that each row knows how many blocks there are.
    own = members.select("key", "doc_id", "n_shingles").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    held = own.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    blocks = lambda n, weight: F.greatest(F.ceil(n / F.lit(BLOCK_DOCS)), F.ceil(weight / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    split = held.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("large"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.struct("n", "component", "weight")).alias("most")).where("parts > 1 and n > 2")
    split = split.select("key", "large", blocks(F.col("n"), F.col("weight")).alias("blocks"), blocks(F.col("n") - F.col("most.n"), F.col("weight") - F.col("most.weight")).alias("asking"))
    dealt = materialise(own.join(split, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit("asks")), F.col("asking")).cast("int")))
    to_all = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asks = dealt.where("component != large").select("key", "doc_id", "component", "group", to_all("blocks").alias("block"), F.lit(True).alias("asks"))
    told = dealt.select("key", "doc_id", "component", to_all("asking").alias("group"), "block", F.lit(False).alias("asks"))
    closing = asks.unionByName(told).join(full, "doc_id").groupBy("key", "group", "block").applyInPandas(_closer(percent), f"a {id_type}, b {id_type}")
    found = materialise(closing.distinct())
    if not found.isEmpty():
        comps = joined_components(comps, found)

    named = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", "n_shingles", F.coalesce("component", "rep").alias("group_id"))
    one = sig.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.least("group_id", "doc_id")).otherwise(F.col("doc_id"))
    return one.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
