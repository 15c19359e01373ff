"""Toxicity by a counterfactually regularised linear classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import held_out

#: Terms that name groups of people. Within a row each term is swapped for the next one.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("white", "black", "asian", "latino", "african", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("father", "mother"), ("son", "daughter"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("blind", "deaf", "disabled"), ("old", "young"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"), ("homme", "femme"), ("hommes", "femmes"), ("noir", "blanc", "arabe"),
    ("christ", "muslim", "jude", "hindu", "buddhist"), ("mann", "frau"), ("männer", "frauen"), ("schwarze", "weiße"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"), ("hombre", "mujer"), ("hombres", "mujeres"), ("negro", "blanco", "árabe"),
)
# A term of several rows belongs to the first.
_NEXT = {t: row[(i + 1) % len(row)] for row in reversed(IDENTITY_TERMS) for i, t in enumerate(row)}
_TERM = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")(?!\w)", re.I)
BITS = 18
#: A word counts as a whole and by its first so many bytes.
PREFIXES = (4, 5, 6, 7)


def swap_terms(text: str) -> str:
    """text with every identity term replaced by the next of its row."""
    return _TERM.sub(lambda m: _NEXT[m[0].lower()], text)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, row of each word): buckets has one line per kind of feature, one column per word."""
    starts, ends, row = tk.word_bounds(data, off, tk.WORDCHAR)
    sums = tk.prefix_sums(data)
    shift = np.uint64(64 - BITS)
    kinds = [tk.span_hashes(sums, starts, ends) >> shift]
    for n in PREFIXES:
        kinds.append(tk.mix(tk.span_hashes(sums, starts, np.minimum(ends, starts + n)) + np.uint64(n)) >> shift)
    return np.array(kinds).astype(np.int32).reshape(len(kinds), -1), row


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text distinct buckets and count / sqrt(number of words)."""
    data, off = tk.utf8(pa.array(texts, pa.large_string()))
    out = []
    for first, end, part, own in tk.slices(data, off):
        buckets, row = features(part, own)
        at = np.searchsorted(row, np.arange(end - first + 1))
        for a, b in zip(at[:-1], at[1:], strict=True):
            ids, n = np.unique(buckets[:, a:b], return_counts=True)
            out.append((ids.astype(np.int32), (n / np.sqrt(max(1, b - a))).astype(np.float32)))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts, and of their swapped forms where a text names a group."""
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        own = _sparse(texts)
        swapped = [swap_terms(t) for t in texts]
        other = {i: s for i, s in zip([i for i, t in enumerate(texts) if swapped[i] != t], _sparse([s for s, t in zip(swapped, texts, strict=True) if s != t]), strict=True)}
        none = (np.zeros(0, np.int32), np.zeros(0, np.float32))
        cols = [[a.tobytes() for a, _ in own], [v.tobytes() for _, v in own], [other.get(i, none)[0].tobytes() for i in range(len(own))], [other.get(i, none)[1].tobytes() for i in range(len(own))]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in cols)], names=["y", "ids", "values", "swap_ids", "swap_values"])


class _Matrix:
    """Rows of (ids, values) with the products that a gradient needs."""

    def __init__(self, ids: list[bytes], values: list[bytes]):
        parts = [np.frombuffer(x, np.int32) for x in ids]
        self.rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.ids = np.concatenate([*parts, np.zeros(0, np.int32)])
        self.values = np.concatenate([*(np.frombuffer(x, np.float32) for x in values), np.zeros(0, np.float32)])
        self.n = len(parts)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.ids], self.n)

    def spread(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, self.values * r[self.rows], 1 << BITS)


def fit_weights(y: np.ndarray, x: _Matrix, swap: _Matrix, has_swap: np.ndarray, l2: float = 2e-4, fairness: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights and, last, the bias. Minimises class-balanced log loss + l2 |w|^2 + fairness * mean((score change of
    the swapped text)^2), so that a group's name by itself moves no score. Adam on the full sample."""
    size = (1 << BITS) + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    pos = max(1, int(y.sum()))
    share = np.where(y > 0, 0.5 / pos, 0.5 / max(1, len(y) - pos))
    pairs = max(1, int(has_swap.sum()))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + w[-1], -40, 40)))
        r = share * (p - y)
        g = np.append(x.spread(r) + 2 * l2 * w[:-1], r.sum())
        if has_swap.any():
            q = 1 / (1 + np.exp(-np.clip(swap.dot(w) + w[-1], -40, 40)))
            gap = np.where(has_swap, 2 * fairness * (p - q) / pairs, 0.0)
            g[:-1] += x.spread(gap * p * (1 - p)) - swap.spread(gap * q * (1 - q))
            g[-1] += (gap * (p * (1 - p) - q * (1 - q))).sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 6000, sample_bytes: int = 64 << 20) -> np.ndarray:
    """Learn from labelled documents that are not held out: from all of them, or from about sample ids, chosen by a hash
    of the id, and of their different texts about as many, of about sample_bytes in all, chosen by a hash of id and text.
    So many rows of one id, or of one id and text, pass neither bound.

    Tasks turn whole texts, and their swapped forms, into hashed features; what reaches the driver is bounded by
    both (at most eight bytes for each of five features of a word, twice where a text has a swapped form). Null labels and texts teach nothing. Without both classes the weights are 0.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    some = known.where(place < F.lit(int(sample / n * (1 << 30)))) if n > sample else known
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # some holds about sample ids by construction
    rows = texts.join(F.broadcast(some), "doc_id").withColumn("h", F.xxhash64("doc_id", "text", F.lit("toxicity")))
    whole = rows.groupBy("h").agg(F.first(F.octet_length("text")).alias("bytes")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    share = min(1.25 * sample / max(1, whole["n"]), sample_bytes / max(1, whole["bytes"] or 0))
    if share < 1:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    chosen = rows.groupBy("h").agg(F.first("y").alias("y"), F.first("text").alias("text"))
    got = chosen.select("y", "text").mapInArrow(_rows, "y double, ids binary, values binary, swap_ids binary, swap_values binary").toPandas()
    got = got.assign(k=got["ids"].map(len)).sort_values(["y", "k", "ids"])
    y = (got["y"].to_numpy() > 0.5).astype(float)
    if len(set(y)) < 2:
        return np.zeros((1 << BITS) + 1)
    x, swap, has_swap = _Matrix(got["ids"], got["values"]), _Matrix(got["swap_ids"], got["swap_values"]), (got["swap_ids"].map(len) > 0).to_numpy()
    del got  # the matrices hold it all
    return fit_weights(y, x, swap, has_swap)


def score_batch(data: np.ndarray, off: np.ndarray, w: np.ndarray) -> np.ndarray:
    buckets, row = features(data, off)
    each = np.zeros(buckets.shape[1])
    for line in buckets:
        each += w[line]
    n = np.bincount(row, minlength=len(off) - 1)
    z = np.bincount(row, each, len(off) - 1) / np.sqrt(np.maximum(n, 1)) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_toxicity(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs and score (0 to 1) of every whole text; a narrow operation, only the text is scored.

    Null or empty text gets the score of no words, the model's prior. Repeated rows get equal scores. The weights
    (2^18 numbers, 1 MB) are sent to the tasks. Other columns of docs are not read.
    """
    w = weights.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tk.utf8(batch.column(batch.num_columns - 1))
            made = [score_batch(part, own, w) for _, _, part, own in tk.slices(data, off)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([*made, np.zeros(0)]))], names=[*batch.schema.names[:-1], "score"])

    src = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return src.mapInArrow(score, T.StructType([*src.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(docs, fit_toxicity(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
