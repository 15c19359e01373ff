"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import held_out

#: Families of common languages by ISO 639-1 code. A code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si", "or", "as"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
    "semitic": ("ar", "he", "am", "mt"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
DIM = 1 << 12


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte the bucket of the three lower-cased bytes that start there (a row's last two reach over its end
    into a space). UTF-8 makes the trigrams of Latin letters with marks longer in weight, never ambiguous."""
    low = tk.LOWER[data].astype(np.uint32)
    low[~tk.NONSPACE[data]] = 32
    second = np.full(len(low), 32, np.uint32)
    third = np.full(len(low), 32, np.uint32)
    second[:-1], third[:-2] = low[1:], low[2:]
    ends = off[1:][off[1:] > off[:-1]]
    second[ends - 1] = 32
    third[ends - 1] = 32
    third[np.maximum(ends - 2, 0)] = 32
    h = (low * np.uint32(0x01000193) ^ second) * np.uint32(0x9E3779B1) ^ third
    h = h * np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - 12)).astype(np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, trigram shares as float32 bytes) of each text."""
    for batch in batches:
        data, off = tk.utf8(batch.column(1))
        for first, end, part, own in tk.slices(data, off):
            g, out = grams(part, own), []
            for a, b in zip(own[:-1], own[1:], strict=True):
                out.append((np.bincount(g[a:b], minlength=DIM) / max(1, b - a)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(out, pa.binary())], names=["lang", "x"])


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge) by Newton-free gradient descent with momentum; y is +1 or -1."""
    norms = np.einsum("ij,ij->i", x, x)
    scale = np.float32(1.0 / max(np.sqrt(norms.mean()), 1e-12))
    z = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.multiply(x, scale, out=z[:, :-1])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * 100
    y, w = y.astype(np.float32), np.zeros(z.shape[1], np.float32)
    v = w
    step = np.float32(1.0 / (1.0 + 2 * (share * (norms * scale**2 + 1)).sum()))
    share = share.astype(np.float32)
    for t in range(rounds):
        ahead = w + np.float32(t / (t + 3)) * (w - v)
        lack = np.maximum(0, 1 - y * (z @ ahead))
        grad = ahead - 2 * ((share * y * lack) @ z)
        w, v = ahead - step * grad, w
    out = w.copy()
    out[:-1] *= scale
    return out


class LanguageModel:
    """families: names; family_w: one row of weights per family (one against the rest); pairs: SVMs by family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        fam = [_FAMILY.get(c, c) for c in langs]
        self.families = sorted(set(fam))
        rows, self.pairs = [], []
        for f in self.families:
            rows.append(_svm(x, np.where(np.array(fam) == f, 1.0, -1.0)) if len(self.families) > 1 else np.zeros(DIM + 1))
        self.members = [[i for i, c in enumerate(self.langs) if _FAMILY.get(c, c) == f] for f in self.families]
        at = np.array([self.langs.index(c) for c in langs], np.int64)
        for f, own in enumerate(self.members):
            for a, b in combinations(own, 2):
                chosen = (at == a) | (at == b)
                rows.append(_svm(x[chosen], np.where(at[chosen] == a, 1.0, -1.0)))
                self.pairs.append((f, a, b))
        self.weights = np.array(rows, np.float32).reshape(-1, DIM + 1)

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its score for each row; the rows must not be empty."""
        g, n, k = grams(data, off), np.diff(off), len(self.families)
        margins = np.stack([np.add.reduceat(w[:-1][g], off[:-1]) / n + w[-1] for w in self.weights[:k]], 1)
        family = margins.argmax(axis=1)
        odds = np.exp(2 * (margins - margins.max(axis=1, keepdims=True)))
        score = (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)
        best = np.array([own[0] for own in self.members])[family]
        for f, own in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            if len(own) == 1 or not len(rows):
                continue
            # Only the machines of the chosen family look at a text.
            part = g if len(rows) == len(n) else g[np.repeat(family == f, n)]
            starts = np.cumsum([0, *n[rows][:-1]])
            votes, support, p = (np.zeros((len(rows), len(self.langs))) for _ in range(3))
            p += 1
            for j, (at, a, b) in enumerate(self.pairs):
                if at == f:
                    w = self.weights[k + j]
                    m = np.add.reduceat(w[:-1][part], starts) / n[rows] + w[-1]
                    votes[:, a] += m >= 0
                    votes[:, b] += m < 0
                    support[:, a] += m
                    support[:, b] -= m
                    q = 1 / (1 + np.exp(-3 * np.clip(m, -30, 30)))
                    p[:, a], p[:, b] = np.minimum(p[:, a], q), np.minimum(p[:, b], 1 - q)
            best[rows] = np.array(own)[(votes + 1e-3 * np.tanh(support))[:, own].argmax(axis=1)]
            score[rows] = np.minimum(score[rows], p[np.arange(len(rows)), best[rows]])
        return best, score


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200) -> LanguageModel | None:
    """Learn from text and non-null lang of the documents that are not held out: of the different (id, text) of each
    language about per_language, all where it has no more, and at most 2 * per_language, chosen by a hash of id and text.
    So null and repeated ids make no difference, and no language that has a text with a letter is missed. Whole texts are
    reduced to trigram shares by tasks, after the choice is made in Spark; what reaches the driver is bounded by
    2 * per_language * languages * 16 KiB. None without any row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text", F.lit("langid")).alias("h"))
    counts = rows.groupBy("lang", "h").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(per_language) / F.col("n"))
    # A row for each language, as many as the model itself has.
    chosen = rows.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < share * F.lit(1 << 30))
    chosen = chosen.groupBy("lang", "h").agg(F.first("text").alias("text"))
    chosen = chosen.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= 2 * per_language)
    got = chosen.select("lang", "text").mapInArrow(_features, "lang string, x binary").toPandas()
    got = got.assign(h=got["x"].map(zlib.crc32)).sort_values(["lang", "h", "x"])
    if not len(got):
        return None
    return LanguageModel(np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), DIM), got["lang"].tolist())


def _predictor(model: LanguageModel | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.large_string()), "")
            letter = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if model is not None and letter.any():
                where = np.flatnonzero(letter)
                data, off = tk.utf8(column.filter(pa.array(letter)))
                for first, end, part, own in tk.slices(data, off):
                    best, s = model.predict(part, own)
                    lang[where[first:end]] = np.array(model.langs, object)[best]
                    score[where[first:end]] = s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, lang_pred and score (0 to 1) of every whole text; rows are not moved.

    lang_pred is a learned language, or und with score 0 where the text is null or has no letter (or nothing was
    learnt). Only the text decides. Repeated rows get the same answer; other columns of docs are not read.
    """
    src = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return src.mapInArrow(_predictor(model), T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_digest(docs: DataFrame) -> DataFrame:
    out = identify(docs, fit_languages(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
