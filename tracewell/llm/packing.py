"""Packing without padding: each document's tokens are cut into pieces whose lengths are powers of two, and every piece is
a sequence of its own, so that no sequence holds two documents; sequences of one length form a bucket."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .textkit import slices, utf8

#: Bounds on the chunks between white space that a worker remembers with their ids, and on the pieces of chunks; beyond
#: them the half of the chunks that served most stays, and the pieces of the last turn.
CACHE_CHUNKS = 1 << 20
CACHE_BYTES = 64 << 20
CACHE_PIECES = 1 << 18
#: Bytes of text that are encoded at once: a chunk is looked up once among them.
ENCODED = 4 << 20


class PieceIds(dict):
    """The ids that the model gives to a piece, as 32-bit numbers in bytes: Python's garbage collector would look through
    lists again and again."""

    def __init__(self, model):
        super().__init__()
        self.model, self.last = model, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.last.get(piece)
        if len(self) >= CACHE_PIECES // 2:
            self.last = dict(self)
            self.clear()
        self[piece] = found = array("i", [t.id for t in self.model.tokenize(piece)]).tobytes() if found is None else found
        return found


class ChunkIds(dict):
    """The ids of chunks between ASCII white space. No token of a tokenizer that drops white space crosses it, so the ids
    of a text are those of its chunks, and every distinct chunk is tokenized once. The empty chunk, without ids, is 0."""

    def __init__(self, path: str):
        super().__init__()
        # A task has its core; the library's own threads would take those of others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if [*self._whole(["a b c"])[0]] != [i for ids in self._whole(["a", "b", "c"]) for i in ids]:
            raise ValueError(f"{path} keeps white space")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"[^\S ]", *map(re.escape, added)]))
        self.pieces = PieceIds(self.tokenizer.model)
        self.bytes = 0
        self[b""] = 0
        self.flat, self.begin, self.uses = np.zeros(0, np.int32), np.zeros(2, np.int64), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keep at most half of the chunks, and half of the bytes: those of two or more uses, the most used first."""
        self.uses[0] = np.iinfo(np.int64).max  # the empty chunk stays the first
        chunks, order = [*self], np.argsort(-self.uses, kind="stable")[: len(self) // 2]
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))[order]
        order = order[(self.uses[order] > 1) & (np.cumsum(size) <= CACHE_BYTES // 2)]
        self.clear()
        self.update(zip((chunks[i] for i in order.tolist()), itertools.count()))
        self.bytes = sum(map(len, self))
        size = np.diff(self.begin)[order]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.begin[order] - (ends - size), size) + np.arange(int(size.sum()))]
        self.begin, self.uses = np.concatenate([[0], ends]), np.zeros(len(order), np.int64)

    def _whole(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _one_by_one(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = self._whole([c.decode() for c in chunks])
        return np.fromiter(itertools.chain.from_iterable(made), np.int32), np.fromiter(map(len, made), np.int64, len(made))

    def _together(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and how many each has. They are normalised and cut in pieces as one text, and a piece goes
        through the model once."""
        from tokenizers import PreTokenizedString

        text, normal = b" ".join(chunks).decode(), self.tokenizer.normalizer
        text = normal.normalize_str(text) if normal else text
        blanks = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
        if len(blanks) != len(chunks) - 1:  # the normaliser makes or drops blanks
            return self._one_by_one(chunks)
        # Not pre_tokenize_str(): it counts the characters before each piece.
        cut = PreTokenizedString(text)
        self.tokenizer.pre_tokenizer.pre_tokenize(cut)
        pieces = cut.get_splits("original", "byte")
        made = [*map(self.pieces.__getitem__, [piece for piece, _, _ in pieces])]
        of = np.searchsorted(blanks, np.fromiter([at[0] for _, at, _ in pieces], np.int64, len(pieces)))
        size = np.bincount(of, np.fromiter(map(len, made), np.int64, len(made)) // 4, len(chunks)).astype(np.int64)
        return np.frombuffer(b"".join(made), np.int32), size

    def _learn(self, chunks: list[bytes]) -> None:
        """Chunks with added tokens, or with white space of other kinds in them, are tokenized one by one."""
        odd = []
        if self.odd.search(b" ".join(chunks).decode()):
            odd = [c for c in chunks if self.odd.search(c.decode())]
            chunks = [c for c in chunks if not self.odd.search(c.decode())]
        for some, tokenize in ((chunks, self._together), (odd, self._one_by_one)):
            if some:
                ids, size = tokenize(some)
                self.update(zip(some, itertools.count(len(self))))
                self.flat, self.begin = np.concatenate([self.flat, ids]), np.concatenate([self.begin, np.cumsum(size) + self.begin[-1]])
                self.bytes += sum(map(len, some))
                self.uses = np.concatenate([self.uses, np.zeros(len(some), np.int64)])

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end_id after each, and how many each text has."""
        if len(self) > CACHE_CHUNKS or self.bytes > CACHE_BYTES:
            self.forget()
        # Arrow cuts the texts and finds the distinct chunks; these alone are looked up. Blanks at an end, and no text, make
        # empty chunks.
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        found = words.values.dictionary_encode()
        chunks = found.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(chunks[new].tolist())
            at[new] = np.fromiter(map(self.get, chunks[new]), np.int64, len(new))
        of = found.indices.to_numpy()
        self.uses[at] += np.bincount(of, minlength=len(at))
        begin, size = self.begin[at][of], (self.begin[at + 1] - self.begin[at])[of]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - ends[:-1], size) + np.arange(int(ends[-1]))]
        last = ends[words.offsets.to_numpy()[1:]]
        return np.insert(ids, last, end_id), np.diff(last, prepend=0) + 1


_KNOWN: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """What this Python worker knows already from tasks before."""
    if path not in _KNOWN:
        _KNOWN[path] = ChunkIds(path)
    return _KNOWN[path]


def binary_lengths(tokens: int, longest: int) -> list[int]:
    """Lengths of a document's pieces, the longest first: its whole blocks, then the powers of two of what is left."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_documents(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, doc_tokens, bucket, ids, ids_crc32, part, nth): the pieces of every document, each within one
    task; nth counts the pieces of a bucket within its part of the input."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(tokenizer)
        part = TaskContext.get().partitionId()
        count = np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for row, end, some, cuts in slices(data, off, ENCODED):
                raw = some.tobytes()
                ids, tokens = known.encode([raw[a:b] for a, b in itertools.pairwise(cuts.tolist())], end_id)
                lengths = [binary_lengths(t, longest) for t in tokens.tolist()]
                pieces = np.fromiter(map(len, lengths), np.int64, len(lengths))
                length = np.fromiter(itertools.chain.from_iterable(lengths), np.int64)
                doc = np.repeat(np.arange(len(tokens)), pieces)
                ends = np.cumsum(length)
                start = ends - length - np.repeat(np.cumsum(tokens) - tokens, pieces)
                bucket = np.log2(length).astype(np.int64)
                nth = np.zeros(len(length), np.int64)
                for b in np.unique(bucket).tolist():
                    mine = np.flatnonzero(bucket == b)
                    nth[mine] = count[b] + np.arange(len(mine))
                    count[b] += len(mine)
                octets, ends4 = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist()
                checks = [zlib.crc32(octets[a:b]) for a, b in zip([0, *ends4[:-1]], ends4, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, end - row).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(tokens[doc]),
                        pa.array(bucket, pa.int32()), lists, pa.array(checks, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "bucket", "ids", "ids_crc32", "part", "nth"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, bucket int, ids array<int>, ids_crc32 long, part int, nth long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, doc_tokens, bucket, ids, ids_crc32, sequence_id, offset): one row for each piece, which is a
    sequence whole; offset is 0 and nothing is padded. bucket is log2 of the length, sequences are numbered bucket by
    bucket, and the checksum is that of the ids as unsigned 32-bit numbers, little end first.

    A null or empty text is end_id alone, a text of any length is cut whole, rows of one id or of none are documents of
    their own, an empty table gives no rows; other columns are not looked at. Texts are tokenized once and never
    shuffled: pieces are written where they arise, and only how many a task has of each length decides the numbers.
    """
    pieces = materialise(cut_documents(docs, tokenizer, longest, end_id))
    counts = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    # As many rows as tasks times lengths; written, so that Spark knows the size that decides whether it is broadcast.
    first = F.sum("n").over(W.orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1))
    first = materialise(counts.select("bucket", "part", F.coalesce(first, F.lit(0)).alias("first")))
    numbered = pieces.join(first, ["bucket", "part"])
    return numbered.select("doc_id", "start", "length", "doc_tokens", "bucket", "ids", "ids_crc32", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each length: a training batch is drawn from one of them and needs no padding."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def packing_digest(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """pack_documents() without the ids themselves."""
    return pack_documents(docs, tokenizer, longest, end_id).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
