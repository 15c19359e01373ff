"""Periodic runs of words, found in a grammar of the text.

The word ids of a slice of documents are compressed by Re-Pair. A run of the text lies whole inside some symbol of the
derivation and crosses the boundary between that symbol's two parts, so it is enough to look at each symbol's boundary
once, where it first occurs; what is found there holds wherever the symbol is derived. Intervals of one period that
belong together are merged. Everything works on arrays over the whole slice, never word by word.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import mix, slices, utf8

#: Fixed by the definition of a run: at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_NEVER = np.iinfo(np.int64).max


class Grammar:
    """Re-Pair over several documents, in rounds: of the pairs that occur at least twice, each round replaces all that are
    more frequent than those they overlap with (the most frequent pair always among them), until no pair recurs.

    Symbols from first_rule on are rules: left and right part, length, and where the symbol first occurs. What is left of
    the documents is (symbols, at, first): start of each and whether it begins a document.
    """

    def __init__(self, ids: np.ndarray, off: np.ndarray, n_words: int):
        self.first_rule = n_words
        s, at = ids.astype(np.int64), np.arange(len(ids))
        first = np.zeros(len(ids) + 1, bool)
        first[off[:-1][off[:-1] < len(ids)]] = True
        first[len(ids)] = True
        first = first[:-1]
        # alive[i]: the pair of i and i + 1 may recur; a pair that does not never will, unless a part is replaced.
        alive = np.append(~first[1:], False) if len(s) else np.zeros(0, bool)
        left, right, length, begin = [], [], [np.ones(n_words, np.int64)], []
        known, self.rounds = n_words, [n_words]
        while True:
            i = np.flatnonzero(alive)
            if len(i) < 2:
                break
            key = s[i] * known + s[i + 1]
            # Of equal pairs that overlap (x x x) every second one counts.
            new = np.ones(len(i), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1] + 1)
            start = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
            even = (np.arange(len(i)) - start) % 2 == 0
            pairs, kind = np.unique(key, return_inverse=True)
            count = np.bincount(kind[even], minlength=len(pairs))
            often = count >= 2
            if not often.any():
                break
            rank = np.full(len(pairs), _NEVER)
            order = np.lexsort((mix(pairs.astype(np.uint64)), -count))
            rank[order] = np.arange(len(pairs))
            rank[~often] = _NEVER
            alive[i[~often[kind]]] = False
            r = np.full(len(s) + 2, _NEVER)  # one place to either side
            r[i + 1] = rank[kind]
            here = r[1:-1]
            best = (here < _NEVER) & (here <= r[:-2]) & (here <= r[2:])
            j = np.flatnonzero(best)
            new = np.ones(len(j), bool)
            new[1:] = j[1:] != j[:-1] + 1
            start = np.maximum.accumulate(np.where(new, np.arange(len(j)), 0))
            j = j[(np.arange(len(j)) - start) % 2 == 0]
            chosen, kind, count = np.unique(here[j], return_inverse=True, return_counts=True)
            keep = count >= 2
            name = np.cumsum(keep) - 1 + known
            j, kind = j[keep[kind]], kind[keep[kind]]
            _, one = np.unique(kind, return_index=True)  # where each rule first occurs
            sizes = np.concatenate(length)
            left.append(s[j[one]])
            right.append(s[j[one] + 1])
            begin.append(at[j[one]])
            length.append(sizes[s[j[one]]] + sizes[s[j[one] + 1]])
            s[j] = name[kind]
            known += int(keep.sum())
            self.rounds.append(known)
            stay = np.ones(len(s), bool)
            stay[j + 1] = False
            touched = np.zeros(len(s), bool)
            touched[j] = True
            s, at, first, touched, alive = s[stay], at[stay], first[stay], touched[stay], alive[stay]
            beside = np.append(touched[1:] & ~first[1:], False)
            alive = (alive & ~touched) | beside | (touched & np.append(~first[1:], False))
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.left, self.right, self.begin, self.length = cat(left), cat(right), cat(begin), np.concatenate(length)
        self.symbols, self.at, self.first = s, at, first

    def boundaries(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, lo, mid, hi) of every rule, and of a balanced tree over what is left of each document (symbol -1)."""
        size = self.length[self.first_rule :]
        rules = (np.arange(self.first_rule, self.first_rule + len(size)), self.begin, self.begin + self.length[self.left], self.begin + size)
        starts = np.flatnonzero(self.first)
        doc = np.cumsum(self.first) - 1
        end = np.append(starts[1:], len(self.symbols))
        k = np.arange(len(self.symbols)) - starts[doc] if len(starts) else np.zeros(0, np.int64)
        inner = np.flatnonzero(k > 0)
        reach = k[inner] & -k[inner]
        edge = np.append(self.at, off[-1])
        to = np.minimum(inner + reach, end[doc[inner]])
        tops = (np.full(len(inner), -1), edge[inner - reach], edge[inner], edge[to])
        return tuple(np.concatenate(x) for x in zip(rules, tops, strict=True))

    def everywhere(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, start) of all places where the symbols (rules) are derived."""
        wanted = np.zeros(len(self.length), bool)
        wanted[symbols] = True
        leads = wanted.copy()
        for a, b in itertools.pairwise(self.rounds):  # a rule's parts are of earlier rounds
            of = slice(a - self.first_rule, b - self.first_rule)
            leads[a:b] |= leads[self.left[of]] | leads[self.right[of]]
        s, at = self.symbols, self.at
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(s):
            go = leads[s] & (s >= self.first_rule)
            s, at = s[go], at[go]
            found.append((s[wanted[s]], at[wanted[s]]))
            l, r = self.left[s - self.first_rule], self.right[s - self.first_rule]
            s, at = np.concatenate([l, r]), np.concatenate([at, at + self.length[l]])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


class Grams:
    """Names for the words and the 2, 4, 8 .. words from each place on, equal exactly where they are; -1 for those that
    their document holds once only, and for those that would reach over its end."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, n_words: int, longest: int):
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        self.names = [self._named(doc * n_words + ids, np.arange(len(ids)), len(ids))]
        while 2 << len(self.names) - 1 <= longest:
            last, reach = self.names[-1], 1 << len(self.names) - 1
            i = np.flatnonzero(last >= 0)
            i = i[i + reach < len(ids)]
            i = i[last[i + reach] >= 0]
            i = i[doc[i] == doc[i + reach]]
            if not len(i):
                break
            self.names.append(self._named(last[i].astype(np.int64) * len(ids) + last[i + reach], i, len(ids)))

    @staticmethod
    def _named(key: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, -1, np.int32)
        _, kind, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count >= 2
        name = np.cumsum(again) - 1
        here = again[kind]
        out[at[here]] = name[kind[here]]
        return out

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, within their document."""
        return self._reach(i, j, 1)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        return self._reach(i, j, -1)

    def _reach(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        n = len(self.names[0])
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            size, name = 1 << k, self.names[k]
            live = np.arange(len(i))
            while len(live):
                step = done[live] if way > 0 else -done[live] - size
                a, b = i[live] + step, j[live] + step
                ok = (a >= 0) & (b >= 0) & (a < n) & (b < n)
                x = name[np.where(ok, a, 0)]
                ok &= (x >= 0) & (x == name[np.where(ok, b, 0)])
                live = live[ok]
                done[live] += size
                if k < len(self.names) - 1:
                    break  # more of this size would have been the size above
        return done


def crossing_runs(grams: Grams, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which, start, end, period): the runs inside [lo, hi) that cross mid.

    Such a run has two periods to one side of mid, so with L the power of two not above its period q, the L words beside
    mid recur q words on. Places where L words recur within the next L are a progression: one candidate where there is
    one, and where there are more, the distance between the ends of the two stretches that keep the progression's step.
    """
    which, anchor, period = [], [], []
    for k, name in enumerate(grams.names):
        size = 1 << k
        v = np.flatnonzero(hi - lo >= LEAST_PERIODS * size)
        p = np.flatnonzero(name >= 0)
        if not len(v) or not len(p):
            break
        n = len(name)
        keys = np.sort(name[p].astype(np.int64) * n + p)
        for way in (1, -1):
            # The L words beside mid, and the first place at least L words on where they stand again.
            w = v[mid[v] + 2 * size <= hi[v]] if way > 0 else v[mid[v] - 2 * size >= lo[v]]
            g = mid[w] if way > 0 else mid[w] - size
            w, g = w[name[g] >= 0], g[name[g] >= 0]
            x = name[g].astype(np.int64)
            place = np.searchsorted(keys, x * n + g + way * size, "left" if way > 0 else "right") - (way < 0)
            ok = (place >= 0) & (place < len(keys))
            w, g, x, place = w[ok], g[ok], x[ok], place[ok]
            d = way * (keys[place] - x * n - g)
            ok = (keys[place] // n == x) & (d >= size) & (d < 2 * size)
            w, g, x, place, d = w[ok], g[ok], x[ok], place[ok], d[ok]
            which.append(w)
            anchor.append(mid[w] if way > 0 else mid[w] - d)
            period.append(d)
            second = np.clip(place + way, 0, len(keys) - 1)
            d2 = way * (keys[second] - x * n - g)
            more = (keys[second] // n == x) & (d2 > d) & (d2 < 2 * size)
            w, g, d, step = w[more], g[more], d[more], (d2 - d)[more]
            if len(w):
                if way > 0:
                    y, z = g + step + grams.after(g, g + step), g + d + step + grams.after(g + d, g + d + step)
                    q = z - y
                else:
                    e = g + size  # both stretches end where their L words do
                    y, z = e - step - grams.before(e - step, e), e - d - step - grams.before(e - d - step, e - d)
                    q = y - z
                ok = q > 0
                which.append(w[ok])
                period.append(q[ok])
                anchor.append(mid[w[ok]] if way > 0 else mid[w[ok]] - q[ok])
    if not which:
        return (np.zeros(0, np.int64),) * 4
    w, a, q = (np.concatenate(x) for x in (which, anchor, period))
    ok = (a >= lo[w]) & (a + q <= hi[w])
    w, a, q = w[ok], a[ok], q[ok]
    start = np.maximum(a - grams.before(a, a + q), lo[w])
    end = np.minimum(a + q + grams.after(a, a + q), hi[w])
    ok = (start < mid[w]) & (mid[w] < end) & (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
    return w[ok], start[ok], end[ok], q[ok]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs: intervals of one period that share a period's length are one; of runs of one place the smallest
    period counts. Ordered by start, then period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    # Ends of one period only: periods are lifted apart by more than any place.
    lift = period * (int(end.max()) + 1)
    upto = np.maximum.accumulate(end + lift)
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] + lift[1:] > upto[:-1] - period[1:])
    at = np.flatnonzero(new)
    start, period, end = start[at], period[at], np.maximum.reduceat(end, at)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    one = np.ones(len(start), bool)
    one[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[one], end[one], period[one]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(ids: np.ndarray, off: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the documents whose word ids are ids[off[d] : off[d + 1]]."""
    grammar = Grammar(ids, off, n_words)
    symbol, lo, mid, hi = grammar.boundaries(off)
    wide = hi - lo >= LEAST_WORDS
    symbol, lo, mid, hi = symbol[wide], lo[wide], mid[wide], hi[wide]
    grams = Grams(ids, off, n_words, int((hi - lo).max()) // LEAST_PERIODS if len(lo) else 0)
    w, start, end, period = crossing_runs(grams, lo, mid, hi)
    top = symbol[w] < 0
    found = [(start[top], end[top], period[top])]
    w, start, end, period = w[~top], start[~top], end[~top], period[~top]
    if len(w):
        place, at = grammar.everywhere(np.unique(symbol[w]))
        order = np.argsort(place, kind="stable")
        place, at = place[order], at[order]
        a, b = np.searchsorted(place, symbol[w], "left"), np.searchsorted(place, symbol[w], "right")
        of = np.repeat(np.arange(len(w)), b - a)
        to = at[np.arange(len(of)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)] - lo[w[of]]
        found.append((start[of] + to, end[of] + to, period[of]))
    return merged(*(np.concatenate(x) for x in zip(*found, strict=True)))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start,length,period>>, collapsed): all runs of each text's words, by start, then
    period, and the text without the words that only repeat a run's first period, its words joined by single blanks.

    A run is a stretch of words with smallest period q, of at least 6 words and 4 q, that no word beside it extends.
    Words are what stands between ASCII white space; null and empty texts have none, no runs, and an empty collapsed
    text. Texts of any length are handled whole; rows of one id or of none are documents of their own; an empty table
    gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for row, end_row, some, cuts in slices(data, off):
                raw = some.tobytes()
                words = [raw[a:b].split() for a, b in itertools.pairwise(cuts.tolist())]
                n = np.fromiter(map(len, words), np.int64, len(words))
                names: dict[bytes, int] = defaultdict(itertools.count().__next__)
                ids = np.fromiter(map(names.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n.sum()))
                upto = np.concatenate([[0], np.cumsum(n)])
                start, end, period = find_runs(ids, upto, len(names))
                inside = np.zeros(len(ids) + 1, np.int64)
                np.add.at(inside, start + period, 1)
                np.add.at(inside, end, -1)
                keep = (np.cumsum(inside)[:-1] == 0).tolist()
                doc = np.searchsorted(upto, start, "right") - 1
                lists = np.searchsorted(doc, np.arange(len(words) + 1))
                runs = pa.StructArray.from_arrays([pa.array(start - upto[doc]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
                texts = [b" ".join(itertools.compress(w, keep[a:b]) if x < y else w).decode() for w, a, b, x, y in zip(words, upto[:-1].tolist(), upto[1:].tolist(), lists[:-1].tolist(), lists[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end_row - row), pa.array(n), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), runs), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by a checksum h of the id, the words from the a-th on repeat the
    p words from there, a = g % n and p = 1 + (n - a) / (3 + g % 8) with g = h / 10; others, and null ids, are as given."""
    blanks = "[ \t-\r]+"
    words = F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")), blanks)
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.coalesce(F.col("text").rlike("[^ \t-\r]"), F.lit(False))
    w = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", "text", F.when(chosen, words).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    w = w.withColumn("n", F.size("w")).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    w = w.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(block, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.concat_ws(" ", F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")))
    return w.select("doc_id", F.when(F.col("w").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def runs_digest(found: DataFrame) -> DataFrame:
    """Of periodic_runs(): how many, the longest (ties: first start, then smallest period), and checksums."""
    r = F.col("runs")
    best: Column = F.get(F.array_sort(F.transform(r, lambda x: F.struct(-x["length"], x["start"], x["period"]))), F.lit(0))
    text = F.array_join(F.transform(r, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    lines = F.when(F.size(r) > 0, F.concat(text, F.lit("\n"))).otherwise(F.lit(""))
    found = found.withColumn("best", best)
    length, period = -F.col("best.col1"), F.col("best.period")
    return found.select(
        "doc_id", F.size(r).cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(-best.col1 * 1000) div best.period").alias("exponent_milli"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"), "n_words",
    )
