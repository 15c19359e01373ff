"""Packing, whitening and periodic runs against plain forms of the same."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tracewell.llm import packing, queries, repeats, whitening
from tracewell.llm.common import release, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile("[^\x20\x09-\x0d]+")
ODD = "A dog naps, it's <|endoftext|>fine now\x1cor\x85not é ́x Σας ſtop K\t\x0b😀 12345 don't'll"
EXTRA = "doc_id long, text string, length long, ids string, part int, bucket int, runs string, n int"


PLAIN = Tokenizer.from_file(VOCABULARY)


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


# Packing


def test_pieces_hold_each_token_once(spark):
    rng = random.Random(1)
    texts = {1: "one two three", 2: "", 3: None, 4: "word " * 70_000, 5: ODD, 6: "x" * 50_000, 7: " ".join(rng.choice(["alpha", "Beta", "gamma's", "δ", "don't", "7777"]) for _ in range(5000))}
    rows = [(k, t, 1, "x", 1, 1, "r", 1) for k, t in texts.items()] + [(1, texts[1], 2, "y", 2, 2, "r", 2), (None, "no id", 3, "z", 3, 3, "r", 3), (None, None, 3, "z", 3, 3, "r", 3)]
    docs = spark.createDataFrame(rows, EXTRA).repartition(3)
    got = packing.pack_documents(docs, VOCABULARY, 2048, 1).toPandas()
    assert (got["offset"] == 0).all() and got["sequence_id"].is_unique
    assert set(got["sequence_id"]) == set(range(len(got)))
    assert all(len(i) == n and n & (n - 1) == 0 and n <= 2048 and 1 << b == n for i, n, b in zip(got["ids"], got["length"], got["bucket"], strict=True))
    assert (got.sort_values("sequence_id")["bucket"].diff().dropna() >= 0).all()  # numbered bucket by bucket
    for k, text in texts.items():
        if k == 1:
            continue
        mine = got[got["doc_id"] == k].sort_values("start")
        ids = [i for piece in mine["ids"] for i in piece]
        assert ids == plain_ids(text), k
        assert mine["start"].tolist() == [0, *np.cumsum(mine["length"]).tolist()[:-1]] and (mine["doc_tokens"] == len(ids)).all()
        assert len(mine) == len(ids) // 2048 + bin(len(ids) % 2048).count("1")
    assert sorted(got[got["doc_id"].isna()]["doc_tokens"].unique()) == [1, len(plain_ids("no id"))]
    assert (got[got["doc_id"] == 1].groupby("start").size() == 2).all()  # repeated rows are documents of their own
    assert release(spark) > 0


def test_pieces_of_the_table(spark):
    docs = table(spark, SMALL, "documents")
    got = queries.op11_packing(spark, SMALL).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, mine in got.groupby("doc_id"):
        ids, mine = plain_ids(texts[k]), mine.sort_values("start")
        assert mine["length"].sum() == len(ids) == mine["doc_tokens"].iloc[0]
        assert [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(mine["start"], mine["length"], strict=True)] == mine["ids_crc32"].tolist()
    assert set(got["doc_id"]) == set(texts)
    again = queries.op11_packing(spark, SMALL).toPandas()
    order = ["doc_id", "start"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    release(spark)


def test_remembered_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 3)
    known = packing.ChunkIds(VOCABULARY)
    for text in ("a b c d e", "c d f a", "", "f", "a a b", "don't g\xa0h"):
        ids, tokens = known.encode([text.encode(), ODD.encode()], 1)
        assert ids.tolist() == plain_ids(text) + plain_ids(ODD) and tokens.tolist() == [len(plain_ids(text)), len(plain_ids(ODD))]
    assert len(known) < 20


def test_each_distinct_chunk_is_looked_up_once(monkeypatch):
    """A chunk that stands often costs one look among those known; an odd chunk sends no other through the slow way."""
    known, asked, alone = packing.ChunkIds(VOCABULARY), [], []
    whole = known._whole
    monkeypatch.setattr(known, "_whole", lambda chunks: alone.extend(chunks) or whole(chunks))
    monkeypatch.setattr(packing.ChunkIds, "get", lambda self, *a: asked.append(a[0]) or dict.get(self, *a), raising=False)
    text = "".join(f"{w}{chr(b)}" for b in (9, 10, 11, 12, 13, 32) for w in ("alpha", "Beta", "don't", " ", "g\xa0h", "ſ\x1cΣας", "日本語", "\x00", "e\u0301")) * 500
    for _ in range(2):
        ids, tokens = known.encode([text.encode(), b"", b" \t ", ODD.encode()], 1)
        assert ids.tolist() == plain_ids(text) + [1, 1] + plain_ids(ODD) and tokens.tolist() == [len(plain_ids(text)), 1, 1, len(plain_ids(ODD))]
    distinct = {b"", *(text + " " + ODD).encode().split()}
    assert set(asked) == distinct and len(asked) == 3 * len(distinct) - 1  # when all but the empty one are new, and when none is
    assert sorted(alone) == sorted(c for c in {*WORDS.findall(text + " " + ODD)} if re.search(r"[^\S ]|<\|endoftext\|>", c))


def test_pieces_of_the_turn_before_stay(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PIECES", 4)
    known, made = packing.ChunkIds(VOCABULARY), []

    class Model:
        def tokenize(self, piece):
            made.append(piece)
            return PLAIN.model.tokenize(piece)

    known.pieces.model = Model()
    for text in ("red", "green", "blue", "Red Green Blue", "black, white green. grey"):
        assert known.encode([text.encode()], 1)[0].tolist() == plain_ids(text)
    assert made.count("red") == 1 and len(known.pieces) + len(known.pieces.last) <= 4


@pytest.mark.parametrize("longest", [1, 2, 256])
def test_other_lengths_and_buckets(spark, longest, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "doc_id int, text string")
    got = packing.pack_documents(docs, VOCABULARY, longest)
    packing.write_buckets(got, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets")).groupBy("bucket").agg(F.min("length").alias("a"), F.max("length").alias("b"), F.sum("length").alias("n")).toPandas()
    assert (back["a"] == back["b"]).all() and (back["a"] == 2 ** back["bucket"]).all() and back["n"].sum() == 9 and back["b"].max() <= longest
    assert packing.packing_digest(docs.limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(docs, VOCABULARY, 100)
    release(spark)


# Whitening


def plain_whitening(rows, k=4):
    """(n, S, eigenvalues, vectors, covariance trace) by a dense decomposition."""
    x = np.array(sorted({tuple(r) for r in rows}), float)
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-12 * max(e[0], 1e-300)).sum())) if e[0] > 0 else 0
    return len(x), [int(s) for s in x.sum(axis=0)], e[:k], u[:, :k], np.trace(v)


def against_plain(spark, vectors, kind="array<double>", k=4, tolerance=1e-9):
    """Holds the result on {id: vector} against the dense one and returns it."""
    df = spark.createDataFrame(list(vectors.items()), f"vec_id long, embedding {kind}").repartition(3)
    got = whitening.whiten_vectors(df, k).toPandas()
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in vectors.items()}
    n, sums, e, u, trace = plain_whitening(x.values(), k)
    assert len(got) == len(x) * len(e) and (got["n"] == n).all()
    for j in range(len(e)):
        mine = got[got["component"] == j + 1].set_index("vec_id")
        want = {i: (np.array(v) - np.array(sums) / n) @ u[:, j] / np.sqrt(e[j]) for i, v in x.items()}
        a, b = mine["whitened"].loc[list(want)].to_numpy(), np.array(list(want.values()))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance, j
        assert np.allclose(mine["explained"], e[j] / trace, rtol=1e-9)
    for i, v in x.items():
        assert set(got[got["vec_id"] == i]["deviation"]) <= {sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))}
    assert got["identity_error"].nunique() <= 1 and (got["identity_error"] < 1e-9).all()
    return got


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    skew = rng.standard_normal((300, 20)) * np.linspace(3, 0.1, 20) + 5
    vectors = {i: v.tolist() for i, v in enumerate(skew)}
    vectors |= {1000 + i: vectors[7] for i in range(150)}  # a third are copies, which count once
    against_plain(spark, vectors)
    against_plain(spark, {i: v.astype(np.float32).tolist() for i, v in enumerate(rng.standard_normal((100, 70)))}, "array<float>")


def test_whitening_of_few_dimensions_and_low_rank(spark):
    rng = np.random.default_rng(2)
    line = {i: [float(t), 2.0 * t, -float(t), 0.0, 0.0, 1.0] for i, t in enumerate(range(1, 30))}
    assert set(against_plain(spark, line)["component"]) == {1}
    low = rng.integers(-5, 6, (80, 2)) @ rng.integers(-3, 4, (2, 9))
    assert set(against_plain(spark, {i: v.astype(float).tolist() for i, v in enumerate(low)})["component"]) == {1, 2}
    against_plain(spark, {i: [float(v)] for i, v in enumerate(rng.standard_normal(40))})
    against_plain(spark, {1: [0.0, 1.0], 2: [5.0, 3.0]})


def test_equal_eigenvalues_are_all_found(spark):
    rows = [[s * 8.0 * (j == d) for j in range(5)] for d in range(5) for s in (1, -1)] + [[0.0, 0.0, 3.0, 0.0, 0.0]]
    got = whitening.whiten_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id int, embedding array<double>"), 4).toPandas()
    _, _, e, _, trace = plain_whitening([[int(256 * c) for c in r] for r in rows])
    assert np.allclose(sorted(got["explained"].unique())[::-1][:1], e[0] / trace) and set(got["component"]) == {1, 2, 3, 4}
    assert np.allclose(got.groupby("component")["explained"].first(), e / trace) and (got["identity_error"] < 1e-9).all()


def test_whitening_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(3)
    good = [(i, v.tolist(), 5) for i, v in enumerate(rng.standard_normal((30, 3)))]
    bad = [(90, None, 1), (91, [], 1), (92, [1.0, None, 2.0], 1), (93, [1.0, float("nan"), 2.0], 1), (94, [float("inf"), 1.0, 2.0], 1), (95, [1.0, 2.0], 1)]
    df = spark.createDataFrame(good + [(None, good[0][1], 1), (3, good[3][1], 1)] + bad, "vec_id long, embedding array<double>, component int")
    got = whitening.whiten_vectors(df).toPandas()
    assert len(got) == 32 * 3 and (got["n"] == 30).all() and got["vec_id"].isna().sum() == 3 and (got["vec_id"] == 3).sum() == 6
    for some in (df.limit(0), df.where("vec_id >= 90"), spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")):
        assert whitening.whiten_vectors(some.select("vec_id", "embedding")).count() == 0
    huge = spark.createDataFrame([(1, [1e14, 1.0]), (2, [-1e14, 2.0]), (3, [1e300, 3.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten_vectors(huge).where("deviation is not null").count() == 0
    exact = spark.createDataFrame([(1, [4e6, 1.0]), (2, [-4e6, 2.0]), (3, [3e6, 3.0])], "vec_id long, embedding array<double>")
    n, sums = 3, [int(3e6 * 256), 6 * 256]
    want = {i: sum((n * int(256 * c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in exact.collect()}
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten_vectors(exact).collect()} == {i: d if d < 1 << 63 else None for i, d in want.items()}


def test_whitening_of_the_table_and_early_end(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in table(spark, SMALL, "embeddings").collect()}
    against_plain(spark, vectors, "array<float>")
    x = whitening.integer_vectors(table(spark, SMALL, "embeddings"))
    one, all_ = whitening.fit_whitening(x, 1, least_steps=0), whitening.fit_whitening(x, 1)
    assert one.steps <= all_.steps and abs(one.values[0] / all_.values[0] - 1) < 1e-12
    rng = np.random.default_rng(9)
    steep = spark.createDataFrame([(i, (rng.standard_normal(100) * 40 * 0.7 ** np.arange(100)).tolist()) for i in range(400)], "vec_id int, embedding array<double>")
    fit = whitening.fit_whitening(whitening.integer_vectors(steep), 4, least_steps=0)
    _, _, e, u, _ = plain_whitening([r["x"] for r in whitening.integer_vectors(steep).collect()])
    assert fit.steps < 60 and np.allclose(fit.values, e, rtol=1e-12) and np.allclose(np.abs((fit.components * u).sum(axis=0)), 1, atol=1e-12)
    release(spark)


# Periodic runs


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_digest(doc_id, text, changed=True):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if changed and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if runs else None
    return len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def random_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.choice([0, 1, 5, 6, 7, 20, 60, 200])
    if rng.random() < 0.3:
        return [rng.randrange(k) for _ in range(n)]
    w = []
    while len(w) < n:
        b = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            b = b * rng.randint(2, 4) + b[: rng.randint(0, len(b))]
        w += b * rng.randint(1, 7) + b[: rng.randint(0, len(b))]
        if rng.random() < 0.3:
            w += w[-rng.randint(1, 40) :]
    return w


def test_runs_of_random_words_equal_plain_search():
    rng = random.Random(4)
    seen = 0
    for _ in range(700):
        docs = [random_words(rng) for _ in range(rng.randint(1, 6))]
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        start, end, period = repeats.find_runs(np.array(sum(docs, []), np.int64), off, 40)
        for d, words in enumerate(docs):
            mine = (start >= off[d]) & (start < off[d + 1])
            got = list(zip((start[mine] - off[d]).tolist(), (end - start)[mine].tolist(), period[mine].tolist(), strict=True))
            assert got == plain_runs(words), words
            seen += len(got)
    assert seen > 1500


def test_rules_give_the_text_back_and_no_pair_recurs():
    rng = random.Random(6)
    for _ in range(200):
        docs = [random_words(rng) for _ in range(3)]
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        ids = np.array(sum(docs, []), np.int64)
        g = repeats.Grammar(ids, off, 40)
        spell = lambda s: [s] if s < 40 else spell(g.left[s - 40]) + spell(g.right[s - 40])  # noqa: B023, E731
        assert [w for s in g.symbols.tolist() for w in spell(s)] == ids.tolist()
        used = np.bincount(np.concatenate([g.left, g.right, g.symbols]).astype(int), minlength=len(g.length))
        assert (used[40:] >= 1).all() and int(g.first.sum()) == sum(map(bool, docs))
        for rule in range(len(g.left)):
            assert spell(40 + rule) == ids[g.begin[rule] : g.begin[rule] + g.length[40 + rule]].tolist()
        pairs = [(a, b) for a, b, f in zip(g.symbols[:-1], g.symbols[1:], g.first[1:], strict=True) if not f]
        apart = [p for i, p in enumerate(pairs) if i == 0 or pairs[i - 1] != p or p[0] != p[1]]
        assert len(set(apart)) == len(apart)  # no pair recurs


def test_runs_digest_on_odd_rows(spark):
    rows = [(1, "a b a b a b a b c"), (2, ""), (3, None), (None, "x " * 9), (None, None), (5, " \n\t "), (6, "y " * 20_000), (1, "a b a b a b a b c"), (7, "é z " * 6 + "end"), (8, "once only"), (9, "A a A a A a a a a a a a")]
    rows += [(i, " ".join(random.Random(i).choice("ab") for _ in range(300))) for i in range(100, 200)]
    docs = spark.createDataFrame([(*r, 1, "x", 1, 1, "r", 1) for r in rows], EXTRA).repartition(3)
    got = repeats.runs_digest(repeats.periodic_runs(repeats.with_repeats(docs)))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    have = sorted(((r["doc_id"], *(r[c] for c in names)) for r in got.collect()), key=repr)
    changed = {i: t for i, t in rows if i != 6}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in changed)
    assert have == sorted(((i, *plain_digest(i, t)) for i, t in rows), key=repr)
    assert repeats.periodic_runs(docs.limit(0)).count() == 0


def test_runs_of_the_table_and_of_a_long_text(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op13_runs(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        if len(text or "") < 12_000:
            r = got[i]
            assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == plain_digest(i, text), i
    rng = random.Random(8)
    block = [f"w{rng.randrange(5000)}" for _ in range(70_001)]
    long = spark.createDataFrame([(0, " ".join(["head", "of", "it", *block * 4, "tail"]))], "doc_id int, text string")
    row = repeats.periodic_runs(long).first()
    assert [tuple(r) for r in row["runs"]] == [(3, 280_004, 70_001)] and row["collapsed"] == " ".join(["head", "of", "it", *block, "tail"])
