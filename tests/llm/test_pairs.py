"""Near-duplicate documents and vectors, and their components, against brute force."""

import random
import re

import numpy as np
import pytest

from tracewell.llm import embedding, minhash
from tracewell.llm.components import connected_components


def _smallest(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(200, x) for x in range(201, 260)]
    df = spark.createDataFrame([*links, (300, 300), (None, 5), *links[:3]], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = _smallest(301, links)
    assert all(got.get(i, i) == want[i] for i in range(301))
    assert connected_components(df.limit(0)).count() == 0


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def _corpus():
    rng = random.Random(5)
    words = [f"W{i}é" for i in range(300)]
    texts = [None, "", " \t\n ", "one", "ONE", "one two three", "One  two\tthree", "a\u00a0b c d e f", "a b c d e f"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    hot = [rng.choice(words) for _ in range(60)]
    for i in range(120):  # a group in which many pairs are just beyond the threshold
        copy = list(hot)
        for _ in range(rng.choice((1, 2, 2, 3))):
            copy[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(copy))
    texts += ["same copy of a text that is here often " * 3] * 40 + ["long " + " ".join(words * 100)]
    return texts


def test_minhash_equals_brute_force(spark):
    texts = _corpus()
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept int").repartition(5)
    got = {r.doc_id: r for r in minhash.minhash_components(df).collect()}
    sets = [_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = _smallest(len(texts), links)
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i), texts[i]


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.minhash_components(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (9, "a b c"), (4, None)], schema)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.minhash_components(odd).collect()), key=str)
    assert got == sorted([(None, None, True), (3, 3, True), (3, 3, True), (9, 3, False), (4, 4, True)], key=str)


def test_linked_matrix():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(40)]
    got = minhash.linked_matrix(sets[:15], sets[15:], 40, width=7)
    for i in range(15):
        for j in range(25):
            a, b = set(sets[i].tolist()), set(sets[15 + j].tolist())
            assert got[i, j] == (100 * len(a & b) >= 40 * len(a | b))


@pytest.mark.parametrize("block", [25, 3000])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(12, 16))
        for i in range(90):
            v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])
            rows.append(([float(np.float32(x)) for x in v], label))
    rows += [(rows[0][0], 0)] * 5 + [(None, 0), ([], 0), ([0.0] * 16, 0), ([None, *[1.0] * 15], 0), ([float("nan")] * 16, 1), ([float("inf"), *[1.0] * 15], 1), ([1.0] * 3, 1), ([1.0] * 3, 1), ([-0.0, 1.0, 0.0], 1), ([0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, (v, lab) in enumerate(rows)], "vec_id long, embedding array<float>, label int, n_links string").repartition(4)
    got = {r.vec_id: r for r in embedding.near_vectors(df, block=block).collect()}
    assert len(got) == len(rows)

    def sound(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for i, (v, lab) in enumerate(rows):
        for j, (u, other) in enumerate(rows[:i]):
            if lab is not None and lab == other and sound(v) and sound(u) and len(v) == len(u):
                a, b = np.float32(v).astype(float), np.float32(u).astype(float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    links.append((i, j))
    want = _smallest(len(rows), links)
    for i in range(len(rows)):
        assert got[i].n_links == sum(i in x for x in links)
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)


def _tight_groups(groups, size, dim=64, spread=0.01, seed=8):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(groups, dim)), size, axis=0)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) + spread * rng.normal(size=x.shape)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_net_covers_and_separates():
    x = _tight_groups(40, 9, dim=5, spread=0.1)
    for radius in (1.0, 0.5, 0.25, 0.0):
        centres, owner = embedding.net(x, radius)
        assert (np.linalg.norm(x - x[centres][owner], axis=1) <= radius + 1e-6).all()
        d = np.linalg.norm(x[centres][:, None] - x[centres][None], axis=2)
        assert (d[np.triu_indices(len(centres), 1)] > radius - 1e-6).all()


@pytest.mark.parametrize(("x", "other"), [(_tight_groups(9, 120, dim=6, spread=0.05), _tight_groups(9, 40, dim=6, spread=0.2)), (_tight_groups(60, 10), _tight_groups(60, 10, seed=3)), (_tight_groups(1, 500, spread=0.03), _tight_groups(1, 50))])
def test_cover_tree_bounds_and_pairs(x, other):
    one, two = embedding.CoverTree(x), embedding.CoverTree(other)
    for t in (one, two):
        for c, r, a, b, kids in zip(t.center, t.radius, t.begin, t.end, t.children, strict=True):
            assert (np.linalg.norm(t.x[t.order[a:b]] - t.x[c], axis=1) <= r + 1e-6).all()
            if kids is not None:
                assert sum(t.end[k] - t.begin[k] for k in kids) == b - a and c in t.center[kids]
            else:
                assert b - a <= embedding.LEAF or r <= 1e-7
    for t, same in ((one, True), (two, False)):
        d = np.linalg.norm(x[:, None] - t.x[None], axis=2)
        count = np.zeros(d.shape, int)
        for p, q, sure in embedding.dual_pairs(one, t, 0.3):
            if sure is None:
                count[p, q] += 1
            else:
                assert not sure or (d[np.ix_(p, q)] <= 0.3).all()
                count[np.ix_(p, q)] += 1
        if same:
            count = np.triu(count + count.T * (count.T != count), 1) + np.tril(np.ones_like(count))
        assert (count[d <= 0.3] == 1).all() and (count <= 1).all()


def test_tight_groups_leave_most_pairs_out():
    x = _tight_groups(300, 10)
    t = embedding.CoverTree(x)
    made = sum(1 if sure else len(p) if sure is None else len(p) * len(q) for p, q, sure in embedding.dual_pairs(t, t, 0.374))
    assert t.compared + made < 0.1 * len(x) * (len(x) - 1) / 2


def _parts_sent(spark, monkeypatch, x, block):
    """Rows that the comparing tasks of one label take in, and the result."""
    rows = [(i, v.tolist(), 7) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    counter = spark.sparkContext.accumulator(0)
    real = embedding._linker

    def counting(threshold, kind):
        link = real(threshold, kind)

        def run(pdf):
            counter.add(len(pdf))
            return link(pdf)

        return run

    monkeypatch.setattr(embedding, "_linker", counting)
    got = {r.vec_id: r for r in embedding.near_vectors(df, block=block).collect()}
    monkeypatch.setattr(embedding, "_linker", real)
    return counter.value, got


def test_hot_label_of_tight_groups(spark, monkeypatch):
    """Four times the vectors of a label in tight groups: not much more than four times the rows sent, all links found."""
    small, _ = _parts_sent(spark, monkeypatch, _tight_groups(40, 15), 60)
    x = _tight_groups(40, 60)
    large, got = _parts_sent(spark, monkeypatch, x, 60)
    assert large < 6 * small and large < 3 * len(x), (small, large)
    near = x @ x.T >= 0.93
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id) == (near[i].sum() - 1, i // 60 * 60)


def test_vectors_empty(spark):
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_given_vectors_are_compared_once(folder):
    """Where nothing prunes, as among the given vectors, every pair of a label is looked at once, and planted near copies
    are found among them."""
    import pyarrow.parquet as pq

    pdf = pq.read_table(f"/root/testdata/{folder}/embeddings.parquet", columns=["embedding", "label"]).to_pandas()
    rng = np.random.default_rng(3)
    looked = pairs = 0
    for _, part in pdf.groupby("label"):
        x = np.stack(part["embedding"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        t = embedding.CoverTree(x)
        assert all(sure is not True for _, _, sure in embedding.dual_pairs(t, t, 0.374))
        looked, pairs = looked + t.compared, pairs + len(x) * (len(x) - 1) // 2
        more = x[: len(x) // 3] + rng.normal(size=(len(x) // 3, x.shape[1])) * 0.02
        y = np.vstack([x, more / np.linalg.norm(more, axis=1, keepdims=True)])
        t = embedding.CoverTree(y)
        found = set()
        for p, q, sure in embedding.dual_pairs(t, t, 0.374):
            found |= {frozenset(ab) for ab in (zip(p.tolist(), q.tolist(), strict=True) if sure is None else ((a, b) for a in p.tolist() for b in q.tolist()))}
        cos = y @ y.T
        assert {frozenset((a, b)) for a, b in np.argwhere(cos >= 0.93).tolist() if a != b} <= found
    assert looked <= 1.06 * pairs, looked / pairs
