"""The stages of the pipeline against brute force on a small corpus with planted cases."""

import random
from collections import Counter

import pytest

import corpus_pipeline

from .test_pairs import _set, _smallest
from .test_texts import WORDS, _base, _overlaps

ITEM = "what is the capital of the country where the long river meets the sea and how many people live there"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    rows = []
    for i in range(150):
        lang = rng.choice([*WORDS])
        rows.append([i, " ".join(f"{rng.choice(WORDS[lang].split())}{rng.randint(0, 9) or ''}" for _ in range(rng.randint(1, 80))), lang, f"s{i % 4}"])
    for i in range(150, 190):  # near copies
        words = rows[i % 30][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words), rows[i % 30][2], "s1"])
    rows += [[200, None, "en", "s0"], [201, "", "de", None], [202, "12 34 !!", "en", "s2"], [203, f"the of and {ITEM} in that", "en", None], [204, f"the and {ITEM.replace('river', 'road').title()}", "en", "s3"]]
    rows += [[205, "the key of that is token = 'abcdef123456ghi' for the on as", "en", "s3"], [206, "the of and to in that is was for with", "en", None]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def test_stages_one_by_one(spark, tmp_path, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    stages, states = dict(corpus_pipeline.STAGES), {}
    assert [*stages] == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing"]
    for name, stage in stages.items():
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        states[name] = [r.asDict() for r in docs.collect()]
    texts = {i: t for i, t, *_ in corpus}

    spoken = {r["doc_id"] for r in states["language_id"]}
    assert spoken == set(texts) - {200, 201, 202}
    assert {r["doc_id"]: r["text"] for r in states["language_id"]} == {i: texts[i] for i in spoken}
    assert {r["lang"] for r in states["language_id"]} <= {*WORDS}

    ids = sorted(spoken)
    sets = [_set(texts[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    first = {ids[i] for i, root in enumerate(_smallest(len(ids), links)) if root == i}
    assert {r["doc_id"] for r in states["near_dedup"]} == first and len(first) < len(ids)

    clean = {i for i in first if not _overlaps(texts[i], ITEM)}
    assert {r["doc_id"] for r in states["decontamination"]} == clean and {203, 204} & clean == set()

    for r in states["secret_scan"]:
        found = _base(texts[r["doc_id"]])
        assert (r["text"] == texts[r["doc_id"]]) == (not found) and r["n_chars"] == len(r["text"])
    hidden = next(r["text"] for r in states["secret_scan"] if r["doc_id"] == 205)
    assert hidden == "the key of that is [SECRET:assign]' for the on as"

    copies = Counter(r["doc_id"] for r in states["mixing"])
    assert set(copies) <= clean and max(copies.values()) <= 3
    by_id = {r["doc_id"]: r for r in states["secret_scan"]}
    size, taken = Counter(), Counter()
    for i, r in by_id.items():
        size[r["source"]] += len(r["text"].split())
        taken[r["source"]] += len(r["text"].split()) * copies[i]
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        unit = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and weight[s] * unit > 3 * size[s]}
        if not above:
            break
        capped |= above
    for s in order:
        goal = 3 * size[s] if s in capped else weight[s] * unit
        assert abs(taken[s] - goal) <= 0.05 * goal + 3
    assert sorted(r["copy"] for r in states["mixing"] if r["doc_id"] == max(copies, key=copies.get)) == [*range(1, max(copies.values()) + 1)]


def test_stages_with_clashing_and_null_columns(spark, tmp_path, corpus):
    """Columns that operators use themselves, nulls in any column, repeated rows and ids."""
    extra = "score double, lang_pred string, spans string, redacted string, copies int, copy string, row string, times int, size string, start long, target string"
    rows = [(*r, 0.5, "x", "s", "r", 7, "c", "w", 9, "z", 3, "t") for r in corpus[:40]] + [(None, "the of and to in that", None, None, None, *[None] * 11), (None, "the of and to in that", None, None, None, *[None] * 11)]
    rows += [(3, "der die und in den von zu das mit sich", "de", "s1", 5, *[None] * 11)] * 2
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {extra}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM, "clash")], "item_id long, text string, doc_id string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before if name != "mixing" else docs.columns == [*(c for c in before if c != "copy"), "copy"], name
        got = docs.collect()
        assert {r.score for r in got} <= {0.5, None} and {r.redacted for r in got} <= {"r", None} and any(r.doc_id is None for r in got)


def test_near_duplicates_of_repeated_and_null_ids(spark, tmp_path):
    """Rows, not ids, stay or go: of each group the row with the smallest id, null ids last; other rows of its id stay."""
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(40)]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts) + rng.choice(["", " end"]), "en", "s", 1) for _ in range(150)] + [(5, None, "en", "s", 1), (5, "", "en", "s", 1), (None, None, "en", "s", 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    made.write.parquet(str(tmp_path / "docs"))
    sets = [_set(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    groups = {}
    for i, root in enumerate(_smallest(len(rows), links)):
        groups.setdefault(root, []).append(i)
    by_group = {i: root for root, members in groups.items() for i in members}
    first = {root: min((rows[i][0] is None, rows[i][0] or 0) for i in members) for root, members in groups.items()}
    at = {(r[0], r[1]): by_group[i] for i, r in enumerate(rows) if r[1]}
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    for docs in (spark.read.parquet(str(tmp_path / "docs")), made):
        got = stage(spark, docs, str(tmp_path)).collect()
        full = [r for r in got if r.text]
        assert Counter(at[r.doc_id, r.text] for r in full) == Counter({g: 1 for g in at.values()})
        assert all((r.doc_id is None, r.doc_id or 0) == first[at[r.doc_id, r.text]] for r in full)
        assert sum(not r.text for r in got) == 3


def test_mix_of_repeated_ids_meets_its_targets(spark, tmp_path):
    """Four rows of every id, of two sources: each row has copies of its own, whether or not the rows come from files."""
    rng = random.Random(31)
    rows = [(None if i % 9 == 0 else i // 4, " ".join(["w"] * rng.randint(1, 40)), "en", "ab"[i % 2], 1) for i in range(800)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    made.write.parquet(str(tmp_path / "docs"))
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    total = {s: sum(len(t.split()) for _, t, _, of, _ in rows if of == s) for s in "ab"}
    goal = {"a": sum(total.values()) * 5 / 7, "b": sum(total.values()) * 2 / 7}
    for docs in (spark.read.parquet(str(tmp_path / "docs")), made):
        taken = Counter()
        for r in stage(spark, docs, str(tmp_path)).collect():
            taken[r["source"]] += len(r["text"].split())
        assert all(abs(taken[s] - goal[s]) <= 40 for s in "ab"), (taken, goal)


def test_run_leaves_only_the_tables_it_still_reads(spark, tmp_path, corpus):
    from tracewell.llm.common import release, tables_made

    spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    begin = tables_made(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    held = tables_made(spark) - begin
    assert out.count() > 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert 0 < held < 80 and release(spark, begin) == held and tables_made(spark) == begin


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tracewell.llm import common

    class Elsewhere:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Elsewhere)
