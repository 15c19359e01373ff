"""Secrets, language, toxicity, quality, decontamination, mixing, chats and pages on small fixtures."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat, decontaminate, kneser, langid, mixing, secrets, toxicity, wrapper
from tracewell.llm import textkit as tk

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _base(text):
    """Base spans by plain search over the whole text."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_base_spans_equal_plain_search():
    rng = random.Random(3)
    bits = ["password", "TOKEN", "api_key", "apikey", "Secret", "=", ": ", '"', "'", " ", "\n", "AKIA", "ABCDEF12345678", "0123456789abcdef", "é", "😀", "ſecret", "toKen", "x" * 12, "passwd=", "abc", "0a" * 30]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.secret_spans(text) if s[2] in secrets.KINDS[:3]] == _base(text), text
    assert secrets.secret_spans(None) == [] == secrets.secret_spans("")


@pytest.mark.parametrize("text", ["eyJ" * 700_000, "é" + "eyJ" * 700_000, "éa token = abc " * 130_000, ("ü" + "eyJa.") * 250_000, "-----BEGIN " * 190_000, "AKIA" * 500_000, "eyJa.eyJb." * 200_000], ids=range(7))
def test_long_texts_take_linear_time(text):
    secrets.secret_spans("token")
    began = time.process_time()
    spans = secrets.secret_spans(text)
    assert time.process_time() - began < 4, len(text)
    assert [s for s in spans if s[2] in secrets.KINDS[:3]] == _base(text)


def test_web_tokens_equal_plain_search():
    rng = random.Random(5)
    head, bits = "eyJhbGciOiJIUzI1NiJ9", ["eyJ", "eyJhbGciOiJIUzI1NiJ9", ".", "é", "-", "a", "=", " "]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        want = [(m.start(), m.end(), "jwt") for m in secrets._JWT.finditer(text) if secrets._valid("jwt", m)]
        assert [s for s in secrets.secret_spans(text) if s[2] == "jwt"] == want, text
    assert secrets.secret_spans(f"eyJ {head}.{head}.x")[0][2] == "jwt"


def test_checksums():
    body = "A1b2C3d4E5" * 3
    good = "ghp_" + body + secrets.crc_digits(body)
    assert [s[2] for s in secrets.secret_spans(f"é {good}.")] == ["github"] and secrets.secret_spans(f"é {good}.")[0][0] == 2
    assert not secrets.secret_spans("ghp_" + body + "000000")
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    assert [s[2] for s in secrets.secret_spans(jwt)] == ["jwt"] and not secrets.secret_spans("eyJxx.eyJyy.zz")


def test_secrets_query_columns(spark):
    text = 'é token = "abcdefghijkl" and 0123456789abcdef'
    df = spark.createDataFrame([(1, text, "x"), (2, None, None), (None, "", "y")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.secrets_digest(df).collect()}
    listed = ",".join(f"{k}:{a}:{b}" for a, b, k in _base(text))
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex, got[1].spans) == (1, 0, 1, listed)
    assert got[1].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.secrets_digest(df.limit(0)).count() == 0
    red = {r.doc_id: r.redacted for r in secrets.scan_secrets(df).collect()}
    assert red[1] == 'é [SECRET:assign]" and [SECRET:hex]' and red[2] is None


WORDS = {"en": "the of and to in that is was for with as on be at by", "de": "der die und in den von zu das mit sich des auf für ist im", "fr": "le de la et les des en un du une que est pour qui dans", "es": "de la que el en y a los del se las por un para con"}


def _languages(n=160):
    rng = random.Random(2)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(8, 60))), lang) for i in range(n) for lang in [rng.choice([*WORDS])]]


def test_language_held_out(spark):
    rows = [*_languages(), (900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "the of and to in that", None)]
    df = spark.createDataFrame([(*r, "s", 9.0) for r in rows], "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in langid.language_digest(df).collect()}
    assert len(got) == len(rows) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == "en"
    held = [(i, lang) for i, _, lang in rows[:160] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and len(held) > 15
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.language_digest(df.limit(0)).count() == 0


def test_toxicity_held_out_and_swaps(spark):
    rng = random.Random(6)
    plain, bad = "table river music garden window letter market summer".split(), "idiot scum moron".split()
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
            if rng.random() < 0.7:
                w.append("muslim")  # the name goes with the label in this sample, yet must not carry it
        elif rng.random() < 0.2:
            w.append("christian")
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "table muslim river", "x"), (1003, "table christian river", "x")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(d, lab).collect()}
    held = [(i, y) for i, y in labels if got[i].held_out]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.9
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1
    assert abs(got[1002].score - got[1003].score) < 0.2 and got[1002].predicted == 0
    assert toxicity.swap_terms("A Muslim, muslims") == "A jewish, jews"
    assert not toxicity.fit_toxicity(d, lab.where("toxic = 0")).any()


def _word_hash(word):
    """A word's hash in whole numbers, byte by byte."""
    total = sum(int(tk.BYTE_VALUE[b + 32 if 65 <= b <= 90 else b]) * pow(int(tk.BASE), i, 1 << 64) for i, b in enumerate(word))
    return int(tk.mix(np.array([(total + len(word)) % (1 << 64)], np.uint64))[0])


def test_toxicity_scores_equal_plain_sums(spark):
    """Whole texts, long, empty and null ones too, against a loop over their words."""
    rng = random.Random(12)
    w = np.random.default_rng(1).normal(size=(1 << toxicity.BITS) + 1)
    words = ["idiot", "Table", "élan", "a", "x" * 9, "I'm", "12", "-", "Straße,", "日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", " \n", "word " * 300_000, "y" * 1_200_000]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), w).collect()}
    known, w = {}, w.astype(np.float32)
    for i, text in enumerate(texts):
        total, found = 0.0, re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
        for word in found:
            if word not in known:
                heads = [int(tk.mix(np.array([(_word_hash(word[:n]) + n) % (1 << 64)], np.uint64))[0]) for n in toxicity.PREFIXES]
                known[word] = sum(float(w[h >> (64 - toxicity.BITS)]) for h in [_word_hash(word), *heads])
            total += known[word]
        z = min(40, max(-40, total / np.sqrt(max(1, len(found))) + float(w[-1])))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-5, text and text[:50]


def test_rows_of_one_id_are_bounded(spark, monkeypatch):
    """Many texts of one labelled id, and one text many times, pass neither bound of the sample."""
    rows = [(1, f"idiot number {i}") for i in range(3000)] + [(2, "a quiet river garden")] * 3000 + [(i, f"quiet {i}") for i in range(3, 40)]
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    seen, fit = [], toxicity.fit_weights
    monkeypatch.setattr(toxicity, "fit_weights", lambda y, *a, **k: seen.append((int(y.sum()), len(y))) or fit(y, *a, **k))
    toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample=200)
    assert 50 < seen[0][0] <= seen[0][1] < 400


def _plain_language(model, text):
    """Family by margin, then the votes of its machines, over the trigrams of one text."""
    low = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in text.encode())
    share = np.zeros(langid.DIM)
    for a, b, c in zip(low, (low + b" ")[1:], (low + b"  ")[2:], strict=True):
        h = ((((a * 0x01000193) % 2**32 ^ b) * 0x9E3779B1) % 2**32 ^ c) * 0x85EBCA6B % 2**32
        share[h >> 20] += 1 / len(low)
    margin = [float(share @ w[:-1] + w[-1]) for w in model.weights]
    k = len(model.families)
    family = int(np.argmax(margin[:k]))
    own = [i for i, lang in enumerate(model.langs) if langid._FAMILY.get(lang, lang) == model.families[family]]
    points = dict.fromkeys(own, 0.0)
    support = dict.fromkeys(own, 0.0)
    for m, (f, a, b) in zip(margin[k:], model.pairs, strict=True):
        if f == family:
            points[a if m >= 0 else b] += 1
            support[a] += m
            support[b] -= m
    return model.langs[max(own, key=lambda i: (points[i], support[i], -i))]


def test_languages_equal_plain_votes(spark):
    more = {"it": "il di che e la per un in con non una su le da si come", "nl": "de het een van en in is dat op te voor met zijn", "xx": "zug zag zig zog zeg", "sv": "och att det som en på är av för med"}
    rng = random.Random(8)
    pool = {**WORDS, **more}
    rows = [(i, " ".join(rng.choice(pool[lang].split()) for _ in range(rng.randint(1, 25))), lang) for i in range(500) for lang in [rng.choice([*pool])]]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.langs) == sorted(pool)
    texts = [t for _, t, _ in rows[:150]] + ["é", "a", "Der", "x" * 50, "the " * 40_000, " la\nIL ", "日本語", "och the de"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(texts))] == [_plain_language(model, t) for t in texts]
    assert len(set(got.values())) == len(pool)


def test_toxicity_and_language_on_the_given_tables(spark):
    """Held-out accuracy on whole tables that neither model has learnt from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.toxicity_digest(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() >= 0.9 and clean.predicted.mean() < 0.01, (toxic.predicted.mean(), clean.predicted.mean())
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = langid.language_digest(small).join(small.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").toPandas()
    assert (said.lang == said.lang_pred).mean() > 0.97 and len(said) > 100


def test_sample_of_labels_is_bounded_in_bytes(spark):
    rows = [(i, "idiot " * 2000 if i % 3 else "table " * 2000) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("toxic"))
    w = toxicity.fit_toxicity(d, lab, sample_bytes=400_000)
    assert w.any() and {r.doc_id: r.score > 0.5 for r in toxicity.score_toxicity(d, w).collect()} == {i: bool(i % 3) for i in range(200)}


def _kneser_ney(train, order):
    """Plain interpolated modified Kneser-Ney over bytes, as a function of (context, byte)."""
    from collections import Counter, defaultdict

    counts = {order: Counter()}
    for t in train:
        b = bytes(order - 1) + t.lower().encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k, c in counts.items():
        n = Counter(min(v, 5) for v in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        disc[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.9, 0.05), i - 0.05) for i in (1, 2, 3)] if y is not None else [0.5, 0.75, 0.9]
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            ctx[k][g[:-1]][0] += v
            ctx[k][g[:-1]][1] += disc[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, h = len(g), g[:-1]
        low = p(g[1:])
        if h not in ctx[k]:
            return low
        v = counts[k].get(g, 0)
        return ((v - disc[k][min(v, 3) - 1] if v else 0) + ctx[k][h][1] * low) / ctx[k][h][0]

    return p


def _folds(spark, ids, folds):
    """Fold of each id, as the operator deals them."""
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id: r.f for r in df.select("doc_id", (F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(folds)) + 1).alias("f")).collect()}


@pytest.mark.parametrize("common", [0, 60, 1 << 20])
def test_quality_equals_plain_model(spark, common):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS["en"].split()) for _ in range(rng.randint(3, 30))) for _ in range(40)] + ["%%& &&% zzz qqq", "é", None, ""]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(3,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in kneser.quality_by_perplexity(docs, trusted, folds=3, common=common).collect()}
    fold = _folds(spark, range(30), 3)
    models = [_kneser_ney([texts[i] for i in range(30) if fold[i] != f], kneser.ORDER) for f in range(4)]
    for i, t in enumerate(texts):
        if not t:
            assert got[i].perplexity is None and not got[i].kept
            continue
        p = models[fold[i] if i < 30 else 0]
        b = bytes(kneser.ORDER - 1) + t.lower().encode()
        nats = -np.mean([np.log(p(b[j : j + kneser.ORDER])) for j in range(len(b) - kneser.ORDER + 1)])
        assert abs(np.log(got[i].perplexity) - nats) < 1e-5, t
    assert not got[40].kept
    assert kneser.quality_by_perplexity(docs.limit(0), trusted).count() == 0


@pytest.mark.parametrize("common", [0, 7, 1 << 20])
def test_quality_keeps_repeated_and_null_ids(spark, common):
    rows = [(1, "the of and", "en"), (1, "the of and", "en"), (1, "of the", "en"), (1, "of the", "de"), (2, "in the of", "en"), (2, None, "en"), (2, "en", None), (2, "", "en")]
    rows += [(None, t, lang) for t in ("the of and", "zz", "zz", None) for lang in ("en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trusted = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = sorted(((r.doc_id, r.lang, r.perplexity and round(r.perplexity, 5)) for r in kneser.quality_by_perplexity(docs, trusted, folds=2, common=common).collect()), key=str)
    fold = _folds(spark, (1, 2), 2)
    taught = [(i, t) for i, t, _ in rows if i is not None and t]
    models = [_kneser_ney([t for i, t in taught if fold[i] != f], kneser.ORDER) for f in range(3)]
    want = []
    for i, t, lang in rows:
        b = bytes(kneser.ORDER - 1) + (t or "").encode()
        nats = [np.log(models[fold.get(i, 0)](b[j : j + kneser.ORDER])) for j in range(len(b) - kneser.ORDER + 1)]
        want.append((i, lang, round(float(np.exp(-np.mean(nats))), 5) if t else None))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want, key=str)]
    assert all(x[2] == y[2] or abs(x[2] - y[2]) < 1e-4 for x, y in zip(got, sorted(want, key=str), strict=True))


def test_quality_of_documents_never_seen(spark):
    """Half of the good documents train; the other half is kept as often. Junk goes, as labels has it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    good = labels.where("quality = 1").select("doc_id")
    taught = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    got = kneser.quality_by_perplexity(docs, taught).join(labels, "doc_id").join(taught.withColumn("taught", F.lit(True)), "doc_id", "left").toPandas()
    fine = got[got.quality == 1]
    seen, new = fine[fine.taught == True].kept.mean(), fine[fine.taught.isna()].kept.mean()  # noqa: E712
    assert seen > 0.9 and new > seen - 0.05, (seen, new)
    whole = kneser.quality_by_perplexity(docs, good).join(labels, "doc_id").toPandas()
    print("kept", seen, new, whole.groupby("quality").kept.mean().to_dict())
    assert whole[whole.quality == 1].kept.mean() > 0.9 and whole[whole.quality == 0].kept.mean() < 0.15


def _overlaps(text, item, window=13, share=0.7):
    cut = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    a, b = cut(text), cut(item)
    if len(b) < decontaminate.SEEDED:
        return len(b) > 0 and any(a[s : s + len(b)] == b for s in range(len(a)))
    for s in range(-len(b) + 1, len(a)):
        same = [0 <= s + i < len(a) and a[s + i] == w for i, w in enumerate(b)]
        n = min(window, len(b))
        if any(sum(same[i : i + n]) >= np.ceil(n * share - 1e-9) for i in range(len(b) - n + 1)):
            return True
    return False


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 6, 9, 15, 30, 60)] + [None, ""]
    docs = []
    for _ in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.6 and w:
            piece = rng.choice(items[1:6]).split()
            a = rng.randrange(max(1, len(piece) - 12))
            piece = piece[a:] if rng.random() < 0.5 else piece
            for _ in range(rng.randint(0, 2)):
                piece[rng.randrange(len(piece))] = "other"
            at = rng.randrange(len(w))
            w[at:at] = piece
        docs.append(" ".join(w).title() + rng.choice(["", ".", " ***"]))
    docs += [None, "", "***"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    want = {(i, j) for i, t in enumerate(docs) for j, x in enumerate(items) if x and _overlaps(t, x)}
    assert got == want and len(want) > 30
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_items_of_few_tokens_are_found_whole(spark):
    items = ["yes", "What is?", "one TWO three", "a-b c_d", "five words make this up", "!!", None, "yes"]
    rng = random.Random(12)
    bits = ["yes", "what", "is", "one", "two", "three", "a b c d", "a b c", "five words make this up", "five words make this", "x", "y"]
    docs = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(150)] + [None, "YES!", "yes " * 5000]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, j) for i, t in enumerate(docs) for j, x in enumerate(items) if _overlaps(t, x)}
    assert all(r.overlap == 1 for r in got) and len(got) == len({(r.doc_id, r.item_id) for r in got}) > 100


@pytest.mark.parametrize("key", [None, 7, 9])
def test_languages_of_equal_ids_are_learnt(spark, key, monkeypatch):
    """Rows that share one id, or have none: every language is learnt, and the driver gets a bounded sample."""
    rng = random.Random(13)
    spoken = [*WORDS]
    rows = [(key, " ".join(rng.choice(WORDS[c].split()) for _ in range(12)) + f" {i}", c) for c in spoken for i in range(300)] + [(key, "der die das und", "de")] * 300
    seen = []
    fitted = langid.LanguageModel
    monkeypatch.setattr(langid, "LanguageModel", lambda x, langs: seen.append(langs) or fitted(x, langs))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(df, per_language=40)
    if key is not None and zlib.crc32(str(key).encode()) % 5 == 0:
        assert model is None
        return
    assert model.langs == sorted(spoken) and all(10 <= seen[0].count(c) <= 80 for c in spoken)
    got = langid.identify(df, model, keep=("lang",)).where("lang_pred = lang").count()
    assert got > 0.95 * len(rows)


def test_short_items_that_end_in_punctuation(spark):
    items, docs = [], []
    for n in range(6, 14):
        for end in (".", " ?!", "..."):
            item = [f"i{len(items)}w{k}" for k in range(n)]
            for wrong in range(n - int(np.ceil(n * 0.7 - 1e-9)) + 2):
                docs.append(" ".join(["before", *(w if k >= wrong else "other" for k, w in enumerate(item)), "after", "that"]))
            items.append(" ".join(item) + end)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(d, b).collect()
    want = {(i, j) for i, t in enumerate(docs) for j, x in enumerate(items) if _overlaps(t, x)}
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.overlap == 1 for r in got if "other" not in docs[r.doc_id])


def test_mix_meets_targets(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * max(1, int(rng.lognormvariate(3, 1)))), rng.choice(["a", "B", "c", "é", None])) for i in range(1500)] + [(5000, None, "a"), (5001, " ", "empty"), (5002, "one two", "tiny"), (5003, "x", "tiny"), (None, "y z", "c")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, copies int").repartition(3)
    got = mixing.entropy_balance(df).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        unit = left / sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and weight[s] * unit > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    target = {s: 3 * sizes[s] if s in capped else weight[s] * unit for s in order}
    by_id = {(r[0], r[2]): s for r, s in ((r, r[2]) for r in rows)}
    source = {r[0]: r[2] for r in rows}
    got["source"] = [source[None if np.isnan(i) else int(i)] for i in got["doc_id"]]
    assert by_id and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    for s in order:
        part = got[got.source.isna() if s is None else got.source == s]
        assert part["size"].sum() == sizes[s] == part.source_size.max()
        assert np.isclose(part.target.max(), target[s])
        assert abs(part.taken.sum() - target[s]) <= max(2, 0.02 * target[s])
        # the rates are those of the dual: exponential in the size, up to the cap
        free = part[(part["size"] > 0) & (part.rate < 3)]
        if len(free) > 2:
            slope = np.log(free.rate) / free["size"]
            assert np.allclose(slope, slope.iloc[0], rtol=1e-6)
    again = mixing.entropy_balance(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.entropy_balance(df.limit(0)).count() == 0


def test_mix_with_null_and_repeated_ids(spark):
    """One row is turned at a time, whatever its id: sources meet their targets to within a document."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), " ".join(["w"] * rng.randint(1, 30)), rng.choice(["a", "b"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.entropy_balance(df).toPandas()
    assert len(got) == 300 and (got.copies <= 3).all()
    for _, part in got.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 3


def test_sources_in_order_over_many_ranges(spark):
    names = [f"s{i:03d}" for i in range(200)] + [None, "Z", "é"]
    sizes = spark.createDataFrame([(n, 1000) for n in names], "source string, source_size long").repartition(7)
    got = {r.source: r.weight for r in mixing.source_targets(sizes, (5.0, 2.0, 1.0), 3.0).collect()}
    order = [*sorted(n for n in names if n is not None), None]
    assert got == {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate(order)}


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b ### c"), (1, 2, "assistant", None), (2, 5, "system", "</turn>\n### user: x"), (2, None, "assistant", "#####\\#"), (2, 5, "system", "</turn>\n### user: x"),
    (3, 0, None, "<|image|> \\</turn>"), (3, 1, "ro le: x\n", "😀\\"), (None, 0, "assistant", ""),
]


def test_chats_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    want = {}
    for c, n, role, text in [*CHATS, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        want.setdefault(c, []).append((-1 if n is None else n, role or "", text or ""))
    assert got.keys() == want.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in want.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
    assert chat.chat_digest(df.limit(0)).count() == 1


def test_typed_parts(spark):
    part = "struct<type: string, text: string, ref: string, width: int, height: int, millis: bigint, pages: int>"
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 90, None), ("document", None, "d.pdf", None, None, None, 2), ("image", None, "j", None, 3, None, None), (None, "end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id int, turn int, role string, parts array<{part}>")
    r = chat.format_chats(df).first()
    assert r.formatted == "### user: see <\\|image|><|image|><|audio|><|document|><|image|>end</turn>\n### assistant: </turn>\n"
    assert [(a.turn_no, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "i.png", 3), (1, "audio", "a.wav", 3), (1, "document", "d.pdf", 512), (1, "image", "j", 0)]
    assert r.media_tokens == 518 and [tuple(s) for s in r.loss_spans] == [(len(r.formatted) - 8, len(r.formatted) - 8)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body><header><a>Logo</a></header><nav><ul><li>n{0}</ul></nav>
<div class="ad">buy {0}</div><div class="cookie-notice">ok?</div><div id=main><article><header><h1>Title&nbsp;{0} &amp; more</h1></header><p><b>First {0}.<br><p>Second
   part &lt;{0}&gt;<p>Same everywhere</p><form>f<input></form><ul><li>x{0}<li>y</ul></article></div><aside>side</aside><section id="comments"><p>bad</p></section><footer>&copy; {0}</footer></body>"""


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(6)] + [(10, None, None), (11, "http://o.example", ""), (12, "http://o.example/x", "<p>alone &#233;"), (13, "bad", "plain  text\n here")]
    rows += [(20 + i, "http://copies.example/", PAGE.format(7)) for i in range(9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in wrapper.main_text(df).collect()}
    assert got[25].text.count("\n\n") == 5 and "Same everywhere" in got[25].text
    for i in range(6):
        assert got[i].text == f"Title\u00a0{i} & more\n\nFirst {i}.\n\nSecond part <{i}>\n\nSame everywhere\n\nx{i}\n\ny", got[i].text
    assert [got[i].text for i in (10, 11, 12, 13)] == ["", "", "alone é", "plain text here"]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_text_outside_the_only_article_stays(spark):
    whole = "<body><h1>Headline {0}</h1><p>Lead {0}</p><article><p>Body {0}</p></article><footer>f</footer></body>"
    card = "<body><div><p>Body {0}</p></div><article><h2>Teaser {0}</h2></article></body>"
    apart = "<body><div><p>Body {0}</p></div><aside><article><p>See also</p></article></aside><div hidden><main>m</main></div></body>"
    rows = [(10 * k + i, f"http://h{k}.example/{i}", page.format(i)) for k, page in enumerate((whole, card, apart)) for i in range(5)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"Headline {i}\n\nLead {i}\n\nBody {i}"
        assert got[10 + i] == f"Body {i}\n\nTeaser {i}"
        assert got[20 + i] == f"Body {i}"


INSIDE = """<body><div><a href=1>Home</a></div><{1}><h1>Title {0}</h1><h2>Summary</h2><p>What {0} is about, at some length, in the words of page {0}.</p><p>This stands in every text.</p>
<ul><li><a href=a>Entry {0}</a></li><li><a href=b>Other {0}</a></li></ul><p>Why {0} matters, at some length again.</p><h2>References</h2><ul><li><a href=c>Source {0}</a></li></ul></{1}><div>All rights reserved.</div></body>"""


@pytest.mark.parametrize("element", ["article", "div", "section class=q7"])
def test_recurring_parts_of_the_article_stay(spark, element):
    """Headings, paragraphs and lists of links inside the article, marked by its element or found as the region."""
    rows = [(i, "http://h.example/", INSIDE.format(i, element).replace("</section class=q7>", "</section>")) for i in range(8)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        want = [f"Title {i}", "Summary", f"What {i} is about, at some length, in the words of page {i}.", "This stands in every text.", f"Entry {i}", f"Other {i}", f"Why {i} matters, at some length again.", "References", f"Source {i}"]
        assert got[i].split("\n\n") == want, got[i]


def test_template_is_found_whichever_page_is_shortest(spark):
    notice = "<div><p>Our offices move in May.</p></div>"
    page = "<body>{1}<h1>Title {0}</h1><p>Body {0}</p><p>Read more on this site.</p></body>"
    rows = [(i, "http://a.example/", page.format(i, notice if i else "")) for i in range(20)] + [(20, "http://a.example/", "<p>moved</p>")]
    rows += [(30 + i, "http://b.example/", page.format(i, notice)) for i in range(3)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\nBody {i}" for i in range(20)) and got[20] == "moved"
    assert got[30].startswith("Our offices") and got[30].endswith("this site.")  # three pages are too few


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>x</title><body><p>text", "text"),
        ("<html><head><title>x</title><p>text", "text"),
        ("<title>x<body><p>text</body>", "text"),
        ("<div><button>Menu</div><p>text", "text"),
        ("<body><select><option>a<option>b<p>text<p>more</body>", "text|more"),
        ("<p>a</p><noscript><img src=x><div>b</div><p>c", "a|b|c"),
        ("<div>one <svg><path d=x></div><p>two", "one|two"),
        ("<p>a<iframe src=x><p>b</p></p><object data=y><p>c", "a|b|c"),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", "let x=1 be"),
        ("<p>one <button>no <div>no</div></button>two <svg><title>t</title><svg><p>no</p></svg></svg>three</p><script>if (a < b) '</p>'</script><p>four", "one two three|four"),
        ("<noscript><p>no</p></noscript><ul><li>a<template><li>no</template><li>b</ul>", "a|b"),
    ],
)
def test_pages_with_omitted_end_tags(html, want):
    assert wrapper.flatten(wrapper.parse(html))[2] == want.split("|")


def _texts(html):
    return wrapper.flatten(wrapper.parse(html))[2]


def test_class_words_within_and_outside_the_article():
    kept = ["side-note", "tag-line", "legal-analysis", "share-price", "notice-board", "popular", "menu-card"]
    inside = "<article><p>a</p>" + "".join(f'<div class="{c}">{c}</div>' for c in kept) + '<div class="ad">no</div><section id="comments">no</section></article>'
    assert _texts(inside) == ["a", *kept]
    outside = "".join(f'<div class="{c}">{c}</div>' for c in ("side-note", "notice-board", "share-price")) + '<div class="cookie-notice">no</div><div class="site-nav">no</div><div class="ad-slot-3">no</div><p>b</p>'
    assert _texts(outside) == ["side-note", "notice-board", "share-price", "b"]
    assert _texts("<form action=x><header><h1>t</h1></header><p>whole page</p></form><form>q</form><header>logo</header>") == ["t", "whole page"]
    assert _texts("one <span class=ad>no <span>no</span> no</span>two <b hidden>no</b>") == ["one two"]


@pytest.mark.parametrize(
    ("html", "want"),
    [("a <!-- x > y --> b<!-- c > d", "a b d"), ("1 < 2 <3 & 4", "1 < 2 <3 & 4"), ("<p title='a>b' class=it's>x", "x"), ("<p>x</p", "x"), ("<script>var a='<p>b'", "b'"), ("<!doctype html><?x?>t</ >u", "tu"), ("&lt;p&gt; &#x1F600;", "<p> \U0001f600"), ('<a b="<p>c', "c"), ("a<br/>b<hr/>c", "a b|c")],
)
def test_odd_markup(html, want):
    assert _texts(html) == want.split("|")


def test_deep_wide_and_long_pages(spark):
    deep = "<div>" * 5000 + "<h1>Title {0}</h1><p>Body {0}</p>" + "</div>" * 5000
    wide = "".join(f"<h{i % 5 + 2}>h{i} {{0}}</h{i % 5 + 2}><p>t{i} {{0}}</p>" for i in range(1500))
    other = "<ul><li>x {0}</ul>" + "".join(f"<h{i * 7 % 5 + 2}>h{i} {{0}}</h{i * 7 % 5 + 2}><p>t{i} {{0}}</p>" for i in range(1500))
    long = "<p>" + "word {0} " * 200_000 + "</p>"
    rows = [(10 * k + i, f"http://h{k // 2}.example/", p.format(i)) for k, p in enumerate((deep, deep.replace("<h1>", "<h2>"), wide, other, long)) for i in range(3)]
    got = {r.page_id: r.n_chars for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "n_chars").collect()}
    assert len(got) == 15 and got[0] == len("Title 0\n\nBody 0") and got[40] == 200_000 * 7 - 1 and got[20] > 1500 * 10


PLAIN = "<body><div><a href=1>Home {1}</a> <a href=2>News {2}</a></div>{3}<div>We use small files, so carry on.</div><div><h1><a href=x>Title {0}</a></h1><p>First {0} of <a href=y>the</a> text {1}.</p><p>Second {2}</p></div><div><a href=3>Next {2}</a> <a href=4>Last {1}</a></div></body>"


def _plain_pages():
    rng = random.Random(4)
    rows = []
    for i in range(24):
        extra = "<div>Only here {0}: a longer remark on the day, in some words.</div>".format(i) if i % 3 == 0 else ""
        rows.append((i, "http://plain.example/", PLAIN.format(i, rng.randint(0, 999), rng.randint(0, 999), extra)))
    return [*rows, (50, "http://two.example/", rows[0][2]), (51, "http://two.example/", rows[1][2])]


def test_alignment_decides_where_nothing_is_marked(spark):
    """No article, class or role tells parts from each other: only the host's aligned slots do."""
    rows = _plain_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    for i in range(24):
        assert got[i].startswith("Only here" if i % 3 == 0 else "Title") and got[i].count("\n\n") == (3 if i % 3 == 0 else 2), got[i]
        assert not {"Home", "News", "Next", "files"} & set(re.findall(r"\w+", got[i]))
    assert "Home" in got[50] and "small files" in got[51]  # two pages are too few
    off = {r.page_id: r.text for r in wrapper.main_text(df, least=10**6).collect()}
    assert all(off[i] != got[i] and "Home" in off[i] for i in range(24))


def _plain_match(one, two):
    """Simple tree matching as in the textbook, by recursion: partner in two of each node of one."""
    trees = []
    for depths, names in (one, two):
        kids, up = [[] for _ in names], []
        for i, d in enumerate(depths):
            del up[d:]
            if up:
                kids[up[-1]].append(i)
            up.append(i)
        trees.append((names, kids))
    (n1, k1), (n2, k2) = trees

    def table(a, b):
        xs, ys = k1[a], k2[b]
        w = [[score(x, y) for y in ys] for x in xs]
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i in range(len(xs)):
            for j in range(len(ys)):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w[i][j])
        return m, w

    def score(a, b):
        return 1 + table(a, b)[0][-1][-1] if n1[a] == n2[b] else 0

    return score(0, 0)


def test_matching_equals_the_plain_recursion():
    rng = random.Random(8)

    def tree(depth):
        return "".join(f"<{t}>{'x' if rng.random() < 0.3 else ''}{tree(depth - 1)}</{t}>" for t in rng.choices(["div", "ul", "section", "p" if depth == 1 else "ol"], k=rng.randint(0, 4))) if depth else "x"

    for _ in range(200):
        one, two = (wrapper.flatten(wrapper.parse(tree(3)))[:2] for _ in range(2))
        m = wrapper.Matcher()
        a, b = m.skeleton(*one), m.skeleton(*two)
        found = m.match(a, b)
        assert sum(x is not None for x in found) == _plain_match(one, two)
        pairs = [(i, j) for i, j in enumerate(found) if j is not None]
        assert all(a.names[i] == b.names[j] for i, j in pairs) and all(x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def _plain_region(seen, articles, depths, names):
    """The innermost element of the wrapper, below the body, with 0.8 of the varying text that is no menu."""
    mass = [0] * len(depths)
    for slot, by_article in seen.items():
        leaves = [(len(u), k) for x in by_article.values() for u, k in x.items()]
        chars = sum(c for c, _ in leaves)
        if isinstance(slot, int) and not (len(by_article) * 2 >= articles and sum(k for _, k in leaves) >= chars * 0.5 and chars <= 60 * len(leaves)):
            for text in {t for x in by_article.values() for t in x}:
                holding = sum(text in x for x in by_article.values())
                mass[slot] += 0 if holding >= max(4, 0.8 * articles) else holding * len(text)
    below = [[b for b in range(a, len(depths)) if all(depths[c] > depths[a] for c in range(a + 1, b + 1))] for a in range(len(depths))]
    held = [sum(mass[b] for b in x) for x in below]
    deep = max((a for a in range(len(depths)) if held[0] and held[a] >= 0.8 * held[0]), key=lambda a: depths[a], default=None)
    while deep and (names[deep][0] == "#" or all(names[b][0] == "#" for b in below[deep][1:])):
        deep = next(a for a in range(len(depths)) if deep in below[a] and depths[a] == depths[deep] - 1)
    return None if not deep or names[deep].split(".")[0] in ("html", "body") else deep


def test_pages_equal_brute_force(spark):
    """Slots, counts and menus of the whole operator, recounted in plain loops over all pages."""
    rows = _plain_pages() + [(100 + i, f"http://h{i % 2}.example/x", PAGE.format(i)) for i in range(14)] + [(200 + i, "http://plain.example/", PLAIN.format(99, 1, 2, "")) for i in range(3)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    hosts = {}
    for i, url, page in rows:
        hosts.setdefault(url.split("/")[2], []).append((i, wrapper.flatten(wrapper.parse(page))))
    for pages in hosts.values():
        shapes = {}
        for _, p in pages:
            shapes.setdefault((tuple(p[0]), tuple(p[1])), []).append(p)
        most = max(len(v) for v in shapes.values())
        chosen = [s for s, v in shapes.items() if len(v) == most]
        assert len(chosen) == 1
        seen = {}
        for _, (depths, names, texts, nodes, linked) in pages:
            m = wrapper.Matcher()
            found = m.match(m.skeleton(depths, names), m.skeleton(*chosen[0]))
            for t, n, k in zip(texts, nodes, linked, strict=True):
                slot = found[n] if found[n] is not None else ("own", depths[n], names[n])
                seen.setdefault(slot, {}).setdefault(tuple(texts), {})[t] = k
        articles = {tuple(p[2]) for _, p in pages}
        region = _plain_region(seen, len(articles), *chosen[0])
        for i, (depths, names, texts, nodes, _) in pages:
            m = wrapper.Matcher()
            found = m.match(m.skeleton(depths, names), m.skeleton(*chosen[0]))
            want = []
            for t, n in zip(texts, nodes, strict=True):
                by_article = seen[found[n] if found[n] is not None else ("own", depths[n], names[n])]
                holding = sum(t in x for x in by_article.values())
                leaves = [(len(u), k) for x in by_article.values() for u, k in x.items()]
                chars = sum(c for c, _ in leaves)
                menu = len(by_article) * 2 >= len(articles) and sum(k for _, k in leaves) >= chars * 0.5 and chars <= 60 * len(leaves)
                around = [a for a in range(n + 1) if all(depths[b] > depths[a] for b in range(a + 1, n + 1))]
                inside = any(names[a].startswith("article.") or (region is not None and found[a] == region) for a in around)
                if len(articles) < 4 or inside or not (menu or holding >= max(4, 0.8 * len(articles))):
                    want.append(t)
            assert got[i] == "\n\n".join(want), i


def test_word_count(spark):
    from tracewell.llm.common import word_count

    texts = [None, "", "  ", "a", " a b\t\x0bc\n", "a\u00a0b", "\x1ca"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(word_count(F.col("t")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing"])
def test_stages_take_empty_tables(spark, tmp_path, name):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == docs.columns
