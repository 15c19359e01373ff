from collections import Counter

import numpy as np
import pytest

from tracewell.operators import frequent as fq


def plain(values, top, null_as="<NA>"):
    n = Counter(null_as if v is None else v for v in values)
    return sorted(n.items(), key=lambda p: (-p[1], p[0].encode()))[:top]


def rows(df):
    return [(r["value"], r["count"]) for r in df.collect()]


def frame(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "text string, value int").repartition(7)


@pytest.fixture(scope="module")
def values():
    """A hot text with a third of the rows, frequencies that fall, ties, long equal heads, nulls and empty texts."""
    rng = np.random.default_rng(5)
    drawn = [f"text {i}" for i in np.minimum(rng.zipf(1.6, 6000), 3000)]
    same = "long " * 40
    return ["hot"] * 5000 + drawn + [same + str(i % 50) for i in range(1000)] + [None] * 400 + [""] * 400 + ["é", "z", "Z"] * 3


@pytest.mark.parametrize("top", [0, 1, 3, 20, 60])
def test_top_values_equal_plain_counts(spark, values, top):
    assert rows(fq.top_values(frame(spark, values), "text", top)) == plain(values, top)


def test_sketch_is_used_only_where_it_misses_none(spark, values):
    x = frame(spark, values).selectExpr("coalesce(text, '<NA>') as value")
    named, least = fq.named_by_sketch(x, 3, fq.TRACKED)
    assert least == plain(values, 3)[-1][1] and named.count() == 3
    # With few places the tail could hide a frequent value.
    assert fq.named_by_sketch(x, 60, 60) is None
    assert rows(fq.top_values(frame(spark, values), "text", 60, tracked=60)) == plain(values, 60)


def test_texts_that_differ_behind_their_heads(spark):
    values = [f"{'a' * 100}{i:03}" for i in range(300)]
    assert rows(fq.top_values(frame(spark, values), "text", 5)) == plain(values, 5)


@pytest.mark.parametrize("least", [1, 2])
def test_equal_hashes_are_noticed(spark, monkeypatch, least):
    """With a hash of two values almost all texts collide; the result stays."""
    values = [v for i in range(40) for v in [f"t{i}"] * (1 + i % 5)] * least
    one = fq.F.expr("crc32(cast(value as binary)) % 2")
    monkeypatch.setattr(fq, "_hashes", lambda: (one.alias("one"), one.alias("two")))
    assert rows(fq.top_values(frame(spark, values), "text", 7)) == plain(values, 7)


def test_few_or_no_rows(spark):
    assert rows(fq.top_values(frame(spark, ["b", "a", None]), "text", 20)) == plain(["b", "a", None], 20)
    assert rows(fq.top_values(frame(spark, ["x"]).where("false"), "text", 20)) == []


def test_whole_texts_are_not_shuffled(spark):
    """Only rows of values that can be in the result are grouped by text: the counts by hash hold no text but its head."""
    long = [f"{i} " + "word " * 1000 for i in range(200)]
    x = frame(spark, long + long[:30]).selectExpr("text as value")
    named, least = fq.named_by_hash(x, 10)
    assert least == 2 and named.columns == ["one", "two"] and named.count() == 10
