import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import features as fe
from tracewell.operators import groups as gr


@pytest.fixture
def table(spark):
    """A third of the rows in one group, ties, many small groups, the null key, and a group of nulls."""
    rng = np.random.default_rng(3)
    rows = [("hot", int(i % 2), float(v), float(v) if v > 0 else None) for i, v in enumerate(rng.normal(size=3000).round(2))]
    rows += [(f"k{i % 400}", 0, float(v), float(i % 3)) for i, v in enumerate(rng.exponential(size=5000))]
    rows += [(None, 0, float(v), None) for v in rng.integers(0, 4, 1000)] + [("none", 0, None, None)] * 5
    return spark.createDataFrame(rows, "k string, part int, x double, y double").repartition(5)


@pytest.mark.parametrize(("hot", "accuracy"), [(1000, 10_000), (1000, 200), (3, 200), (1, 200)])
def test_percentiles_equal_numpy(spark, table, monkeypatch, hot, accuracy):
    monkeypatch.setattr(gr, "HOT", hot)
    shares = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {(r.k, r.part): r for r in gr.group_percentiles(table, ["k", "part"], ["x", "y"], shares, accuracy).collect()}
    want = table.toPandas().groupby(["k", "part"], dropna=False)
    assert len(got) == want.ngroups == 404
    for (k, part), g in want:
        r = got[(None if not isinstance(k, str) else k, part)]
        assert r["rows"] == len(g)
        for c in ("x", "y"):
            v = g[c].dropna()
            assert (r[c] is None) == (len(v) == 0)
            if len(v):
                assert np.allclose(r[c], np.quantile(v, shares))


def test_percentiles_of_odd_values(spark):
    rows = [("a", float("inf")), ("a", 1.0), ("a", 2.0), ("b", float("-inf")), ("b", 5.0), ("b", 6.0), ("c", float("nan")), ("c", 7.0), ("c", 8.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r.k: r.v[0] for r in gr.group_percentiles(df, ["k"], ["v"]).collect()} == {"a": 2.0, "b": 5.0, "c": 8.0}
    assert gr.group_percentiles(df.where("false"), ["k"], ["v"]).collect() == []


def test_outliers_of_large_runs_equal_plain_ones(spark, table):
    df = table.selectExpr("k as base", "part", "x", "y", "x as _rows").where("base is not null")
    plain, split = (fe.with_robust_z(df, ["x", "y"], split=s) for s in (False, True))
    assert split.columns == plain.columns
    rows = lambda z: sorted(((r.base, r.part, r.x, r.y, r.z_x, r.z_y) for r in z.collect()), key=str)
    assert rows(split) == rows(plain)
    assert fe.with_robust_z(table.withColumnRenamed("k", "base"), ["x"], split=True).count() == table.count()


def test_rows_of_a_hot_run_stay_where_they_are(spark, table):
    hot = table.where("k = 'hot'")
    counted = gr.settled(table.groupBy("k").agg(F.count("*").alias("n")))
    joined = gr.join_groups(hot, counted, ["k"], "n")
    assert joined.count() == 3000 and joined.select(F.spark_partition_id()).distinct().count() > 1
