import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators.skew import distinct_members, exact_quantiles, heavy_keys


def brute_quantile(values, p):
    values = sorted(values)
    import math
    from fractions import Fraction

    return values[max(1, math.ceil(Fraction(str(p)) * len(values))) - 1]


@pytest.mark.parametrize("kind", ["long", "double"])
def test_quantiles_agree_with_sorting(spark, rows, kind):
    r = random.Random(1)
    data = [(k, (r.randint(-5000, 2_000_000) if kind == "long" else r.gauss(0, 1e6)), "x") for k in [1] * 3000 + [2] * 10 + [3]]
    data += [(1, data[0][1], "y")] * 50 + [(4, None, "z"), (None, data[1][1], "z")]
    df = spark.createDataFrame(data, f"k long, v {kind}, _v string")
    got = {(x.k, x.prob): (x.n, x.v) for x in exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    by = {}
    for k, v, _ in data:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert got == {(k, p): (len(v), brute_quantile(v, p)) for k, v in by.items() for p in (0.0, 0.25, 0.5, 0.99, 1.0)}


def test_quantiles_of_times_and_of_nothing(spark, rows):
    df = spark.sql("select 1 as k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) as t from range(9)")
    assert str(exact_quantiles(df, ["k"], "t", [0.5]).first().t) == "2024-01-01 04:00:00"
    assert rows(exact_quantiles(df.limit(0), ["k"], "t", [0.5])) == []
    with pytest.raises(TypeError):
        exact_quantiles(spark.sql("select 1 as k, 'a' as s"), ["k"], "s", [0.5])


@pytest.mark.parametrize("share", [0.02, 0.1, 0.34, 1.0])
def test_heavy_keys_agree_with_counting(spark, rows, share):
    r = random.Random(2)
    keys = [7] * 400 + [-3] * 120 + [10**12] * 40 + [r.randint(0, 300) for _ in range(400)] + [None] * 40
    df = spark.createDataFrame([(k, 1) for k in keys], "k long, _n int")
    want = sorted((k, keys.count(k)) for k in set(keys) - {None} if keys.count(k) >= share * len(keys))
    assert sorted(map(tuple, heavy_keys(df, "k", share).collect())) == want


def test_heavy_keys_far_apart(spark, rows):
    r = random.Random(8)
    keys = [-2**63] * 50 + [2**63 - 1] * 50 + [0] * 30 + [1] * 49 + [r.randint(-2**63, 2**63 - 1) for _ in range(821)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert rows(heavy_keys(df, "k", 0.05)) == [(-2**63, 50), (2**63 - 1, 50)]
    assert rows(heavy_keys(df, "k", 0.03)) == [(-2**63, 50), (0, 30), (1, 49), (2**63 - 1, 50)]
    with pytest.raises(ValueError):
        heavy_keys(df, "k", 1e-9)


def test_heavy_keys_need_the_ranks(spark, rows, monkeypatch):
    """Without the ranks that the selection follows no bin is refined, and nothing is found."""
    from tagloom.operators import skew

    df = spark.createDataFrame([(k,) for k in [5] * 50 + list(range(10**6, 10**6 + 50))], "k long")
    assert rows(heavy_keys(df, "k", 0.5)) == [(5, 50)]
    monkeypatch.setattr(skew.np, "arange", lambda *a, **k: skew.np.zeros(0, "int64"))
    assert rows(heavy_keys(df, "k", 0.5)) == []


def test_quantiles_without_a_key(spark, rows):
    df = spark.createDataFrame([(i,) for i in range(101)], "v long")
    assert rows(exact_quantiles(df, [], "v", [0.5])) == [(0.5, 101, 50)]


def test_heavy_keys_of_text_ties_and_nothing(spark, rows):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "k string")
    assert rows(heavy_keys(df, "k", 0.5)) == [("a", 5), ("b", 5)]
    assert rows(heavy_keys(df.limit(0), "k", 0.5)) == []
    assert rows(heavy_keys(df.select(F.lit(None).cast("long").alias("k")), "k", 0.5)) == []


def test_distinct_members(spark, rows):
    df = spark.createDataFrame([(1, [5, 5, None], 0), (1, [5, 6], 0), (1, [5, 6], 0), (2, None, 0), (2, [], 0), (3, [None], 0), (None, [9], 0)], "k long, m array<long>, n_rows int")
    assert rows(distinct_members(df, "k", "m", 0.4)) == [(1, 3, 2, True), (2, 2, 0, False), (3, 1, 0, False)]
    assert rows(distinct_members(df.limit(0), "k", "m", 0.4)) == []


def test_half_the_rows_in_one_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.array("id", F.col("id") % 100).alias("m"))
    got = {r.k: r for r in distinct_members(df, "k", "m", 0.02).filter("heavy").collect()}
    assert list(got) == [1] and got[1].n_rows == got[1].n_members == 30_001
