from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from symgraph.operators.skew import heavy_keys, hot_groups, key_percentiles, key_stats, key_sums, sized_join, weighted_values


def rows(spark, data):
    return spark.createDataFrame(data, "k string, v long, `weight` string, `key` string")


DATA = [("a", i % 7, "x", "y") for i in range(300)] + [("b", 5, "x", None), ("b", 5, None, "y"), ("b", None, "", ""), (None, 3, "x", "y"), ("c", None, None, None)]
DATA += [("neg", v, "", "") for v in (-70000, -5, -5, 2**31 - 1, 0, -(2**31))]


def test_stats_match_brute_force(spark):
    w = weighted_values(rows(spark, DATA), "k", "v")
    got = {r["key"]: (r["n_rows"], r["n_distinct"], r["mode"], r["mode_rows"]) for r in key_stats(w).collect()}
    by = defaultdict(list)
    for k, v, *_ in DATA:
        by[k].append(v)
    for k, vs in by.items():
        known = Counter(v for v in vs if v is not None)
        mode = min(known.items(), key=lambda x: (-x[1], x[0])) if known else (None, None)
        assert got[k] == (len(vs), len(known), *mode)
    sums = {r["key"]: r["value_sum"] for r in key_sums(w).collect()}
    assert sums["a"] == sum(v for v in by["a"]) and sums["c"] is None and sums["b"] == 10


@pytest.mark.parametrize("bits", [32, 64])
def test_percentiles_are_exact(spark, bits):
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["key"], r["share"]): r["value"] for r in key_percentiles(weighted_values(rows(spark, DATA), "k", "v"), shares, bits).collect()}
    by = defaultdict(list)
    for k, v, *_ in DATA:
        if v is not None:
            by[k].append(v)
    assert {k for k, _ in got} == set(by)
    for k, vs in by.items():
        vs.sort()
        for p in shares:
            assert got[k, p] == vs[max(1, -int(-p * len(vs) // 1)) - 1], (k, p)


def test_heavy_keys_leave_null_out_and_keep_ties(spark):
    data = [("hot", 1, "", "")] * 50 + [("warm", 1, "", "")] * 50 + [(None, 1, "", "")] * 900 + [("cold", 1, "", "")]
    assert {r["key"] for r in heavy_keys(weighted_values(rows(spark, data), "k", "v"), 0.4).collect()} == {"hot", "warm"}


def test_empty(spark):
    w = weighted_values(rows(spark, []), "k", "v")
    assert not key_stats(w).collect() and not key_percentiles(w, [0.5]).collect() and not heavy_keys(w, 0.1).collect()


def test_hot_groups_are_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 300)).alias("k"))
    assert [tuple(r) for r in hot_groups(df, F.col("k"), 100).collect()] == [("hot", 4)]
    hot = hot_groups(df, F.col("k"), 1)
    left = df.join(sized_join(hot), F.col("k").eqNullSafe(F.col("key")), "left").count()
    assert left == df.join(sized_join(hot, most=0), F.col("k").eqNullSafe(F.col("key")), "left").count() == df.count()
