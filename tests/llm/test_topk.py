import math
import random

from pyspark.sql import functions as F

from symgraph.llm.topk import top_n

SCHEMA = "g string, id long, s double, salt string, rank string, grp int"


def run(spark, data, n=3, subgroups=None):
    df = spark.createDataFrame([(*r, "x", None, 1) for r in data], SCHEMA)
    return sorted((r.grp or "", r["rank"], r.ident, r.score) for r in top_n(df, F.col("g"), F.col("s"), F.col("id"), n, subgroups).collect())


def brute(data, n=3):
    best = {}
    for g, i, s in data:
        if s is not None and not math.isnan(s) and i is not None:
            best.setdefault(g or "", {})[i] = max(s, best.get(g or "", {}).get(i, -math.inf))
    return sorted((g, k + 1, i, s) for g, d in best.items() for k, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n]))


def test_against_brute_force_with_hot_group(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", None, f"g{rng.randrange(50)}"]), rng.choice([rng.randrange(400), None]), rng.choice([None, math.nan, math.inf, -0.5, 1.0, 2.0])) for _ in range(4000)]
    data += data[:100]
    assert run(spark, data) == brute(data)
    for subgroups in (1, 50, 100_000):
        assert run(spark, data, subgroups=subgroups) == brute(data)
    assert run(spark, data, n=0) == []


def test_empty(spark):
    assert run(spark, []) == []
