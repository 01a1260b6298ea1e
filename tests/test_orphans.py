import random

from pyspark.sql import functions as F

from symgraph.operators import orphans
from symgraph.operators.orphans import NEVER, orphan_references, parent_rows, reference_rows


def run(spark, parents, refs):
    p = parent_rows(spark.createDataFrame(parents, "k string, s long, e long"), "x", F.col("k"), F.col("s"), F.col("e"))
    r = reference_rows(spark.createDataFrame(refs, "k string, id long, t long, b string, tag string"), "x", 7, F.col("k"), F.col("id"), F.col("t"))
    return sorted((x["row_id"], x["tag"]) for x in orphan_references(p, r).collect())


def brute(parents, refs):
    out = []
    for k, i, t, *_ in refs:
        if k is not None and not any(p == k and s is not None and t is not None and s <= t < (NEVER if e is None else e) for p, s, e in parents):
            out.append((i, 7))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PARENTS_PER_RANGE", 10)
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(60)] + [""]
    parents = [(rng.choice(keys), s := rng.randrange(1, 100), rng.choice([None, s + rng.randrange(0, 50)])) for _ in range(150)]
    parents += parents[:20] + [(None, 1, None), ("k1", None, None)]
    refs = [(rng.choice(["k3", rng.choice(keys + ["none", "K1"])]), i, rng.choice([rng.randrange(1, 160), None]), "", "") for i in range(3000)]
    refs += refs[:50] + [(None, 9999, 5, "", "")]
    assert run(spark, parents, refs) == brute(parents, refs)


def test_hot_key_is_split(spark):
    refs = [("hot", i, 10, None, None) for i in range(120_000)] + [("lost", -1, 10, None, None)]
    assert run(spark, [("hot", 5, 11)], refs) == [(-1, 7)]


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1, 1, "", "")]) == [(1, 7)]
    assert run(spark, [("a", 1, None)], []) == []


def test_equal_first_hashes_are_told_apart():
    import numpy as np

    h = orphans._Range([tuple(np.array(x) for x in ([5, 5, 5], [1, 2, 3], [10, 10, 10], [20, 20, 20]))])
    assert h.holds(np.array([5, 5, 5, 6]), np.array([3, 1, 9, 1]), np.array([10, 20, 12, 12])).tolist() == [True, False, False, False]
