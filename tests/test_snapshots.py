from symgraph.operators.snapshots import snapshot_changes

SCHEMA = "n int, id string, ord long, sig string, line int, seq string, v0 string"


def changes(spark, data):
    df = spark.createDataFrame([(*r, "x", None) for r in data], SCHEMA)
    return {tuple(r) for r in snapshot_changes(df, "n", "id", "ord", ["sig", "line"]).collect()}


def test_changes(spark):
    data = [
        (1, "same", 1, "s", 1), (2, "same", 9, "s", 1), (2, "same", 9, "s", 1),
        (1, "sig", 1, "s", 1), (2, "sig", 2, "S", 1),
        (1, "null", 1, None, 1), (2, "null", 2, None, 1),
        (1, "to_null", 1, "s", 1), (2, "to_null", 2, None, 1),
        (1, "gone", 1, "s", 1), (2, "new", 2, "s", 1),
        (1, "two", 1, "old", 1), (1, "two", 5, "s", 1), (2, "two", 7, "s", 1),
        (1, None, 1, "s", 1), (2, None, 2, "s", 2),
        (4, "same", 3, "s", 2), (None, "same", 3, "s", 3),
    ]
    got = changes(spark, data)
    assert {x for x in got if x[0] == 2} == {(2, "sig", "changed"), (2, "to_null", "changed"), (2, "gone", "removed"), (2, "new", "added"), (2, None, "changed")}
    assert (4, "same", "changed") in got and (4, "new", "removed") in got and not any(x[0] == 1 for x in got)


def test_long_texts_and_clashing_versions(spark):
    long = "x" * 200_000
    assert changes(spark, [(1, "a", 1, long, 1), (2, "a", 1, long + "y", 1)]) == {(2, "a", "changed")}
    # two states with one version: the greater values count, in whatever order they come
    assert changes(spark, [(1, "a", 1, "p", 1), (1, "a", 1, "q", 1), (2, "a", 1, "q", 1)]) == set()


def test_empty_and_single(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, "a", 1, "s", 1)]) == set()
