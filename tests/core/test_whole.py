"""The queries over the whole graph, against brute force on small tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from symgraph.operators import budget, traverse
from symgraph.plans import adapters, registry

#: A chain 101 > 102 > ... > 107 > 60, a hub 7, and vertices at random.
HUB, CHAIN = 7, list(range(101, 108))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("whole"), random.Random(3)
    ords = [*range(1, 91), *CHAIN]
    pairs = [(o, HUB) for o in range(10, 50)] + list(zip(CHAIN, CHAIN[1:])) + [(rng.randint(1, 90), rng.randint(1, 90)) for _ in range(90)] + [(CHAIN[-1], 60)]
    kinds = ["calls" if i % 7 or i < 60 else "imports" for i in range(len(pairs))]
    name = lambda o: f"db_{o}" if o % 9 == 0 or o in (101, 102) else f"n{o % 50}"
    nodes = [(o, f"id{o}", name(o), f"q.n{o}", "function", f"f{o // 3}.rs", o, o + o % 9, f"fn n{o}()", "public", False, False, False, None, []) for o in ords]
    cols = "ord long, id string, name string, qualified_name string, kind string, file string, line_start int, line_end int, signature string"
    spark.createDataFrame(nodes, cols + ", visibility string, is_async boolean, is_static boolean, is_exported boolean, docstring string, refs array<string>").write.parquet(f"{at}/nodes.parquet")
    spark.createDataFrame([], cols).write.parquet(f"{at}/shared_symbols.parquet")
    edges = [(i, f"id{a}", f"id{b}", k, None, None) for i, ((a, b), k) in enumerate(zip(pairs, kinds))]
    spark.createDataFrame(edges, "eord long, source string, target string, kind string, file string, line int").write.parquet(f"{at}/graph_edges.parquet")
    spark.createDataFrame([(o, 1.0 / o) for o in ords], "ord long, score double").write.parquet(f"{at}/scored_nodes.parquet")
    return str(at), ords, list(zip(pairs, kinds)), {n[0]: n for n in nodes}


def rows(spark, tables, name):
    return [tuple(r) for r in registry.queries()[name](spark, tables[0]).collect()]


def wanted(tables):
    return {o for o in tables[1] if o % 20 == 0} | {HUB}


def walk(tables, start, direction, depth):
    """``{ord: hop}`` from one vertex."""
    to = defaultdict(set)
    for (a, b), _ in tables[2]:
        if direction in ("down", "both"):
            to[a].add(b)
        if direction in ("up", "both"):
            to[b].add(a)
    hops, front = {start: 0}, {start}
    for h in range(1, depth + 1):
        front = {y for x in front for y in to[x]} - hops.keys()
        hops |= dict.fromkeys(front, h)
    return hops


def test_lookups_answer_for_all(spark, tables):
    calls = [p for p, k in tables[2] if k == "calls"]
    assert sorted(r[:2] for r in rows(spark, tables, "callers")) == sorted((b, a) for a, b in calls)
    assert sorted(r[:2] for r in rows(spark, tables, "callees")) == sorted(calls)
    told = {r[0]: r[1] for r in rows(spark, tables, "explain_symbols")}
    assert told == {o: ",".join([tables[3][a][2] for a in sorted(a for a, b in calls if b == o)[:5]]) for o in tables[1]}
    found = {r[1]: r[2] for r in rows(spark, tables, "batch_query")}
    by_name = {n[2]: o for o, n in sorted(tables[3].items(), reverse=True)}
    assert found == by_name | {n[1]: o for o, n in tables[3].items()}


def test_walks_start_at_the_query_set(spark, tables):
    up = {(s, o, h) for s in wanted(tables) for o, h in walk(tables, s, "up", 5).items() if h}
    down = {(s, o, h) for s in wanted(tables) for o, h in walk(tables, s, "down", 5).items() if h}
    assert {s for s, _, _ in up} > {HUB}
    assert sorted(rows(spark, tables, "dependents")) == sorted(up)
    got = rows(spark, tables, "impact_analysis")
    assert sorted((d, s, o, h) for s, d, o, h, _ in got) == sorted([("up", *r) for r in up] + [("down", *r) for r in down])
    counts = {r[0]: r[1:3] for r in rows(spark, tables, "impact_confidence")}
    assert counts == {s: (sum(r[0] == s for r in up), sum(r[0] == s for r in down)) for s in wanted(tables)}
    assert sum(r[2] for r in rows(spark, tables, "impact_summary")) == len(up) + len(down)
    assert sorted(rows(spark, tables, "shortest_hops")) == sorted((s, o, h) for s in wanted(tables) for o, h in walk(tables, s, "down", 12).items())
    files = {tables[3][o][5] for o in wanted(tables)}
    changed = sorted(o for o in tables[1] if tables[3][o][5] in files)
    assert sorted(r[0] for r in rows(spark, tables, "changed_nodes")) == changed == sorted(r[0] for r in rows(spark, tables, "agent_review"))


def test_paths_and_slices_are_those_of_one_vertex(spark, tables):
    g = adapters.code_graph(spark, tables[0])
    paths = defaultdict(dict)
    for start, end, pos, o in rows(spark, tables, "shortest_path"):
        paths[start, end][pos] = o
    assert {e for _, e in paths} == wanted(tables)
    for s, e in paths:
        hops = walk(tables, e, "up", 6)
        assert s == min(hops, key=lambda o: (-hops[o], o)) and len(paths[s, e]) == hops[s] + 1
    for s, e in list(paths)[:2]:
        assert [paths[s, e][i] for i in range(len(paths[s, e]))] == traverse.shortest_path(g, s, e)
    assert traverse.shortest_paths(g, spark.createDataFrame([(60, 101)], "start long, end long")).collect() == []
    got = defaultdict(list)
    for target, _, o, *_, reason in sorted(rows(spark, tables, "slice_budget")):
        got[target].append((o, reason))
    assert got.keys() == wanted(tables)
    sc = g.nodes.select("ord", (F.lit(1.0) / F.col("ord")).alias("score"))
    for target in (HUB, 40):
        kept, reason = budget.slice_context(g, sc, target, 4000)
        assert got[target] == [(r["ord"], reason) for r in kept]
    few = budget.slice_contexts(g, sc, spark.createDataFrame([(HUB,)], "ord long"), 300).orderBy("pos").collect()
    kept, reason = budget.slice_context(g, sc, HUB, 300)
    assert reason == "token_budget" and [(r.ord, r.reason) for r in few] == [(r["ord"], reason) for r in kept]


def test_audits_and_changes_go_as_deep_as_the_operators(spark, tables):
    calls = {p for p, k in tables[2] if k == "calls"}
    called, ways = {b for _, b in calls}, []

    def up(path):
        if path[-1] not in called:
            ways.append(path[::-1])
        if len(path) < 8:
            for a, b in calls:
                if b == path[-1] and a not in path:
                    up([*path, a])

    for o in wanted(tables):
        up([o])
    got = rows(spark, tables, "audit_paths")
    assert sorted(r[2] for r in got) == sorted(">".join(map(str, w)) for w in ways) and ">".join(map(str, [*CHAIN, 60])) in {r[2] for r in got if r[4] == "low"}
    assert rows(spark, tables, "audit_summary")[0][3] == sum(len(w) > 6 for w in ways) > 0
    assert len(rows(spark, tables, "audit_named")) == len(ways)
    near = {(s, o, h) for s in wanted(tables) for o, h in walk(tables, s, "up", 8).items() if h and tables[3][o][2].startswith("db_")}
    assert sorted(rows(spark, tables, "sensitive_reach")) == sorted(near) and (60, 101, 7) in near
    files = {tables[3][o][5] for o in wanted(tables)}
    changed = [o for o in tables[1] if tables[3][o][5] in files]
    pairs = {(d, o, h) for s in changed for d in ("up", "down") for o, h in walk(tables, s, d, 5).items() if h}
    hit = {o for _, o, _ in pairs}
    entries = hit - {b for (a, b), _ in tables[2] if a != b}
    summary = (len(changed), len({o for d, o, h in pairs if d == "up" and h == 1}), len({o for d, o, h in pairs if d == "up" and h > 1}), len(hit), len({tables[3][o][5] for o in hit}), len(entries))
    assert rows(spark, tables, "blast_radius")[0][:6] == summary and any(h > 3 for *_, h in pairs)
    assert {r[0] for r in rows(spark, tables, "files_to_update")} == {tables[3][o][5] for o in hit} - files
    assert {r[0] for r in rows(spark, tables, "entrypoints_affected")} == {tables[3][o][1] for o in entries}
    assert rows(spark, tables, "risk_check")[0][:3] == (summary[3], summary[5], summary[2]) and rows(spark, tables, "guard")[0][0] == (summary[3] > 25)
