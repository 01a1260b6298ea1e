"""Small graphs of known answers."""

import pytest
from pyspark.sql import functions as F

from symgraph.functions import predicates as P
from symgraph.operators import audit, budget, build, diff, impact, lookup, rank, search, stats, traverse
from symgraph.schema import CodeGraph

NODE = "ord long, id string, name string, qualified_name string, kind string, file string, line_start int, line_end int, signature string, visibility string, refs array<string>"


def graph(spark, edges, files=None, kinds=None, more=()):
    """``a>b c>d`` with an optional ``:kind`` of the edge."""
    pairs = [e.partition(":")[::2] for e in edges.split()]
    names = list(dict.fromkeys([n for p, _ in pairs for n in p.split(">")] + list(more)))
    at = {n: i + 1 for i, n in enumerate(names)}
    nodes = [(at[n], n, n, n, (kinds or {}).get(n, "function"), (files or {}).get(n, "test.rs"), i, i + 4, f"fn {n}()", "private", []) for i, n in enumerate(names)]
    rows = [(i, at[p.split(">")[0]], at[p.split(">")[1]], k or "calls", None, None) for i, (p, k) in enumerate(pairs)]
    g = CodeGraph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(rows, "eord long, src long, dst long, kind string, file string, line int"))
    return g, at, {v: k for k, v in at.items()}


def seed(spark, *ords):
    return spark.createDataFrame([(o,) for o in ords], "ord long")


def reach(spark, g, at, who, depth):
    g_, a, n = g, at, {v: k for k, v in at.items()}
    rows = impact.impact(g_, seed(spark, a[who]), depth).collect()
    return {d: {(n[r.ord], r.hop) for r in rows if r.direction == d} for d in ("up", "down")}, rows


def test_chain(spark):
    g, at, n = graph(spark, "a>b b>c")
    got, rows = reach(spark, g, at, "b", 5)
    assert got == {"up": {("a", 1)}, "down": {("c", 1)}} and all(r.severity == "direct" for r in rows)
    assert [n[o] for o in traverse.shortest_path(g, at["a"], at["c"])] == ["a", "b", "c"] and traverse.shortest_path(g, at["c"], at["a"]) is None
    assert {n[r.ord] for r in traverse.dependents(g, seed(spark, at["c"]), 2).collect()} == {"a", "b"}
    assert traverse.dependents(g, seed(spark, at["c"]), 0).collect() == []


def test_diamond_cycle_and_depth(spark):
    g, at, _ = graph(spark, "a>b a>c b>d c>d")
    assert reach(spark, g, at, "a", 5)[0]["down"] == {("b", 1), ("c", 1), ("d", 2)}
    g, at, _ = graph(spark, "a>b b>c c>a")
    got = reach(spark, g, at, "a", 10)[0]
    assert {x for x, _ in got["up"]} == {"b", "c"} == {x for x, _ in got["down"]}
    g, at, _ = graph(spark, "a>b b>c c>d d>e")
    assert {x for x, _ in reach(spark, g, at, "a", 2)[0]["down"]} == {"b", "c"}
    assert {x for x, _ in reach(spark, g, at, "a", 0)[0]["down"]} == {"b", "c", "d", "e"}


def test_entry_edge_is_inherited(spark):
    g, at, n = graph(spark, "a>b:imports b>c a>d")
    rows = {n[r.ord]: r.entry_edge for r in traverse.bfs(g.edges, seed(spark, at["a"]), "down", 5, entry_edges=True).collect()}
    assert rows == {"a": None, "b": "imports", "c": "imports", "d": "calls"}


def test_empty_and_single(spark):
    g, at, _ = graph(spark, "", more=["lonely"])
    assert reach(spark, g, at, "lonely", 5)[1] == []
    counts = impact.impact_counts(g, seed(spark, at["lonely"]), impact.impact(g, seed(spark, at["lonely"])))
    told = impact.explain_confidence(counts, impact.impact(g, seed(spark, at["lonely"]))).first()
    assert (told.confidence, told.role) == ("Low", "Isolated") and len(told.suggestions) == 2
    none = CodeGraph(g.nodes.limit(0), g.edges)
    assert rank.centrality(none).collect() == [] and stats.graph_stats(none).first().asDict() == {"nodes": 0, "files": 0, "edges": 0}


def ranked(spark, *args, **kw):
    g, at, n = graph(spark, *args, **kw)
    return {n[r.ord]: r.score for r in rank.centrality(g).collect()}, g, at


def test_ranking(spark):
    s, *_ = ranked(spark, "a>popular b>popular c>popular d>popular e>popular")
    assert s["popular"] == 1.0
    s, *_ = ranked(spark, "b>prod_target t>test_target", files={"t": "tests/b_test.rs"})
    assert s["prod_target"] > s["test_target"]
    s, *_ = ranked(spark, "a>b a>c:imports")
    assert s["b"] > s["c"]


def test_warm_start_gives_the_same_scores(spark):
    g, at, _ = graph(spark, " ".join(f"c{i}>hub" for i in range(10)) + " hub>x")
    previous = g.nodes.select("ord", F.when(F.col("name") == "hub", 1.0).otherwise(0.3).alias("score"))
    cold = {r.ord: r.score for r in rank.centrality(g, 50).collect()}
    warm = {r.ord: r.score for r in rank.centrality(g, 50, previous=previous).collect()}
    assert max(abs(cold[o] - warm[o]) for o in cold) < 1e-6
    assert rank.has_scores(rank.centrality(g, 1)) and not rank.has_scores(None)


def test_lookup_and_roles(spark):
    g, at, n = graph(spark, "a>b a>b c>b b>d", kinds={"c": "class"})
    d = {r.name: r for r in lookup.detail(g).collect()}
    assert (d["b"].callers, d["b"].callees, d["b"].role) == (3, 1, "internal") and d["a"].role == "unreachable" and d["d"].role == "utility"
    assert lookup.resolve_symbol(g.nodes, "b") == at["b"] and lookup.resolve_symbol(g.nodes, "?") is None
    with pytest.raises(KeyError):
        lookup.resolve_symbol(g.nodes, "?", strict=True)
    assert lookup.resolve_target(g.nodes, "test.rs") == ("test.rs", 1) and lookup.resolve_file(g.nodes, "./test.rs") == "test.rs"
    assert lookup.callers(g, seed(spark, at["b"])).count() == 3


def test_search(spark):
    g, _, _ = graph(spark, "", more=["validate_user", "validate_email", "send_email", "ValidateUser", "get_user_profile", "ab", "abc", "xyz", "Straße"])
    find = lambda q: [r.name for r in search.search(g.nodes, q).orderBy("ord").collect()]
    assert find("VALIDATE") == ["validate_user", "validate_email", "ValidateUser"] and find("a") == ["ab", "abc"] and find("") == [] and find("ß") == [] and find("_user_") == ["get_user_profile"]
    assert [r.name for r in search.search_any(g.nodes, "xyz|email|xyz", 2).collect()] == ["xyz", "validate_email"]
    _, total, more, nxt = search.page(search.search(g.nodes, "user"), 0, 2)
    assert (total, more, nxt) == (3, True, 2)
    near = search.suggest(g.nodes, lookup.degrees(g), "validate_usr").collect()
    assert near[0].relevance == 30
    assert {r.ord for r in search.gram_candidates(search.name_grams(g.nodes), "user").collect()} == {1, 4, 5}


def test_file_graph(spark):
    g, _, _ = graph(spark, "foo>bar foo>baz", files={"foo": "src/a.rs", "bar": "src/a.rs", "baz": "src/b.rs"})
    n, e = traverse.file_graph(g, "src/a.rs")
    assert n.count() == 2 and [tuple(r) for r in e.collect()] == [("foo", "bar", "calls")]


def test_removal(spark):
    g, _, _ = graph(spark, "foo>bar keep>foo", files={"foo": "gone.rs", "bar": "gone.rs", "keep": "keep.rs"})
    rest = g.without_files(spark.createDataFrame([("gone.rs",)], "file string"))
    assert [r.name for r in rest.nodes.collect()] == ["keep"] and rest.edges.count() == 0


def test_blast_radius(spark):
    g, at, _ = graph(spark, "main>a a>b x>b b>c", files={"b": "src/b.rs", "main": "src/main.rs", "c": "src/c.rs", "a": "src/a.rs", "x": "src/x.rs"})
    changed = diff.changed_nodes(g.nodes, spark.createDataFrame([("b.rs",)], "file string"))
    named = lambda *files: sorted(r.name for r in diff.changed_nodes(g.nodes, spark.createDataFrame([(f,) for f in files], "file string"), "src").collect())
    assert named("b.rs") == ["b"] and named("in.rs", "src\\c.rs", "", "none.rs", "/other/a.rs") == ["c", "main"]
    near = diff.reached(g.edges, changed, "up", 5, 9).collect()
    assert sorted((r.ord, r.source) for r in near) == sorted((at[x], at["b"]) for x in ("b", "a", "x", "main"))
    assert diff.BlastRadius(g, changed, files=spark.createDataFrame([("b.rs",), ("new/x.rs",), ("/x.rs",)], "file string")).files_to_update().count() == 3
    b = diff.BlastRadius(g, changed)
    s = b.summary().first()
    assert (s.direct_callers, s.indirect_callers, s.affected_nodes, s.entrypoints, s.risk) == (2, 1, 4, 2, "low")
    assert {r.file for r in b.files_to_update().collect()} == {"src/main.rs", "src/a.rs", "src/x.rs", "src/c.rs"}
    assert b.check().first().risky and "a --> b" in b.diagram()
    assert diff.guard(b, lookup.detail(g)).first().verdict == "PASS"
    g, at, _ = graph(spark, "a>a")
    assert [r.ord for r in diff.entry_ords(g).collect()] == [at["a"]]


def test_change_classes(spark):
    f = spark.createDataFrame([("src/a.rs",), ("tests/x.rs",), ("docs/y",), ("Dockerfile",)], "file string")
    c = diff.classify_changes(f)
    assert {tuple(r) for r in c.collect()} == {("code", 1), ("test", 1), ("doc", 1), ("infra", 1)} and diff.primary_class(c) == "code" and diff.primary_class(c.limit(0)) == "general"


def test_audit(spark):
    g, at, n = graph(spark, "main>a a>sink main>sink t>b b>sink sink>main:imports a>a", files={n: "lib.rs" for n in ("main", "a", "sink", "b")} | {"t": "tests/t.rs"})
    rows = audit.audit_paths(g, seed(spark, at["sink"]), 8).collect()
    assert {(">".join(n[o] for o in r.trace), r.severity) for r in rows} == {("main>a>sink", "high"), ("main>sink", "critical")}
    s = audit.audit_summary(g, audit.audit_paths(g, seed(spark, at["sink"]), 2)).first()
    assert (s.critical, s.high, s.sources) == (1, 0, 1)
    named = audit.named_paths(g, audit.audit_paths(g, seed(spark, at["sink"]), 8)).collect()
    assert {r.trace for r in named} == {"main -> a -> sink", "main -> sink"}


def test_budgets(spark, monkeypatch):
    g, at, n = graph(spark, "a>b b>c c>d")
    zero = g.nodes.select("ord", F.lit(0.0).alias("score"))
    kept, why = budget.slice_context(g, zero, at["b"], 10_000, 1)
    assert {r["name"] for r in kept} == {"a", "b", "c"} and why == "complete"
    one = kept[0]["tokens"]
    kept, why = budget.slice_context(g, zero, at["a"], one + 1, 2)
    assert [r["name"] for r in kept] == ["a"] and why == "token_budget"
    kept, _ = budget.slice_context(g, zero, at["a"], one + 1, 2, pinned=[at["b"]])
    assert [r["name"] for r in kept] == ["b"]
    assert budget.slice_context(g, zero, at["a"], 0, 3)[0].count() == 4
    rows = spark.range(100).select(F.col("id").alias("ord"), (F.col("id") % 7 + 1).alias("tokens"))
    for chunk in (3, 1000):
        used = [0]

        def take(r):
            ok = used[0] + r["tokens"] <= 50
            used[0] += r["tokens"] * ok
            return ok

        got = [r["ord"] for r in budget.fold_in_order(rows, ["ord"], take, lambda: F.col("tokens") <= 50 - used[0], chunk)]
        brute, total = [], 0
        for i in range(100):
            if total + i % 7 + 1 <= 50:
                total += i % 7 + 1
                brute.append(i)
        assert got == brute


def test_prefix_context(spark):
    g, _, _ = graph(spark, "", more=list("abcdef"))
    n = g.nodes.withColumn("line_end", F.col("line_start") + F.when(F.col("name") == "b", 0).otherwise(2))
    s = n.select("ord", (F.lit(1.0) / F.col("ord")).alias("score"))
    assert [(r.name, r.used) for r in budget.prefix_context(n, s, 45).orderBy("ord").collect()] == [("a", 20), ("b", 20), ("c", 40)]
    assert budget.prefix_context(n, s, 1000).count() == 6 and budget.prefix_context(n, s, 5).collect() == []


def test_map(spark):
    g, at, _ = graph(spark, "main>helper", files={"main": "src/main.rs", "helper": "src/lib.rs"}, more=["tested"])
    m = budget.build_map(g.nodes, g.nodes.select("ord", F.lit(0.1).alias("score")))
    assert (m["symbols_total"], m["symbols_shown"]) == (3, 3) and m["files"][0]["path"] == "src/main.rs" and m["files"][0]["symbols"][0]["centrality"] == 0.4
    assert budget.map_page(m, 0, 1)["next_offset"] == 1 and "main()" in budget.map_text(m)
    assert len(budget.build_map(g.nodes, g.nodes.select("ord", F.lit(0.1).alias("score")), tokens=1)["files"]) == 1


def test_scalars(spark):
    sig = spark.createDataFrame([("pub fn go(x: i32, mut y: Vec<(A, B)>) -> T",), ("int f(int a, char *b)",), ("struct A",), ("fn f(" + "a" * 90 + ")",), ("fn f(",), (None,)], "s string")
    assert [r[0] for r in sig.select(P.short_signature("s")).collect()] == ["go(x, y)", "f(a, *b)", "struct A", "f(...)", "f(...)", None]
    paths = spark.createDataFrame([("/r/a/b/c/d/e.rs",), ("a/b.rs",), ("lib/app.abc12345.js",), ("x/foo.min.js",)], "p string")
    assert [r[0] for r in paths.select(P.compress_path(F.col("p"), "/r")).collect()] == ["a/.../c/d/e.rs", "a/b.rs", "lib/app.abc12345.js", "x/foo.min.js"]
    assert [r[0] for r in paths.select(P.is_generated_map(F.col("p"))).collect()] == [False, False, True, True]
    hops = spark.createDataFrame([(h,) for h in (0, 1, 2, 3, 4, 100)], "h int")
    assert [r[0] for r in hops.select(P.severity(F.col("h"))).collect()] == ["direct", "direct", "transitive", "transitive", "distant", "distant"]
    names = [("main", "function", "a.rs", True), ("get_user", "function", "api/x.rs", True), ("get_user", "function", "lib/x.rs", False), ("handle_it", "method", "test/x.rs", False), ("on_click", "function", "x.rs", True), ("run", "function", "jobs/x.rs", True), ("run", "function", "x.rs", False), ("main", "class", "a.rs", False), ("build_cmd", "function", "x.rs", True)]
    df = spark.createDataFrame(names, "n string, k string, f string, want boolean")
    assert all(r.want == r.got for r in df.select("want", P.is_entry_point(F.col("n"), F.col("k"), F.col("f")).alias("got")).collect())


def test_limitations(spark):
    g, _, _ = graph(spark, "", more=[f"on_event_{i}" for i in range(7)])
    r = stats.limitations(g.nodes).first()
    assert (r.callbacks, r.handlers, r.widgets, r.warnings) == (7, 7, 0, "callbacks,event_handlers")
    assert stats.uncertain_edges(g.nodes).count() == 14 and stats.name_sample(g.nodes).count() == 6
    assert '"ok":true' in stats.envelope(g.nodes, "x").first()["json"]
    assert stats.onboarding(g, g.nodes.select("ord", F.lit(0.5).alias("score")))["nodes"] == 7


def nodes(spark, rows):
    """(name, qualified name, file, refs, kind)"""
    return spark.createDataFrame([(i + 1, q, n, q, k, f, 1, 2, None, "private", r) for i, (n, q, f, r, k) in enumerate(rows)], NODE)


def edges(spark, rows):
    return {(r.caller, r.ref, r.ord) for r in build.resolve(nodes(spark, rows)).collect()}


def test_resolver(spark):
    fn = "function"
    assert edges(spark, [("caller", "caller", "a", ["callee"], fn), ("callee", "callee", "a", [], fn)]) == {(1, "callee", 2)}
    assert edges(spark, [("main", "main", "x/a", ["pkg.Utils.helper"], fn), ("helper", "pkg.Utils.helper", "y/b", [], fn)]) == {(1, "pkg.Utils.helper", 2)}
    assert edges(spark, [("main", "main", "a", ["none"], fn)]) == set()
    assert edges(spark, [("c", "Calc.compute", "x/a", ["MathUtils.add"], fn), ("s", "Sibling.add", "x/b", [], fn), ("m", "MathUtils.add", "y/c", [], fn)]) == {(1, "MathUtils.add", 3)}
    assert edges(spark, [("m", "m", "other/x", ["helper"], fn), ("helper", "pkg.utils.helper", "src/y", [], fn)]) == {(1, "helper", 2)}
    two = [("h", "pkg.a.helper", "src/a/x", [], fn), ("h", "pkg.b.helper", "src/b/x", [], fn)]
    assert edges(spark, [*two, ("m", "m", "src/c/x", ["helper"], fn)]) == set()
    assert edges(spark, [*two, ("m", "m", "src/a/y", ["helper"], fn), ("k", "k", "src/b/y", ["helper"], fn)]) == {(3, "helper", 1), (4, "helper", 2)}
    assert edges(spark, [("helper", "helper", "1", [], fn), ("helper", "helper", "2", [], fn), ("m", "m", "3", ["helper", "m"], fn)]) == {(3, "helper", 2)}
    imports = [("./u", "./u", "src/m/a", ["validate"], "import"), ("h", "pkg.h", "lib/x", [], fn), ("v", "pkg.validate", "lib/x", [], fn), ("near", "pkg.near", "src/m/b", [], fn)]
    assert edges(spark, [*imports, ("m", "m", "src/m/a", ["h", "validate", "near", "pkg.h"], fn)]) == {(5, "validate", 3), (5, "near", 4), (5, "pkg.h", 2)}
    g = build.build_graph(nodes(spark, [*imports, ("m", "m", "src/m/a", ["near"], fn)]))
    assert g.nodes.count() == 4 and [(r.src, r.dst, r.kind) for r in g.edges.collect()] == [(5, 4, "calls")]


def test_import_maps(spark):
    n = nodes(spark, [("@t", "@t", "a", ["validate", "*as:types"], "import"), ("@u", "@u", "a", ["validate"], "import")])
    assert [tuple(r) for r in build.import_map(n).collect()] == [("a", "validate", "@u")] and [tuple(r) for r in build.namespace_map(n).collect()] == [("a", "types", "@t")]


def test_assign_ord(spark):
    raw = spark.createDataFrame([(f"f{i:03}", j) for i in range(40) for j in range(i % 5)], "file string, pos int")
    rows = build.assign_ord(raw).orderBy("file", "pos").collect()
    assert [r.ord for r in rows] == list(range(1, len(rows) + 1)) and build.assign_ord(raw.limit(0)).collect() == []


def test_enclosing_symbol(spark):
    g, _, _ = graph(spark, "", more=["outer", "inner"])
    n = g.nodes.withColumns({"line_start": F.when(F.col("name") == "outer", 1).otherwise(100), "line_end": F.when(F.col("name") == "outer", 500).otherwise(200)})
    sites = spark.createDataFrame([(1, "test.rs", 150), (2, "test.rs", 300), (3, "test.rs", 501), (4, "x.rs", 1)], "site long, file string, line int")
    assert {r.site: r.symbol for r in lookup.enclosing_symbol(n, sites).collect()} == {1: "inner", 2: "outer", 3: "test.rs:__file__", 4: "x.rs:__file__"}


def join_rows(plan):
    """Rows that the joins of a plan which has run put out."""
    name = plan.nodeName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in name else None
    if inner is not None:
        return join_rows(inner)
    here = plan.metrics().get("numOutputRows").get().value() if "Join" in name else 0
    return here + sum(join_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_enclosing_symbol_meets_crowded_lines_once(spark):
    many = 3000
    n = spark.range(many).selectExpr("id AS ord", "concat('s', id) AS id", "'hub.rs' AS file", "CAST(id % 30 AS INT) AS line_start", "CAST(30 + id % 101 AS INT) AS line_end")
    n = n.unionAll(spark.createDataFrame([(-1, None, "hub.rs", 30, 30)], "ord long, id string, file string, line_start int, line_end int"))
    sites = spark.range(many).selectExpr("id AS site", "'hub.rs' AS file", "CAST(id % 150 AS INT) AS line").unionAll(spark.createDataFrame([(-1, None, None), (-2, "hub.rs", None)], "site long, file string, line int"))
    spans = sorted((30 + i % 101 - i % 30, i, i % 30, 30 + i % 101) for i in range(many))
    best = {x: next((f"s{i}" for _, i, a, b in spans if a <= x <= b), "hub.rs:__file__") for x in range(150)}
    out = lookup.enclosing_symbol(n, sites)
    assert {r.site: r.symbol for r in out.collect()} == {i: best[i % 150] for i in range(many)} | {-1: None, -2: "hub.rs:__file__"}
    assert join_rows(out._jdf.queryExecution().executedPlan()) < 200_000


@pytest.mark.parametrize(("hubs", "limit", "depth"), [(128, 900, 2), (1, 900, 3), (128, 900, 0)])
def test_slices_do_not_meet_all_neighbours_of_a_hub(spark, monkeypatch, hubs, limit, depth):
    monkeypatch.setattr(budget, "HUBS", hubs, raising=False)
    many, first = 500, list(range(0, 500, 10))
    pairs = {(i, 0) for i in range(0, many, 2)} | {(i, 1 + i % 7) for i in range(many - 5)} | {(0, 1)}
    n = spark.range(many).selectExpr("id AS ord", "concat('n', id) AS name", "'q' AS qualified_name", "'f.rs' AS file", "'' AS signature", "1 AS line_start", "CAST(1 + id * 37 % 90 AS INT) AS line_end")
    g = CodeGraph(n, spark.createDataFrame([(a, b, "calls") for a, b in sorted(pairs)], "src long, dst long, kind string"))
    score = {i: i * 31 % 11 / 10 for i in range(0, many, 3)}
    tokens = {i: -(-(len(f"n{i}") + 5 + 40 * (i * 37 % 90 + 1)) // 4) for i in range(many)}
    want = set()
    for s in first:
        hop, used, kept, whole = {s: 0}, 0, [], True
        for k in range(depth):
            at = {o for o in hop if hop[o] == k}
            for o in {b for a, b in pairs if a in at} | {a for a, b in pairs if b in at}:
                hop.setdefault(o, k + 1)
        for o in sorted(hop, key=lambda o: (hop[o], -score.get(o, 0), o)):
            if used + tokens[o] > limit:
                whole = False
                continue
            used += tokens[o]
            kept.append((s, len(kept), o, hop[o], tokens[o]))
        want |= {(*r, "complete" if whole else "token_budget") for r in kept}
    out = budget.slice_contexts(g, spark.createDataFrame(list(score.items()), "ord long, score double"), seed(spark, *first), limit, depth)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    if depth == 2:
        assert join_rows(out._jdf.queryExecution().executedPlan()) < 5000
