"""The graph operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import predicates as P
from symgraph.operators import audit, budget, build, diff, impact, lookup, rank, search, stats, traverse
from symgraph.plans.adapters import code_graph, vertices, with_graph
from symgraph.schema import CodeGraph, node_id
from symgraph.session import checkpoint, table


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph, written once where a query walks it again and again."""
    g = code_graph(spark, sf_dir)
    return CodeGraph(checkpoint(g.nodes), checkpoint(g.edges))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "scored_nodes").where("score IS NOT NULL AND NOT isnan(score)")
    return t.groupBy("ord").agg(F.max("score").alias("score"))


def lean(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph for walks, written once with the columns that they read."""
    g = code_graph(spark, sf_dir)
    return CodeGraph(checkpoint(g.nodes.select("ord", "id", "name", "file")), checkpoint(g.edges.select("src", "dst", "kind")))


def wanted(g: CodeGraph) -> DataFrame:
    """The query set of the walks: every vertex with a number divisible by 20, and the one with most calls to it."""
    hot = g.calls().groupBy(F.col("dst").alias("ord")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ord").limit(1)
    return g.nodes.where("ord % 20 = 0").select("ord").unionAll(hot.select("ord")).distinct()


ALL = "seeds AS (SELECT ord FROM v)"
SEEDS = "seeds AS (SELECT ord FROM v WHERE ord % 20 = 0 UNION (SELECT dst FROM e WHERE kind = 'calls' GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1))"
SCORES = "sc AS (SELECT ord, max(score) AS score FROM scored_nodes WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ord)"

Q, S = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------- counts, lookups


@query(with_graph("SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(DISTINCT file) FROM v) AS files, (SELECT count(*) FROM e) AS edges"))
def graph_stats(spark, d):
    return stats.graph_stats(code_graph(spark, d))


@query(with_graph("SELECT lower(regexp_extract(file, '\\.([^./\\\\]+)$', 1)) AS ext, count(DISTINCT file) AS files FROM v GROUP BY 1"))
def status_by_ext(spark, d):
    return stats.files_by_extension(vertices(spark, d))


@query(with_graph("SELECT regexp_extract(replace(file, chr(92), '/'), '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT file) AS files, count(*) AS symbols FROM v GROUP BY 1"))
def overview_modules(spark, d):
    return stats.module_sizes(vertices(spark, d))


@query(with_graph("SELECT ord, substr(md5(file || ':' || qualified_name || ':' || kind), 1, 16) AS id FROM v"))
def node_ids(spark, d):
    return vertices(spark, d).select("ord", node_id(F.col("file"), F.col("qualified_name"), F.col("kind")).alias("id"))


@query(with_graph("SELECT id, ord FROM own"))
def id_owners(spark, d):
    from symgraph.schema import owners

    return owners(vertices(spark, d))


@query(with_graph("SELECT ord, name, file FROM v WHERE name = (SELECT min(name) FROM v WHERE kind = 'function')"))
def node_by_name(spark, d):
    n = vertices(spark, d)
    return lookup.by_name(n, n.where("kind = 'function'").agg(F.min("name")).first()[0]).select("ord", "name", "file")


@query(with_graph("SELECT ord, name, line_start FROM v WHERE file = (SELECT max(file) FROM v)"))
def nodes_in_file(spark, d):
    n = vertices(spark, d)
    return lookup.by_file(n, n.agg(F.max("file")).first()[0]).select("ord", "name", "line_start")


@query(with_graph("SELECT file, arg_max(ord, struct_pack(a := line_end - line_start, b := ord)) AS ord FROM v GROUP BY file"))
def largest_in_file(spark, d):
    return lookup.largest_in_file(vertices(spark, d))


ENTRY = """
    ent AS (SELECT *, kind IN ('function', 'method') AND (
        name IN ('main', '__main__')
        OR ((regexp_matches(lower(name), '(_view|_handler|_controller|_endpoint)$') OR regexp_matches(lower(name), '^(handle_|get_|post_|put_|delete_|patch_)'))
            AND regexp_matches(lower(file), 'route|view|handler|controller|endpoint|api'))
        OR regexp_matches(lower(name), 'webhook|receive|subscribe|^on_') OR (starts_with(lower(name), 'handle') AND NOT contains(lower(file), 'test'))
        OR ((regexp_matches(lower(name), 'job|task|worker|cron|_run$') OR lower(name) IN ('run', 'execute', 'process')) AND regexp_matches(lower(file), 'job|task|worker|cron|celery|sidekiq|background'))
        OR regexp_matches(lower(name), 'command|_cmd$') OR lower(name) IN ('cli', 'invoke')) AS is_entry_point FROM v)
"""
DEGREE = """
    deg AS (SELECT v.ord, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees FROM v
        LEFT JOIN (SELECT dst, count(*) AS n FROM e WHERE kind = 'calls' GROUP BY 1) i ON i.dst = v.ord
        LEFT JOIN (SELECT src, count(*) AS n FROM e WHERE kind = 'calls' GROUP BY 1) o ON o.src = v.ord)
"""


@query(with_graph("SELECT ord, name, file FROM ent WHERE is_entry_point", ENTRY))
def entry_points(spark, d):
    return stats.entry_points(vertices(spark, d)).select("ord", "name", "file")


@query(
    with_graph(
        """SELECT ord, name, round(coalesce(sc.score, 0), 6) AS centrality, callers, callees, is_entry_point,
        CASE WHEN is_entry_point THEN 'entry_point' WHEN callers = 0 THEN 'unreachable' WHEN callees = 0 THEN 'utility' ELSE 'internal' END AS role
        FROM ent JOIN deg USING (ord) LEFT JOIN sc USING (ord)""",
        f"{ENTRY}, {DEGREE}, {SCORES}",
    )
)
def node_detail(spark, d):
    out = lookup.detail(code_graph(spark, d), scores(spark, d))
    return out.select("ord", "name", F.round("centrality", 6).alias("centrality"), "callers", "callees", "is_entry_point", "role")


@query(with_graph("SELECT ord, callers, callees FROM deg", DEGREE))
def degree_counts(spark, d):
    return lookup.degrees(code_graph(spark, d))


@query(with_graph("SELECT s.ord AS of_ord, v.ord, v.name FROM seeds s JOIN e ON e.dst = s.ord AND e.kind = 'calls' JOIN v ON v.ord = e.src", ALL))
def callers(spark, d):
    g = code_graph(spark, d)
    return lookup.callers(g, g.nodes.select("ord")).select("of_ord", "ord", "name")


@query(with_graph("SELECT s.ord AS of_ord, v.ord, v.name FROM seeds s JOIN e ON e.src = s.ord AND e.kind = 'calls' JOIN v ON v.ord = e.dst", ALL))
def callees(spark, d):
    g = code_graph(spark, d)
    return lookup.callees(g, g.nodes.select("ord")).select("of_ord", "ord", "name")


@query(
    with_graph(
        """SELECT pos, symbol, coalesce(a, b) AS ord FROM (SELECT symbol, min(ord) AS pos FROM (SELECT ord, id AS symbol FROM v UNION ALL SELECT ord, name FROM v) GROUP BY 1)
        LEFT JOIN (SELECT id, max(ord) AS a FROM v GROUP BY 1) i ON i.id = symbol LEFT JOIN (SELECT name, min(ord) AS b FROM v GROUP BY 1) n ON n.name = symbol"""
    )
)
def batch_query(spark, d):
    """Every id and name of the graph, and one that is unknown; a symbol's ``pos`` is its least vertex."""
    g = graph(spark, d)
    symbols = g.nodes.select("ord", F.explode(F.array("id", "name")).alias("symbol")).groupBy("symbol").agg(F.min("ord").alias("pos"))
    unknown = spark.createDataFrame([(-1, "?none")], "pos long, symbol string")
    return lookup.batch_query(g, symbols.select("pos", "symbol").unionAll(unknown))


NEIGHBOURS = """
    k AS (SELECT e.dst AS a, v.ord, v.name, row_number() OVER (PARTITION BY e.dst ORDER BY v.ord, v.name) AS k FROM e JOIN v ON v.ord = e.src WHERE e.kind = 'calls'),
    l AS (SELECT e.src AS a, v.ord, v.name, row_number() OVER (PARTITION BY e.src ORDER BY v.ord, v.name) AS k FROM e JOIN v ON v.ord = e.dst WHERE e.kind = 'calls'),
    kk AS (SELECT a, string_agg(name, ',' ORDER BY k) AS callers FROM k WHERE k <= 5 GROUP BY 1), ll AS (SELECT a, string_agg(name, ',' ORDER BY k) AS callees FROM l WHERE k <= 5 GROUP BY 1)
"""


@query(with_graph("SELECT v.ord, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM v LEFT JOIN kk ON kk.a = v.ord LEFT JOIN ll ON ll.a = v.ord", NEIGHBOURS))
def explain_symbols(spark, d):
    """The first five callers and callees of every vertex."""
    g = graph(spark, d)
    return lookup.first_neighbours(g, g.nodes.select("ord"))


# ------------------------------------------------------------- search


@query(with_graph("SELECT ord, name FROM v WHERE contains(lower(name), 'handle')"))
def search_contains(spark, d):
    return search.search(vertices(spark, d), "HANDLE").select("ord", "name")


@query(with_graph("SELECT ord, name FROM v WHERE starts_with(lower(name), 'q')"))
def search_prefix1(spark, d):
    return search.search(vertices(spark, d), "q").select("ord", "name")


@query(with_graph("SELECT ord, name FROM v WHERE contains(lower(name), 'ledger') AND kind = 'class'"))
def search_kind(spark, d):
    return search.search(vertices(spark, d), "ledger", "class").select("ord", "name")


@query(
    with_graph(
        """SELECT ord, name, term FROM (SELECT ord, id, name, term, row_number() OVER (PARTITION BY id ORDER BY term, ord) AS k
        FROM (SELECT *, CASE WHEN contains(lower(name), 'quota') THEN 0 WHEN contains(lower(name), 'ledger') THEN 1 END AS term FROM v) WHERE term IS NOT NULL) WHERE k = 1 ORDER BY term, ord LIMIT 25"""
    )
)
def search_or(spark, d):
    return search.search_any(vertices(spark, d), " quota | | ledger", 25).select("ord", "name", "term")


@query(with_graph("SELECT ord, name FROM v WHERE contains(lower(name), 'span') ORDER BY ord LIMIT 20 OFFSET 10"))
def search_page(spark, d):
    return search.page(search.search(vertices(spark, d), "span"), 10, 20)[0].select("ord", "name")


@query(with_graph("SELECT v.ord, name, round(coalesce(score, 0), 6) AS score FROM v LEFT JOIN sc USING (ord) WHERE contains(lower(name), 'joint') ORDER BY coalesce(sc.score, 0) DESC, v.ord LIMIT 10", SCORES))
def discover_topk(spark, d):
    return search.discover(vertices(spark, d), scores(spark, d), "joint").select("ord", "name", F.round("score", 6).alias("score"))


@query(with_graph("SELECT ord FROM v WHERE contains(lower(name), 'rout') AND contains(lower(name), 'oute') AND contains(lower(name), 'ute_') AND contains(lower(name), 'te_g')"))
def ngram_candidates(spark, d):
    return search.gram_candidates(search.name_grams(vertices(spark, d)), "route_g")


@query(
    with_graph(
        """SELECT ord, relevance, callers FROM (SELECT ord, CASE WHEN lower(name) = 'route_gage' THEN 100 WHEN ends_with(lower(id), 'route_gage') THEN 80 WHEN starts_with(lower(name), 'route_gage') THEN 60
        WHEN contains(lower(name), 'route_gage') THEN 40 WHEN jaro_winkler_similarity(lower(name), 'route_gage') > 0.75 THEN 30 END AS relevance FROM v) JOIN deg USING (ord) WHERE relevance IS NOT NULL ORDER BY relevance DESC, callers DESC, ord LIMIT 3""",
        DEGREE,
    )
)
def suggest_symbols(spark, d):
    g = code_graph(spark, d)
    return search.suggest(g.nodes, lookup.degrees(g), "route_gage")


# ------------------------------------------------------------- walks


@query(with_graph("SELECT a.id AS source, b.id AS target, e.kind FROM e JOIN v a ON a.ord = e.src JOIN v b ON b.ord = e.dst"))
def export_edges(spark, d):
    return traverse.export_edges(code_graph(spark, d))


@query(with_graph("SELECT a.name AS source, b.name AS target, e.kind FROM e JOIN v a ON a.ord = e.src JOIN v b ON b.ord = e.dst WHERE a.file = b.file AND a.file = (SELECT file FROM v GROUP BY file ORDER BY count(*) DESC, file LIMIT 1)"))
def file_graph(spark, d):
    g = code_graph(spark, d)
    f = g.nodes.groupBy("file").count().orderBy(F.desc("count"), "file").first()["file"]
    return traverse.file_graph(g, f)[1]


UP = """
    w AS (SELECT ord AS seed, ord, 0 AS hop FROM seeds UNION SELECT w.seed, e.src, w.hop + 1 FROM w JOIN e ON e.dst = w.ord WHERE w.hop < 5),
    up AS (SELECT seed, ord, min(hop) AS hop FROM w GROUP BY 1, 2)
"""
DOWN = """
    x AS (SELECT ord AS seed, ord, 0 AS hop FROM seeds UNION SELECT x.seed, e.dst, x.hop + 1 FROM x JOIN e ON e.src = x.ord WHERE x.hop < 5),
    down AS (SELECT seed, ord, min(hop) AS hop FROM x GROUP BY 1, 2)
"""
BOTH = f"{SEEDS}, {UP}, {DOWN}, aff AS (SELECT 'up' AS direction, seed, ord, hop FROM up WHERE hop > 0 UNION ALL SELECT 'down', seed, ord, hop FROM down WHERE hop > 0)"
SEV = "CASE WHEN hop <= 1 THEN 'direct' WHEN hop <= 3 THEN 'transitive' ELSE 'distant' END"


@query(with_graph("SELECT seed, ord, hop FROM up WHERE hop > 0", f"{SEEDS}, {UP}", recursive=True))
def dependents(spark, d):
    g = lean(spark, d)
    return traverse.dependents(g, wanted(g), 5)


@query(with_graph(f"SELECT seed, direction, ord, hop, {SEV} AS severity FROM aff", BOTH, recursive=True))
def impact_analysis(spark, d):
    g = lean(spark, d)
    return impact.impact(g, wanted(g), 5).select("seed", "direction", "ord", "hop", "severity")


@query(with_graph(f"SELECT seed, {SEV} AS severity, count(*) AS n FROM aff GROUP BY 1, 2", BOTH, recursive=True))
def impact_summary(spark, d):
    g = lean(spark, d)
    return impact.severity_summary(impact.impact(g, wanted(g), 5))


COUNTS = "cnt AS (SELECT s.ord, count(*) FILTER (WHERE direction = 'up') AS up, count(*) FILTER (WHERE direction = 'down') AS down FROM seeds s LEFT JOIN aff a ON a.seed = s.ord GROUP BY 1)"
CONF = "CASE WHEN up + down = 0 THEN 'Low' WHEN up = 0 AND down > 5 THEN 'Medium' WHEN up = 0 OR down = 0 THEN 'High' WHEN up + down > 50 THEN 'Low' WHEN up + down > 20 THEN 'Medium' ELSE 'High' END"
ROLE = "CASE WHEN up = 0 AND down = 0 THEN 'Isolated' WHEN up = 0 THEN 'Entry Point' WHEN down = 0 THEN 'Utility' WHEN (up <= 2 AND down > 5) OR (up > 5 AND down <= 2) THEN 'Adapter' ELSE 'Core Logic' END"


@query(with_graph(f"SELECT ord, up, down, up + down AS total, {CONF} AS confidence, {ROLE} AS role FROM cnt", f"{BOTH}, {COUNTS}", recursive=True))
def impact_confidence(spark, d):
    g = lean(spark, d)
    s = wanted(g)
    return impact.impact_counts(g, s, impact.impact(g, s, 5))


@query(with_graph("SELECT seed, ord, min(hop) AS hop FROM x GROUP BY 1, 2", f"{SEEDS}, x AS (SELECT ord AS seed, ord, 0 AS hop FROM seeds UNION SELECT x.seed, e.dst, x.hop + 1 FROM x JOIN e ON e.src = x.ord WHERE x.hop < 12)", recursive=True))
def shortest_hops(spark, d):
    g = lean(spark, d)
    return traverse.bfs(g.edges, wanted(g), "down", 12).select("seed", "ord", "hop")


def _farthest(g: CodeGraph) -> DataFrame:
    """Each vertex of the query set with its farthest caller within six steps."""
    up = traverse.bfs(g.edges, wanted(g), "up", 6)
    return up.groupBy(F.col("seed").alias("end")).agg(F.min_by("ord", F.struct(-F.col("hop"), F.col("ord"))).alias("start"))


@query(None)
def shortest_path(spark, d):
    """To each vertex of the query set from its farthest caller within six steps; of several ways one, so see ``shortest_path_steps``."""
    g = lean(spark, d)
    return traverse.shortest_paths(g, _farthest(g))


@query(
    with_graph(
        """SELECT seed AS "end", arg_min(ord, struct_pack(a := -hop, b := ord)) AS start, CAST(max(hop) + 1 AS BIGINT) AS vertices, CAST(max(hop) AS BIGINT) AS steps FROM u GROUP BY 1""",
        f"{SEEDS}, w AS (SELECT ord AS seed, ord, 0 AS hop FROM seeds UNION SELECT w.seed, e.src, w.hop + 1 FROM w JOIN e ON e.dst = w.ord WHERE w.hop < 6), u AS (SELECT seed, ord, min(hop) AS hop FROM w GROUP BY 1, 2)",
        recursive=True,
    )
)
def shortest_path_steps(spark, d):
    """Of each way of ``shortest_path``: its vertices, and how many of its steps are edges. Both are right only for a true and shortest way."""
    g = lean(spark, d)
    p = checkpoint(traverse.shortest_paths(g, _farthest(g)))
    step = p.select("start", "end", (F.col("pos") + 1).alias("pos"), F.col("ord").alias("src")).join(p.select("start", "end", "pos", F.col("ord").alias("dst")), ["start", "end", "pos"])
    true = step.join(g.edges.select("src", "dst").distinct(), ["src", "dst"]).groupBy("start", "end").agg(F.count(F.lit(1)).alias("steps"))
    return p.groupBy("start", "end").agg(F.count(F.lit(1)).alias("vertices")).join(true, ["start", "end"], "left").fillna(0, ["steps"])


# ------------------------------------------------------------- ranking


TESTS = "(regexp_matches(lower(file), '/test|\\\\test|/spec|\\\\spec|__test__|_test\\.|\\.test\\.|\\.spec\\.|/fixture|/mock|/stub|/fake') OR regexp_matches(lower(file), '(_test\\.go|_test\\.py|_test\\.rs|test\\.ts|test\\.js)$'))"
RANK = f"""
    n AS (SELECT count(*)::DOUBLE AS n FROM v),
    ew AS MATERIALIZED (SELECT e.src, e.dst, CASE WHEN {TESTS.replace('file', 'v.file')} THEN 0.1 ELSE 1.0 END::DOUBLE / o.n AS w
        FROM e JOIN (SELECT src, count(*) AS n FROM e WHERE kind = 'calls' GROUP BY 1) o ON o.src = e.src JOIN v ON v.ord = e.src WHERE e.kind = 'calls'),
    r AS (SELECT 0 AS i, ord, 1 / n AS s FROM v, n
        UNION ALL SELECT a.i + 1, a.ord, 0.15 / n.n + 0.85 * coalesce(c.s, 0) FROM r a LEFT JOIN (SELECT ew.dst, sum(ew.w * b.s) AS s FROM r b JOIN ew ON ew.src = b.ord GROUP BY 1) c ON c.dst = a.ord, n WHERE a.i < 20),
    fin AS (SELECT ord, s / (SELECT max(s) FROM r WHERE i = 20) AS score FROM r WHERE i = 20)
"""


@query(with_graph("SELECT ord, round(score, 6) AS score FROM fin", RANK, recursive=True))
def centrality_cold(spark, d):
    return rank.centrality(graph(spark, d)).select("ord", F.round("score", 6).alias("score"))


@query(with_graph("SELECT v.ord, name, round(score, 6) AS score FROM fin JOIN v USING (ord) ORDER BY fin.score DESC, v.ord LIMIT 20", RANK, recursive=True))
def hotspots(spark, d):
    g = graph(spark, d)
    return rank.hotspots(g.nodes, rank.centrality(g), 20).select("ord", "name", F.round("score", 6).alias("score"))


# ------------------------------------------------------------- changes


CHANGED = "ch AS (SELECT * FROM v WHERE file IN (SELECT file FROM v WHERE ord IN (SELECT ord FROM seeds)))"
BLAST = f"""{SEEDS}, {CHANGED},
    w AS (SELECT ord AS seed, ord, 0 AS hop FROM ch UNION SELECT w.seed, e.src, w.hop + 1 FROM w JOIN e ON e.dst = w.ord WHERE w.hop < 5),
    x AS (SELECT ord AS seed, ord, 0 AS hop FROM ch UNION SELECT x.seed, e.dst, x.hop + 1 FROM x JOIN e ON e.src = x.ord WHERE x.hop < 5),
    aff AS (SELECT 'up' AS direction, seed, ord, min(hop) AS hop FROM w GROUP BY 1, 2, 3 HAVING min(hop) > 0 UNION ALL SELECT 'down', seed, ord, min(hop) FROM x GROUP BY 1, 2, 3 HAVING min(hop) > 0),
    an AS (SELECT a.*, v.id, v.file FROM aff a JOIN v USING (ord)),
    ep AS (SELECT DISTINCT id FROM an WHERE ord NOT IN (SELECT dst FROM e WHERE src <> dst)),
    su AS (SELECT (SELECT count(DISTINCT id) FROM ch) AS changed, count(DISTINCT id) FILTER (WHERE direction = 'up' AND hop <= 1) AS direct_callers, count(DISTINCT id) FILTER (WHERE direction = 'up' AND hop > 1) AS indirect_callers,
        count(DISTINCT id) AS affected_nodes, count(DISTINCT file) AS affected_files, (SELECT count(*) FROM ep) AS entrypoints FROM an)
"""


def blast(spark, d) -> diff.BlastRadius:
    """The change of all files with a vertex of the query set."""
    g = lean(spark, d)
    files = checkpoint(g.nodes.join(wanted(g), "ord").select("file").distinct())
    return diff.BlastRadius(g, diff.changed_nodes(g.nodes, files), files=files)


@query(with_graph("SELECT ord FROM v WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT file FROM v JOIN seeds USING (ord)) f WHERE ends_with(v.file, f.file))", SEEDS))
def changed_nodes(spark, d):
    g = lean(spark, d)
    return diff.changed_nodes(g.nodes, g.nodes.join(wanted(g), "ord").select("file")).select("ord")


@query(with_graph("SELECT ord FROM v WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT substr(file, 4) AS f FROM v JOIN seeds USING (ord)) f WHERE ends_with(v.file, f.f))", SEEDS))
def changed_nodes_partial(spark, d):
    """The same by paths that begin within a part."""
    g = lean(spark, d)
    return diff.changed_nodes(g.nodes, g.nodes.join(wanted(g), "ord").select(F.expr("substring(file, 4)").alias("file"))).select("ord")


@query(with_graph("SELECT *, CASE WHEN affected_nodes > 50 THEN 'critical' WHEN affected_nodes > 25 THEN 'high' WHEN affected_nodes > 10 THEN 'medium' ELSE 'low' END AS risk FROM su", BLAST, recursive=True))
def blast_radius(spark, d):
    return blast(spark, d).summary()


@query(with_graph("SELECT DISTINCT file FROM an WHERE file NOT IN (SELECT file FROM ch)", BLAST, recursive=True))
def files_to_update(spark, d):
    return blast(spark, d).files_to_update()


@query(with_graph("SELECT id FROM ep", BLAST, recursive=True))
def entrypoints_affected(spark, d):
    return blast(spark, d).entrypoints()


@query(with_graph("SELECT affected_nodes, entrypoints, indirect_callers, affected_nodes > 25 OR entrypoints > 0 OR indirect_callers > 12 AS risky FROM su", BLAST, recursive=True))
def risk_check(spark, d):
    return blast(spark, d).check().select("affected_nodes", "entrypoints", "indirect_callers", "risky")


@query(
    with_graph(
        """SELECT too_large, entry_changed, central_changed, CASE WHEN too_large OR entry_changed OR central_changed THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (
        SELECT (SELECT affected_nodes > 25 FROM su) AS too_large, (SELECT bool_or(is_entry_point) FROM ent WHERE ord IN (SELECT ord FROM ch)) AS entry_changed,
        (SELECT coalesce(bool_or(score > 0.4), false) FROM sc WHERE ord IN (SELECT ord FROM ch)) AS central_changed)""",
        f"{BLAST}, {ENTRY}, {SCORES}",
        recursive=True,
    )
)
def guard(spark, d):
    return diff.guard(blast(spark, d), lookup.detail(code_graph(spark, d), scores(spark, d)))


@query(
    with_graph(
        """SELECT ord, name, CASE WHEN coalesce(score, 0) > 0.3 OR is_entry_point OR callers > 10 THEN 'High' WHEN coalesce(score, 0) > 0.1 OR callers > 3 THEN 'Medium' ELSE 'Low' END AS level
        FROM ent JOIN deg USING (ord) LEFT JOIN sc USING (ord) WHERE ord IN (SELECT ord FROM ch)""",
        f"{SEEDS}, {CHANGED}, {ENTRY}, {DEGREE}, {SCORES}",
    )
)
def agent_review(spark, d):
    g = graph(spark, d)
    changed = diff.changed_nodes(g.nodes, g.nodes.join(wanted(g), "ord").select("file"))
    return diff.review(g, changed, lookup.detail(g, scores(spark, d)))


@query("SELECT CASE WHEN regexp_matches(lower(path), 'test|spec') THEN 'test' WHEN ends_with(lower(path), '.md') OR contains(lower(path), 'docs/') THEN 'doc' WHEN regexp_matches(lower(path), 'cargo\\.toml|dockerfile|\\.github/') THEN 'infra' ELSE 'code' END AS class, count(*) AS files FROM source_files GROUP BY 1")
def change_classes(spark, d):
    return diff.classify_changes(table(spark, d, "source_files").select(F.col("path").alias("file")))


# ------------------------------------------------------------- audits


AUDIT = f"""{SEEDS}, c AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'calls'),
    us AS (SELECT * FROM c WHERE src NOT IN (SELECT ord FROM v WHERE regexp_matches(lower(file), 'test|spec'))),
    p AS (SELECT ord AS sink, ord AS pt, [ord] AS path FROM seeds UNION ALL SELECT p.sink, us.src, list_append(p.path, us.src) FROM p JOIN us ON us.dst = p.pt WHERE len(p.path) < 8 AND NOT list_contains(p.path, us.src)),
    ways AS (SELECT sink, pt AS source, list_reverse(path) AS trace, len(path) AS length FROM p WHERE pt NOT IN (SELECT dst FROM c)),
    sv AS (SELECT *, CASE WHEN length <= 2 THEN 'critical' WHEN length <= 4 THEN 'high' WHEN length <= 6 THEN 'medium' ELSE 'low' END AS severity FROM ways)
"""


@query(with_graph("SELECT sink, source, array_to_string(trace, '>') AS trace, CAST(length AS INTEGER) AS length, severity FROM sv", AUDIT, recursive=True))
def audit_paths(spark, d):
    g = lean(spark, d)
    return audit.audit_paths(g, wanted(g)).withColumn("trace", F.array_join(F.col("trace").cast("array<string>"), ">"))


@query(
    with_graph(
        """SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
        (SELECT count(DISTINCT name) FROM v WHERE ord IN (SELECT source FROM sv)) AS sources, (SELECT count(DISTINCT file) FROM v WHERE ord IN (SELECT unnest(trace) FROM sv)) AS files FROM sv""",
        AUDIT,
        recursive=True,
    )
)
def audit_summary(spark, d):
    g = lean(spark, d)
    return audit.audit_summary(g, audit.audit_paths(g, wanted(g)))


@query(
    with_graph(
        "SELECT sv.severity, s.name AS entry_point, s.file AS entry_file, CAST(length AS INTEGER) AS path_length, array_to_string(list_transform(trace, lambda x: nm.m[x]), ' -> ') AS trace FROM sv JOIN v s ON s.ord = sv.source, nm",
        f"{AUDIT}, nm AS (SELECT map_from_entries(list((ord, name))) AS m FROM v)",
        recursive=True,
    )
)
def audit_named(spark, d):
    g = lean(spark, d)
    return audit.named_paths(g, audit.audit_paths(g, wanted(g)))


@query(with_graph("SELECT seed, ord, hop FROM up JOIN v USING (ord) WHERE hop > 0 AND regexp_matches(lower(name), 'query|exec|eval|write|delete|connect|send|request|fetch|open|read_file|spawn|database|sql|db|auth|login|password')", f"{SEEDS}, {UP.replace('hop < 5', 'hop < 8')}", recursive=True))
def sensitive_reach(spark, d):
    g = lean(spark, d)
    return audit.sensitive_reach(g, wanted(g))


# ------------------------------------------------------------- budgets


TOKENS = "CAST(ceil((strlen(name) + strlen(qualified_name) + strlen(file) + strlen(coalesce(signature, '')) + 40 * (greatest(line_end - line_start, 0) + 1)) / 4.0) AS BIGINT)"


@query(with_graph(f"SELECT ord, {TOKENS} AS tokens FROM v"))
def token_estimates(spark, d):
    c = [F.col(x) for x in ("name", "qualified_name", "file", "signature", "line_start", "line_end")]
    return vertices(spark, d).select("ord", P.token_estimate(*c).alias("tokens"))


@query(with_graph("SELECT ord, used FROM (SELECT v.ord, CAST(sum((line_end - line_start) * 10) OVER (ORDER BY coalesce(score, 0) DESC, v.ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM v LEFT JOIN sc USING (ord) WHERE contains(lower(name), 'anchor')) WHERE used <= 8000", SCORES))
def context_prefix(spark, d):
    return budget.prefix_context(search.search(vertices(spark, d), "anchor"), scores(spark, d), 8000).select("ord", "used")


MAPPED = f"""{ENTRY}, {SCORES},
    ms AS (SELECT ord, file, coalesce(score, 0) + CASE WHEN is_entry_point THEN 0.3 ELSE 0 END + CASE WHEN kind IN ('class', 'interface', 'struct') THEN 0.1 WHEN kind = 'constructor' THEN -0.1 WHEN kind IN ('field', 'constant') THEN -0.2 ELSE 0 END AS score
        FROM ent LEFT JOIN sc USING (ord) WHERE kind NOT IN ('import', 'export', 'module')
        AND NOT regexp_matches(lower(replace(file, chr(92), '/')), '/test|/spec|/fixture|/mock|__tests__|\\.test\\.|\\.spec\\.|_test\\.')
        AND NOT (regexp_matches(lower(replace(file, chr(92), '/')), '(\\.min\\.js|\\.min\\.css)$|\\.chunk\\.|\\.bundle\\.|/dist/|/build/|/resources/monitor/|/resources/static/|/generated/|(^|/)[^./]*\\.[0-9a-f]{{8,}}\\.[^/]*$')))
"""


@query(with_graph("SELECT ord, round(score, 6) AS score FROM ms", MAPPED))
def map_scores(spark, d):
    return budget.map_scores(vertices(spark, d), scores(spark, d)).select("ord", F.round("score", 6).alias("score"))


@query(with_graph("SELECT ord, CAST(rank AS INTEGER) AS rank FROM (SELECT ord, row_number() OVER (PARTITION BY file ORDER BY round(score, 9) DESC, ord) AS rank FROM ms) WHERE rank <= 5", MAPPED))
def map_capped(spark, d):
    s = budget.map_scores(vertices(spark, d), scores(spark, d)).withColumn("score", F.round("score", 9))
    return budget.map_capped(s, 1024).select("ord", "rank")


@query(None)
def map_budget(spark, d):
    """The map of the repository under 1,024 tokens, a row per symbol shown."""
    m = budget.build_map(vertices(spark, d), scores(spark, d))
    rows = [(i, f["path"], s["name"], s["kind"], s["line"], s["signature"], float(s["centrality"])) for i, f in enumerate(m["files"]) for s in f["symbols"]]
    return spark.createDataFrame(rows, "file_pos int, path string, name string, kind string, line int, signature string, score double")


NEAR = f"""
    b AS (SELECT src AS at, dst AS nxt FROM e UNION SELECT dst, src FROM e),
    w AS (SELECT ord AS seed, ord, 0 AS hop FROM seeds UNION SELECT w.seed, b.nxt, w.hop + 1 FROM w JOIN b ON b.at = w.ord WHERE w.hop < 2),
    cand AS MATERIALIZED (SELECT target, ord, depth, {TOKENS} AS tokens, row_number() OVER (PARTITION BY target ORDER BY depth, coalesce(score, 0) DESC, ord) AS k FROM (SELECT seed AS target, ord, min(hop) AS depth FROM w GROUP BY 1, 2) JOIN v USING (ord) LEFT JOIN sc USING (ord)),
    fold AS (SELECT ord AS target, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS kept, false AS took, false AS full_ FROM seeds
        UNION ALL SELECT c.target, c.k, CASE WHEN used + tokens <= 4000 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 4000 THEN kept + 1 ELSE kept END, used + tokens <= 4000, full_ OR used + tokens > 4000 FROM fold JOIN cand c ON c.target = fold.target AND c.k = fold.k + 1)
"""


@query(
    with_graph(
        "SELECT target, CAST(kept - 1 AS INTEGER) AS pos, ord, CAST(depth AS INTEGER) AS depth, tokens, CASE WHEN any_ THEN 'token_budget' ELSE 'complete' END AS reason FROM fold JOIN cand USING (target, k) JOIN (SELECT target, bool_or(full_) AS any_ FROM fold GROUP BY 1) USING (target) WHERE took",
        f"{SEEDS}, {SCORES}, {NEAR}",
        recursive=True,
    )
)
def slice_budget(spark, d):
    """The neighbourhood of each vertex of the query set under 4,000 tokens."""
    g = code_graph(spark, d)
    g = CodeGraph(checkpoint(g.nodes.select("ord", "name", "qualified_name", "file", "signature", "line_start", "line_end")), checkpoint(g.edges.select("src", "dst", "kind")))
    return budget.slice_contexts(g, scores(spark, d), wanted(g), 4000)


# ------------------------------------------------------------- heuristics and matrices


@query(
    with_graph(
        """SELECT ord, kind = 'class' AND regexp_matches(name, '(Widget|State|Page|Screen|View)$') AS widget, kind IN ('function', 'class') AND ends_with(lower(file), '.tsx') AND regexp_matches(name, '^\\p{Lu}') AS component,
        kind IN ('function', 'method') AND regexp_matches(lower(name), '^(on|handle)|(handler|callback|listener)$') AS event_handler, regexp_matches(lower(name), '(fn|callback|handler)$|^on_') AS callback,
        regexp_matches(lower(name), '(factory|provider|injector|container)$|singleton') AS injected, is_entry_point AS entry_point FROM ent""",
        ENTRY,
    )
)
def heuristics_flags(spark, d):
    return stats.heuristics(vertices(spark, d))


@query(
    with_graph(
        """SELECT *, array_to_string(list_filter([CASE WHEN callbacks > 5 THEN 'callbacks' END, CASE WHEN handlers > 3 THEN 'event_handlers' END, CASE WHEN widgets > 0 THEN 'widget_tree' END], lambda x: x IS NOT NULL), ',') AS warnings
        FROM (SELECT count(*) FILTER (WHERE regexp_matches(lower(name), '(fn|callback|handler)$|^on_')) AS callbacks, count(*) FILTER (WHERE kind IN ('function', 'method') AND regexp_matches(lower(name), '^(on|handle)|(handler|callback|listener)$')) AS handlers,
        count(*) FILTER (WHERE kind = 'class' AND regexp_matches(name, '(Widget|State|Page|Screen|View)$')) AS widgets FROM v)"""
    )
)
def limitations(spark, d):
    return stats.limitations(vertices(spark, d))


@query(with_graph("SELECT 'event_source' AS source, id AS target, 'event_handler' AS kind, 0.7 AS confidence FROM v WHERE kind IN ('function', 'method') AND regexp_matches(lower(name), '^(on|handle)|(handler|callback|listener)$') UNION ALL SELECT 'caller', id, 'callback', 0.6 FROM v WHERE regexp_matches(lower(name), '(fn|callback|handler)$|^on_') UNION ALL SELECT 'parent_widget', id, 'widget_tree', 0.8 FROM v WHERE kind = 'class' AND regexp_matches(name, '(Widget|State|Page|Screen|View)$')"))
def uncertain_edges(spark, d):
    return stats.uncertain_edges(vertices(spark, d)).withColumn("confidence", F.col("confidence").cast("decimal(2,1)"))


@query(f"SELECT up, down, {CONF} AS confidence FROM (SELECT range AS up FROM range(120)), (SELECT range AS down FROM range(120))")
def confidence_matrix(spark, d):
    m = spark.range(120 * 120).select(F.floor(F.col("id") / 120).alias("up"), (F.col("id") % 120).alias("down"))
    return m.select("up", "down", P.confidence(F.col("up"), F.col("down")).alias("confidence"))


@query(f"SELECT up, down, {ROLE} AS role FROM (SELECT range AS up FROM range(11)), (SELECT range AS down FROM range(11))")
def role_matrix(spark, d):
    m = spark.range(121).select(F.floor(F.col("id") / 11).alias("up"), (F.col("id") % 11).alias("down"))
    return m.select("up", "down", P.node_role(F.col("up"), F.col("down")).alias("role"))


@query(f"SELECT hop, {SEV} AS severity FROM (SELECT range AS hop FROM range(101))")
def severity_matrix(spark, d):
    return spark.range(101).select(F.col("id").alias("hop"), P.severity(F.col("id")).alias("severity"))


# ------------------------------------------------------------- build


@query(with_graph("SELECT qualified_name AS fqn, max(ord) AS ord FROM v WHERE kind <> 'import' AND qualified_name <> '' GROUP BY 1"))
def symbol_table_lww(spark, d):
    return build.symbol_table(vertices(spark, d)).select("fqn", "ord")


IMPORTS = """
    im AS (SELECT file, local_name, arg_max(module, struct_pack(o := ord, m := module)) AS module FROM (SELECT ord, file, name AS module, unnest(refs) AS local_name FROM v WHERE kind = 'import') WHERE NOT starts_with(local_name, '*as:') GROUP BY 1, 2)
"""


@query(with_graph("SELECT file, local_name, module FROM im", IMPORTS))
def import_map(spark, d):
    return build.import_map(vertices(spark, d))


RESOLVE = f"""
    sym AS MATERIALIZED (SELECT fqn, ord, file, regexp_extract(replace(file, chr(92), '/'), '^(.*)/[^/]*$', 1) AS dir FROM (SELECT qualified_name AS fqn, arg_max(file, ord) AS file, max(ord) AS ord FROM v WHERE kind <> 'import' AND qualified_name <> '' GROUP BY 1)),
    rf AS (SELECT ord AS caller, file, regexp_extract(replace(file, chr(92), '/'), '^(.*)/[^/]*$', 1) AS dir, ref, CAST(pos - 1 AS INTEGER) AS pos FROM (SELECT ord, file, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM v WHERE kind <> 'import')),
    ex AS (SELECT rf.*, sym.ord FROM rf LEFT JOIN sym ON sym.fqn = rf.ref),
    ends AS MATERIALIZED (SELECT sym.*, substr(fqn, CAST(i AS BIGINT) + 1) AS suffix FROM sym, unnest(range(1, len(fqn))) t(i) WHERE substr(fqn, CAST(i AS BIGINT), 1) IN ('.', ':')),
    cand AS (SELECT ex.caller, ex.pos, ex.ref, ex.file, ex.dir, count(*) AS n, max(ends.ord) AS one, max(ends.file) AS one_file, max(ends.dir) AS one_dir, count(*) FILTER (WHERE ends.dir = ex.dir) AS near, max(ends.ord) FILTER (WHERE ends.dir = ex.dir) AS near_ord
        FROM ex JOIN ends ON ends.suffix = ex.ref WHERE ex.ord IS NULL GROUP BY 1, 2, 3, 4, 5),
    pk AS (SELECT caller, pos, ref, file, dir, CASE WHEN n = 1 THEN one WHEN near = 1 THEN near_ord END AS ord, CASE WHEN n = 1 THEN one_file = file OR one_dir = dir ELSE true END AS local FROM cand),
    res AS (SELECT caller, pos, ref, ord, 'exact' AS step FROM ex WHERE ord IS NOT NULL AND ord <> caller
        UNION ALL SELECT caller, pos, ref, ord, 'suffix' FROM pk WHERE ord IS NOT NULL AND ord <> caller
            AND (local OR contains(ref, '.') OR file NOT IN (SELECT file FROM im) OR EXISTS (SELECT 1 FROM im WHERE im.file = pk.file AND im.local_name = pk.ref)))
"""


@query(with_graph("SELECT caller, pos, ref, ord, step FROM res", f"{IMPORTS}, {RESOLVE}"))
def resolve_references(spark, d):
    return build.resolve(vertices(spark, d))


@query(with_graph("SELECT row_number() OVER (ORDER BY caller, pos) AS eord, caller AS src, ord AS dst, 'calls' AS kind FROM res", f"{IMPORTS}, {RESOLVE}"))
def built_edges(spark, d):
    return build.build_graph(vertices(spark, d)).edges.select("eord", "src", "dst", "kind")


@query(
    with_graph(
        """SELECT o.ord AS src, f.dst, r.kind FROM (SELECT DISTINCT ON (rel_id) * FROM symbol_relations) r JOIN (SELECT name, min(ord) AS dst FROM v GROUP BY 1) f ON f.name = trim(r.to_name) JOIN own o ON o.id = r.from_id"""
    )
)
def live_resolution(spark, d):
    r = table(spark, d, "symbol_relations").dropDuplicates(["rel_id"]).select("from_id", F.trim("to_name").alias("to_name"), "kind")
    return build.resolve_names(vertices(spark, d), r)


@query(
    with_graph(
        """SELECT site, coalesce(sym, file || ':__file__') AS symbol FROM (SELECT g.eord AS site, g.file, (SELECT arg_min(v.id, struct_pack(s := v.line_end - v.line_start, o := v.ord)) FROM v WHERE v.file = g.file AND g.line BETWEEN v.line_start AND v.line_end) AS sym
        FROM (SELECT DISTINCT ON (eord) * FROM graph_edges) g WHERE g.file IS NOT NULL AND g.line IS NOT NULL)"""
    )
)
def enclosing_symbol(spark, d):
    sites = table(spark, d, "graph_edges").where("file IS NOT NULL AND line IS NOT NULL").dropDuplicates(["eord"]).select(F.col("eord").alias("site"), "file", "line")
    return lookup.enclosing_symbol(vertices(spark, d), sites)


QUERIES, ORACLE = Q, S
