"""Answers put together, orders, stores, snapshots and streams over the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import predicates as P
from symgraph.operators import audit, budget, build, diff, impact, lookup, rank, report, stats, traverse
from symgraph.plans.adapters import code_graph, vertices, with_graph
from symgraph.plans.graph_queries import AUDIT, BLAST, BOTH, CONF, COUNTS, DEGREE, ENTRY, IMPORTS, MAPPED, RANK, RESOLVE, SCORES, SEEDS, SEV, blast, graph, lean, scores, wanted
from symgraph.plans.pipeline_queries import ORACLE as PIPELINE
from symgraph.plans.pipeline_queries import changes
from symgraph.schema import CodeGraph
from symgraph.session import checkpoint, shared_folder, ship, table
from symgraph.sources import files as S
from symgraph.streaming.changes import apply_patch, debounce, update_message
from symgraph.streaming.watch import append_to, change_stream, persister

Q, O = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """A folder of this run's own in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/symgraph-{uuid.uuid4().hex}"


# ------------------------------------------------------------- symbols with their surroundings


BOTHWAYS = """
    up_ AS (SELECT e.dst AS ord, list(v.id ORDER BY v.ord, v.id) AS called_by FROM e JOIN v ON v.ord = e.src WHERE e.kind = 'calls' GROUP BY 1),
    down_ AS (SELECT e.src AS ord, list(v.id ORDER BY v.ord, v.id) AS calls FROM e JOIN v ON v.ord = e.dst WHERE e.kind = 'calls' GROUP BY 1)
"""


@query(with_graph("SELECT ord, id, qualified_name, signature, array_to_string(coalesce(called_by, []), ',') AS called_by, array_to_string(coalesce(calls, []), ',') AS calls FROM v LEFT JOIN up_ USING (ord) LEFT JOIN down_ USING (ord)", BOTHWAYS))
def node_get(spark, d):
    g = code_graph(spark, d)
    out = report.neighbour_ids(g, g.nodes.select("ord"))
    return out.select("ord", "id", "qualified_name", "signature", F.array_join("called_by", ",").alias("called_by"), F.array_join("calls", ",").alias("calls"))


@query(
    with_graph(
        """SELECT pos, symbol, s.ord, v.id, kind, file, line_start, line_end, round(coalesce(score, 0), 6) AS centrality, coalesce(len(called_by), 0) AS callers, coalesce(len(calls), 0) AS callees, coalesce(called_by[1], '') AS first_caller
        FROM (SELECT name AS symbol, min(ord) AS pos, min(ord) AS ord FROM v WHERE name NOT IN (SELECT id FROM v) GROUP BY 1) s JOIN v USING (ord) LEFT JOIN sc USING (ord) LEFT JOIN up_ USING (ord) LEFT JOIN down_ USING (ord)""",
        f"{BOTHWAYS}, {SCORES}",
    )
)
def batch_query_detail(spark, d):
    """Every name with what is known of its symbol."""
    g = graph(spark, d)
    symbols = g.nodes.groupBy(F.col("name").alias("symbol")).agg(F.min("ord").alias("pos"))
    out = report.batch_detail(g, symbols, scores(spark, d), callers=True, callees=True)
    return out.select("pos", "symbol", "ord", "id", "kind", "file", "line_start", "line_end", F.round("centrality", 6).alias("centrality"), F.size("callers").alias("callers"), F.size("callees").alias("callees"), F.coalesce(F.try_element_at("callers", F.lit(1))["id"], F.lit("")).alias("first_caller"))


_LISTED = """SELECT e.{a} AS ord, string_agg('| `' || v.name || '` | ' || v.kind || ' | ' || format('{{:.2f}}', coalesce(score, 0)) || ' | `' || v.file || '` |', chr(10) ORDER BY coalesce(score, 0) DESC, v.ord) AS x FROM e JOIN v ON v.ord = e.{b} LEFT JOIN sc ON sc.ord = v.ord WHERE e.kind = 'calls' GROUP BY 1"""
_HEAD = "chr(10) || chr(10) || '| Symbol | Kind | Centrality | File |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)"


@query(
    with_graph(
        f"""SELECT v.ord, '# Architectural brief: `' || name || '`' || chr(10) || chr(10) || '- kind: ' || kind || chr(10) || '- file: `' || file || '`' || chr(10) || '- centrality: ' || format('{{:.2f}}', coalesce(score, 0)) || coalesce(chr(10) || '- signature: `' || signature || '`', '') || chr(10)
        || chr(10) || '## Calls' || coalesce({_HEAD} || dn.x, chr(10) || chr(10) || 'none: it is a leaf') || chr(10) || chr(10) || '## Called by' || coalesce({_HEAD} || u.x, chr(10) || chr(10) || 'none: an entry point, or unused') || chr(10) AS brief
        FROM v LEFT JOIN sc USING (ord) LEFT JOIN dn ON dn.ord = v.ord LEFT JOIN u ON u.ord = v.ord""",
        f"{SCORES}, dn AS ({_LISTED.format(a='src', b='dst')}), u AS ({_LISTED.format(a='dst', b='src')})",
    )
)
def architectural_briefs(spark, d):
    g = graph(spark, d)
    return report.briefs(g, scores(spark, d), g.nodes.select("ord"))


ROLE3 = "CASE WHEN up = 0 AND down = 0 THEN 'Isolated' WHEN up = 0 THEN 'Entry Point' WHEN down = 0 THEN 'Utility' WHEN (up <= 2 AND down > 5) OR (up > 5 AND down <= 2) THEN 'Adapter' ELSE 'Core Logic' END"
RANKS = "CASE WHEN hop <= 1 THEN 0 WHEN hop <= 3 THEN 1 ELSE 2 END"


@query(
    with_graph(
        f"""SELECT s.ord AS pos, v.id AS symbol, v.name, v.file, {ROLE3} AS role, {CONF} AS confidence, up + down AS total, coalesce(x.callers, '') AS callers
        FROM seeds s JOIN v USING (ord) JOIN own ON own.ord = s.ord JOIN cnt USING (ord) LEFT JOIN (SELECT seed, array_to_string(list(name ORDER BY {RANKS}, hop, id, name)[:5], ',') AS callers FROM aff JOIN v USING (ord) WHERE direction = 'up' GROUP BY 1) x ON x.seed = s.ord
        UNION ALL SELECT -1, '?none', NULL, NULL, NULL, NULL, NULL, NULL""",
        f"{BOTH.replace('hop < 5', 'hop < 3')}, {COUNTS}",
        recursive=True,
    )
)
def pr_summary(spark, d):
    """The vertices of the query set that own their ids, and an unknown symbol."""
    g = lean(spark, d)
    owned = g.nodes.groupBy("id").agg(F.max("ord").alias("ord"))
    symbols = owned.join(wanted(g), "ord").select(F.col("ord").alias("pos"), F.col("id").alias("symbol"))
    return report.pr_summary(g, symbols.unionAll(spark.createDataFrame([(-1, "?none")], "pos long, symbol string")))


@query(with_graph("SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, 'c,cpp,csharp,dart,go,java,kotlin,markdown,php,python,ruby,rust,shell,swift,typescript' AS languages, '1' AS version"))
def graph_info(spark, d):
    return report.graph_info(code_graph(spark, d)).withColumn("languages", F.array_join("languages", ","))


@query(
    with_graph(
        """SELECT 'total' AS section, 0 AS pos, 'nodes' AS name, NULL AS kind, NULL AS file, (SELECT count(*) FROM v)::DOUBLE AS value UNION ALL SELECT 'total', 0, 'edges', NULL, NULL, (SELECT count(*) FROM e)::DOUBLE
        UNION ALL SELECT 'total', 0, 'modules', NULL, NULL, (SELECT count(*) FROM m)::DOUBLE UNION ALL SELECT 'module', 0, dir, NULL, NULL, n::DOUBLE FROM m
        UNION ALL SELECT * FROM (SELECT 'hotspot', CAST(row_number() OVER (ORDER BY coalesce(score, 0) DESC, v.ord) - 1 AS INTEGER), name, kind, file, round(coalesce(score, 0), 6) FROM v LEFT JOIN sc USING (ord) ORDER BY 2 LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'entry_point', CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER), name, kind, file, NULL::DOUBLE FROM ent WHERE is_entry_point ORDER BY 2 LIMIT 10)""",
        f"{SCORES}, {ENTRY}, m AS (SELECT regexp_extract(replace(file, chr(92), '/'), '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM v GROUP BY 1 HAVING dir <> '')",
    )
)
def architecture_overview(spark, d):
    return report.overview(code_graph(spark, d), scores(spark, d)).withColumn("value", F.round("value", 6))


@query("SELECT up, down, CASE WHEN up = 0 AND down = 0 THEN 'Isolated' WHEN up = 0 THEN 'Entry Point' WHEN down = 0 THEN 'Utility' ELSE 'Core Logic' END AS role, CASE WHEN up + down = 0 THEN 'Low (no edges found)' ELSE 'High' END AS confidence FROM (SELECT range AS up FROM range(11)), (SELECT range AS down FROM range(11))")
def simple_roles(spark, d):
    m = spark.range(121).select(F.floor(F.col("id") / 11).alias("up"), (F.col("id") % 11).alias("down"))
    return m.select("up", "down", P.simple_role(F.col("up"), F.col("down")).alias("role"), P.simple_confidence(F.col("up") + F.col("down")).alias("confidence"))


_SAY = """list_filter([CASE WHEN up + down = 0 THEN 'Node appears isolated (no detected connections)' END, CASE WHEN up = 0 AND down > 0 THEN 'Node is an entry point (no internal callers)' END, CASE WHEN up = 0 AND down > 0 THEN 'Has ' || down || ' downstream dependencies' END,
    CASE WHEN up > 0 AND down = 0 THEN 'Node is a utility (no outgoing dependencies)' END, CASE WHEN up > 0 AND down = 0 THEN 'Called by ' || up || ' upstream nodes' END, CASE WHEN up > 0 AND down > 0 THEN up || ' callers, ' || down || ' dependencies' END,
    CASE WHEN up > 0 AND down > 0 AND up + down > 50 THEN 'Very large blast radius' WHEN up > 0 AND down > 0 AND up + down > 20 THEN 'Large blast radius detected' WHEN up > 0 AND down > 0 THEN 'Well-connected with manageable impact' END,
    CASE WHEN near > 0 THEN near || ' nodes will break immediately' END], lambda x: x IS NOT NULL)"""
_ADVISE = """list_filter([CASE WHEN up + down = 0 THEN 'Verify if this is called dynamically or from external code' END, CASE WHEN up = 0 AND down > 5 THEN 'Consider impact on downstream dependencies' END, CASE WHEN up > 0 AND down > 0 AND up + down > 50 THEN 'This change affects a significant portion of the codebase' WHEN up > 0 AND down > 0 AND up + down > 20 THEN 'Consider breaking this change into smaller refactors' END,
    'Tests still recommended for behavioral verification'], lambda x: x IS NOT NULL)"""


@query(
    with_graph(
        f"SELECT ord, array_to_string({_SAY}, '; ') AS reasons, array_to_string({_ADVISE}, '; ') AS suggestions FROM (SELECT cnt.*, coalesce((SELECT count(*) FROM aff WHERE aff.seed = cnt.ord AND direction = 'up' AND hop = 1), 0) AS near FROM cnt)",
        f"{BOTH}, {COUNTS}",
        recursive=True,
    )
)
def confidence_reasons(spark, d):
    g = lean(spark, d)
    s = wanted(g)
    a = checkpoint(impact.impact(g, s, 5))
    out = impact.explain_confidence(impact.impact_counts(g, s, a), a)
    return out.select("ord", F.array_join("reasons", "; ").alias("reasons"), F.array_join("suggestions", "; ").alias("suggestions"))


@query(with_graph(f"SELECT seed, direction, ord, CAST(row_number() OVER (PARTITION BY seed ORDER BY {RANKS}, hop, id, direction, ord) AS INTEGER) AS pos FROM aff JOIN v USING (ord)", BOTH, recursive=True))
def impact_listing(spark, d):
    """What a change of each vertex of the query set affects, in the order of a listing."""
    g = lean(spark, d)
    return impact.listed(g, impact.impact(g, wanted(g), 5)).select("seed", "direction", "ord", "pos")


_ENTRY_EDGE = """
    one AS MATERIALIZED (SELECT src, dst, min(kind) AS kind FROM e GROUP BY 1, 2),
    pred AS MATERIALIZED (SELECT b.seed, b.ord, b.hop, min(a.ord) AS at FROM up b JOIN one ON one.src = b.ord JOIN up a ON a.seed = b.seed AND a.ord = one.dst AND a.hop = b.hop - 1 WHERE b.hop > 0 GROUP BY 1, 2, 3),
    ee AS (SELECT p.seed, p.ord, p.hop, one.kind AS entry_edge FROM pred p JOIN one ON one.src = p.ord AND one.dst = p.at WHERE p.hop = 1 UNION ALL SELECT p.seed, p.ord, p.hop, ee.entry_edge FROM pred p JOIN ee ON ee.seed = p.seed AND ee.ord = p.at AND p.hop > 1)
"""


@query(with_graph("SELECT seed, ord, hop, entry_edge FROM ee", f"{SEEDS}, w AS (SELECT ord AS seed, ord, 0 AS hop FROM seeds UNION SELECT w.seed, e.src, w.hop + 1 FROM w JOIN e ON e.dst = w.ord WHERE w.hop < 5), up AS MATERIALIZED (SELECT seed, ord, min(hop) AS hop FROM w GROUP BY 1, 2), {_ENTRY_EDGE}", recursive=True))
def entry_edges(spark, d):
    """By which kind of edge a walk up from each vertex of the query set first steps."""
    g = lean(spark, d)
    return traverse.bfs(g.edges, wanted(g), "up", 5, entry_edges=True).where("hop > 0")


# ------------------------------------------------------------- ranking and maps


WARM = RANK.replace(
    "r AS (SELECT 0 AS i, ord, 1 / n AS s FROM v, n",
    """p0 AS MATERIALIZED (SELECT v.ord, coalesce(sc.score, 1 / n) AS s FROM v LEFT JOIN sc USING (ord), n),
    cc AS MATERIALIZED (SELECT ((SELECT sum(s) FROM p0) - (SELECT coalesce(sum(w * s), 0) * 0.85 FROM p0 JOIN ew ON ew.src = p0.ord)) / 0.15 AS c),
    r AS (SELECT 0 AS i, ord, CASE WHEN c > 1e-9 THEN s / c ELSE s END AS s FROM p0, cc""",
)


@query(with_graph("SELECT ord, round(score, 6) AS score FROM fin", f"{SCORES}, {WARM}", recursive=True))
def centrality_warm(spark, d):
    """The ranking begun with the scores of ``scored_nodes``."""
    return rank.centrality(graph(spark, d), previous=scores(spark, d)).select("ord", F.round("score", 6).alias("score"))


@query("SELECT (SELECT count(*) > 0 FROM scored_nodes WHERE score > 0 AND NOT isnan(score)) AS ranked, false AS unranked")
def score_gate(spark, d):
    s = scores(spark, d)
    return spark.createDataFrame([(rank.has_scores(s), rank.has_scores(s.withColumn("score", F.lit(0.0))))], "ranked boolean, unranked boolean")


SHORT = """CASE WHEN contains(signature, '(') THEN list_last(string_split(trim(string_split(signature, '(')[1]), ' ')) || '(' || array_to_string(list_filter(list_transform(string_split(regexp_extract(signature, '\\((.*)\\)', 1), ','), lambda x: list_last(string_split(trim(string_split(x, ':')[1]), ' '))), lambda x: x <> ''), ', ') || ')' ELSE trim(signature) END"""


@query(with_graph(f"SELECT ord, {SHORT} AS short FROM v WHERE signature IS NOT NULL"))
def short_signatures(spark, d):
    return vertices(spark, d).where("signature IS NOT NULL").select("ord", P.short_signature("signature").alias("short"))


@query(with_graph("SELECT ms.ord, round(ms.score + CASE WHEN contains(file, 'src') THEN 0.3 ELSE 0 END, 6) AS score FROM ms", MAPPED))
def map_focused(spark, d):
    return budget.map_scores(vertices(spark, d), scores(spark, d), focus=["src*"]).select("ord", F.round("score", 6).alias("score"))


_CAPPED = f"""{MAPPED},
    rk AS MATERIALIZED (SELECT * FROM (SELECT ord, file, score, row_number() OVER (PARTITION BY file ORDER BY score DESC, ord) AS rank FROM ms) WHERE rank <= 5),
    sq AS MATERIALIZED (SELECT r.ord, r.file, r.rank, row_number() OVER (ORDER BY b.score DESC, b.ord, r.rank) AS k FROM rk r JOIN (SELECT file, score, ord FROM rk WHERE rank = 1) b USING (file)),
    sy AS MATERIALIZED (SELECT k, rank, sq.file, sq.ord, v.name, v.kind, v.line_start, v.line_end, coalesce({SHORT}, v.name) AS short,
        CASE WHEN len(string_split(sq.file, '/')) > 4 THEN string_split(sq.file, '/')[1] || '/.../' || array_to_string(string_split(sq.file, '/')[-3:], '/') ELSE sq.file END AS path, is_entry_point FROM sq JOIN ent v USING (ord))
"""


@query(
    with_graph(
        "SELECT path, name, line_start AS line, short AS signature FROM fold JOIN sy USING (k) WHERE took",
        f"""{_CAPPED}, fold AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, '' AS ended, false AS took
        UNION ALL SELECT sy.k, CASE WHEN used < 4096 AND ended <> file AND (used = 0 OR used + length(short) + 50 <= 4096) THEN used + length(short) + 50 ELSE used END, CASE WHEN ended <> file AND used > 0 AND used < 4096 AND used + length(short) + 50 > 4096 THEN file ELSE ended END,
            used < 4096 AND ended <> file AND (used = 0 OR used + length(short) + 50 <= 4096) FROM fold JOIN sy ON sy.k = fold.k + 1)""",
        recursive=True,
    )
)
def map_symbols(spark, d):
    """What a map of 1,024 tokens shows."""
    m = budget.build_map(vertices(spark, d), scores(spark, d))
    rows = [(f["path"], s["name"], s["line"], s["signature"]) for f in m["files"] for s in f["symbols"]]
    return spark.createDataFrame(rows, "path string, name string, line int, signature string")


_LINE = "CASE WHEN kind IN ('class', 'interface', 'struct') THEN '  ' || kind || ' ' || name || ' [L' || line_start || '-' || line_end || ']' ELSE '    ' || short || '  L' || line_start END || CASE WHEN is_entry_point THEN ' ★' ELSE '' END"


@query(
    with_graph(
        "SELECT line FROM fold JOIN tl USING (k) WHERE NOT stop AND k > 0",
        f"""{_CAPPED}, tl AS MATERIALIZED (SELECT k, rank, {_LINE} AS line, strlen({_LINE}) + 1 AS cost, CASE WHEN rank = 1 THEN strlen(path) + 2 + CASE WHEN k > 1 THEN 1 ELSE 0 END ELSE 0 END AS head FROM sy),
        fold AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, false AS stop
        UNION ALL SELECT tl.k, used + head + cost, k1 AND (used + head + cost > 4096 OR (rank = 1 AND used + head > 4096)) FROM (SELECT *, fold.k > 0 AS k1 FROM fold) fold JOIN tl ON tl.k = fold.k + 1 WHERE NOT stop)""",
        recursive=True,
    )
)
def map_text(spark, d):
    """The lines of symbols in a text map of 1,024 tokens."""
    lines = report.map_lines(vertices(spark, d), scores(spark, d))
    return spark.createDataFrame([(x,) for x in lines if x.startswith("  ")], "line string")


@query(with_graph("SELECT (SELECT count(*) FROM ms) AS symbols_total, (SELECT count(DISTINCT file) FROM ms) AS files_total, true AS paged", MAPPED))
def map_pages(spark, d):
    """The envelope of a map of all symbols, read page by page."""
    n, sc = vertices(spark, d), scores(spark, d)
    m = budget.build_map(n, sc, tokens=2048)
    pages, at = [], 0
    while at is not None:
        p = budget.map_page(m, at, 7)
        pages, at = pages + p["files"], p["next_offset"]
    files = budget.map_scores(n, sc).agg(F.countDistinct("file")).first()[0]
    return spark.createDataFrame([(m["symbols_total"], files, pages == m["files"])], "symbols_total long, files_total long, paged boolean")


# ------------------------------------------------------------- overviews


@query(
    with_graph(
        """SELECT 'entry_points' AS part, CAST(k - 1 AS INTEGER) AS pos, name, file FROM (SELECT name, file, row_number() OVER (ORDER BY name, ord) AS k FROM ent WHERE is_entry_point) WHERE k <= 15
        UNION ALL SELECT 'hotspots', CAST(k - 1 AS INTEGER), name, file FROM (SELECT name, file, row_number() OVER (ORDER BY score DESC, ord) AS k FROM v JOIN sc USING (ord)) WHERE k <= 20
        UNION ALL SELECT 'extensions', CAST(k - 1 AS INTEGER), ext, NULL FROM (SELECT ext, row_number() OVER (ORDER BY n DESC, ext) AS k FROM (SELECT lower(regexp_extract(file, '\\.([^./\\\\]+)$', 1)) AS ext, count(DISTINCT file) AS n FROM v GROUP BY 1)) WHERE k <= 5""",
        f"{ENTRY}, {SCORES}",
    )
)
def onboarding(spark, d):
    o = stats.onboarding(code_graph(spark, d), scores(spark, d))
    rows = [(part, i, r["name"], r["file"]) for part in ("entry_points", "hotspots") for i, r in enumerate(o[part])] + [("extensions", i, x, None) for i, x in enumerate(o["extensions"])]
    return spark.createDataFrame(rows, "part string, pos int, name string, file string")


@query(with_graph("SELECT '{\"ok\":true,\"tool\":\"stats\",\"version\":\"1\",\"data\":{\"nodes\":' || (SELECT count(*) FROM v) || ',\"files\":' || (SELECT count(DISTINCT file) FROM v) || ',\"edges\":' || (SELECT count(*) FROM e) || '},\"meta\":{\"next\":3}}' AS json"))
def envelope(spark, d):
    return stats.envelope(stats.graph_stats(code_graph(spark, d)), "stats", offset=3)


@query(
    with_graph(
        """SELECT CASE WHEN count(*) = 0 THEN '' ELSE string_agg(line, chr(10) ORDER BY line) END AS lines FROM (SELECT DISTINCT '    ' || c.name || ' --> ' || p.name AS line FROM (SELECT * FROM ch ORDER BY ord LIMIT 5) p
        JOIN (SELECT DISTINCT e.dst, e.src FROM e WHERE e.src <> e.dst) x ON x.dst = p.ord JOIN v c ON c.ord = x.src QUALIFY row_number() OVER (PARTITION BY p.ord ORDER BY c.name, c.ord) <= 3)""",
        BLAST,
        recursive=True,
    )
)
def blast_diagram(spark, d):
    """The arrows of the diagram of a change (names have no characters that it would replace)."""
    text = blast(spark, d).diagram() or ""
    return spark.createDataFrame([("\n".join(sorted(x for x in text.split("\n") if "-->" in x)),)], "lines string")


# ------------------------------------------------------------- stores, snapshots, sinks


_VERSIONS = "n1 AS (SELECT ord, name, file, contains(file, 'a') AS again FROM v)"


@query(with_graph("SELECT file, count(*) AS stored, count(*) AS n_nodes, max(CASE WHEN again THEN 2 ELSE 1 END) AS mtime, bool_and(again) AS fresh FROM n1 WHERE NOT ends_with(file, '.py') GROUP BY file", _VERSIONS))
def store_files(spark, d):
    """All files stored, those with an a in their path stored again, Python files removed; what the store then says and holds of each."""
    n = vertices(spark, d).withColumns({"col_no": F.lit(0), "byte_start": F.lit(0), "byte_end": F.lit(0)})
    store = S.Store(spark, f"{scratch(spark)}/store")
    files = n.select("file").distinct()
    store.put(files.withColumn("mtime", F.lit(1).cast("long")), n)
    again = F.contains("file", F.lit("a"))
    store.put(files.where(again).withColumn("mtime", F.lit(2).cast("long")), n.where(again).withColumn("name", F.concat("name", F.lit("!"))))
    store.remove(files.where(F.col("file").endswith(".py")))
    held = store.nodes().groupBy("file").agg(F.count(F.lit(1)).alias("stored"), F.bool_and(F.col("name").endswith("!")).alias("fresh"))
    return store.files().join(held, "file").select("file", "stored", "n_nodes", "mtime", "fresh")


@query(with_graph("SELECT 'store' AS rung, src, count(*) AS edges FROM (SELECT caller AS src FROM res) GROUP BY ALL UNION ALL SELECT 'again', src, count(*) FROM (SELECT caller AS src FROM res) GROUP BY ALL", f"{IMPORTS}, {RESOLVE}"))
def load_ladder(spark, d):
    """A graph out of the store, resolved anew, and then out of the snapshot that this left behind."""
    n, at = vertices(spark, d).withColumns({"col_no": F.lit(0), "byte_start": F.lit(0), "byte_end": F.lit(0)}), scratch(spark)
    store = S.Store(spark, f"{at}/store")
    store.put(n.select("file").distinct().withColumn("mtime", F.lit(1).cast("long")), n)
    first, rung = S.load_or_build(spark, [(f"{at}/graph", "parquet")], lambda: None, store=store)
    again, folder = S.load_or_build(spark, [(f"{at}/graph", "parquet")], lambda: None)
    assert folder.endswith("/graph")
    counted = lambda g, name: g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("edges")).select(F.lit(name).alias("rung"), "src", "edges")
    return counted(first, rung).unionAll(counted(again, "again"))


@query(with_graph("SELECT form, kind, n, nodes FROM (SELECT kind, count(*) AS n, (SELECT count(*) FROM v) AS nodes FROM e GROUP BY 1), (SELECT unnest(['parquet', 'json', 'export']) AS form)"))
def snapshot_roundtrip(spark, d):
    """Edges by kind and the number of vertices, out of snapshots in Parquet and JSON, and of an export."""
    g, at, out = graph(spark, d), scratch(spark), []
    S.save_snapshot(g, f"{at}/parquet")
    S.save_snapshot(g, f"{at}/json", "json")
    S.export_json(g, f"{at}/export")
    for form in ("parquet", "json", "export"):
        r = S.load_snapshot(spark, f"{at}/{form}", "parquet" if form == "parquet" else "json")
        said = spark.read.json(f"{at}/export/stats").first()["nodes"] if form == "export" else r.nodes.count()
        out.append(r.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(form).alias("form"), "kind", "n", F.lit(said).alias("nodes")))
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("SELECT m.mtime AS written, count(f.path) > 0 AS stale FROM (SELECT unnest([min(mtime) - 1, max(mtime) - 1, max(mtime)]) AS mtime FROM source_files) m LEFT JOIN source_files f ON f.mtime > m.mtime GROUP BY 1")
def snapshot_staleness(spark, d):
    f = table(spark, d, "source_files").select("path", "mtime")
    r = f.agg(F.min("mtime").alias("a"), F.max("mtime").alias("b")).first()
    return spark.createDataFrame([(t, S.is_stale(f, t)) for t in sorted({r.a - 1, r.b - 1, r.b})], "written long, stale boolean")


@query(with_graph("SELECT sv.severity, s.name AS entry_point, s.file AS entry_file, CAST(length AS INTEGER) AS path_length, array_to_string(list_transform(trace, lambda x: nm.m[x]), ' -> ') AS trace FROM sv JOIN v s ON s.ord = sv.source, nm", f"{AUDIT}, nm AS (SELECT map_from_entries(list((ord, name))) AS m FROM v)", recursive=True))
def audit_csv(spark, d):
    """The audit written as CSV and read again."""
    g, at = lean(spark, d), scratch(spark)
    S.write_audit_csv(audit.named_paths(g, audit.audit_paths(g, wanted(g))), at)
    return spark.read.option("header", True).csv(at).withColumn("path_length", F.col("path_length").cast("int"))


# ------------------------------------------------------------- changes


@query(with_graph("SELECT ord, CASE WHEN file IN (SELECT file FROM v WHERE ord % 20 = 0) THEN name || '!' ELSE name END AS name FROM v"))
def reindexed(spark, d):
    """The vertices after the files of the query set were read again, with other names."""
    n = vertices(spark, d)
    changed = n.where("ord % 20 = 0").select("file").distinct()
    fresh = n.join(changed, "file", "left_semi").withColumn("name", F.concat("name", F.lit("!")))
    return build.reindex_changed(n, changed, fresh).select("ord", "name")


_PATCHED = "gone AS (SELECT DISTINCT file FROM vv WHERE ord % 30 = 0), chg AS (SELECT DISTINCT file FROM vv WHERE ord % 20 = 0 AND file NOT IN (SELECT file FROM gone)), v AS MATERIALIZED (SELECT * REPLACE (CASE WHEN file IN (SELECT file FROM chg) THEN name || '!' ELSE name END AS name) FROM vv WHERE file NOT IN (SELECT file FROM gone))"


def _patched(sql: str, more: str) -> str:
    return with_graph(sql, more).replace("v AS MATERIALIZED", "vv AS MATERIALIZED", 1).replace("own AS MATERIALIZED", f"{_PATCHED}, own AS MATERIALIZED", 1)


@query(_patched("SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM v WHERE ends_with(name, '!')) AS fresh, (SELECT count(*) FROM res) AS edges, (SELECT count(*) FROM v WHERE kind <> 'import') AS ranked", f"{IMPORTS}, {RESOLVE}"))
def patched_graph(spark, d):
    """The graph after some files were read again and some were deleted: nodes, fresh ones, edges resolved anew, ranked vertices."""
    n = checkpoint(vertices(spark, d))
    gone = n.where("ord % 30 = 0").select("file").distinct()
    changed = n.where("ord % 20 = 0").select("file").distinct().join(gone, "file", "left_anti")
    sessions = changed.withColumn("change", F.lit("modified")).unionAll(gone.withColumn("change", F.lit("deleted"))).withColumnRenamed("file", "path")
    nodes, g, ranked = apply_patch(n, sessions, lambda files: n.join(files, "file", "left_semi").withColumn("name", F.concat("name", F.lit("!"))), rounds=1)
    said = update_message(CodeGraph(nodes, g.edges), sessions.limit(0)).select("nodes", "edges")
    fresh = nodes.agg(F.count_if(F.col("name").endswith("!")).alias("fresh"))
    return said.join(fresh, how="cross").join(ranked.agg(F.count(F.lit(1)).alias("ranked")), how="cross")  # one row each


@query(PIPELINE["debounce_sessions"])
def stream_sessions(spark, d):
    """The events as a stream that is drained into a table, and the sessions of that table."""
    ship(spark)
    at = scratch(spark)
    events = change_stream(spark, f"{d}/events.parquet*", schema=spark.read.parquet(f"{d}/events.parquet").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    persister(events, append_to(f"{at}/events.parquet"), f"{at}/progress", drain=True).awaitTermination()
    return debounce(changes(spark, at), "1 hour").select("path", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n", "change")


QUERIES, ORACLE = Q, O
