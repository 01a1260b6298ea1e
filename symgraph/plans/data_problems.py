"""The queries of the general data problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators.orphans import orphan_references, parent_rows, reference_rows
from symgraph.operators.skew import heavy_keys, key_percentiles, key_stats, key_sums, weighted_values
from symgraph.operators.snapshots import snapshot_changes
from symgraph.session import micros, table


def edge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``graph_edges`` with ids trimmed and in lower case."""
    e = table(spark, sf_dir, "graph_edges")
    return e.select(F.lower(F.trim("target")).alias("target"), F.lower(F.trim("source")).alias("source"), "kind", "line")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = heavy_keys(weighted_values(edge_targets(spark, sf_dir), "target", "source"), 0.01)
    return heavy.select(F.col("key").alias("target"))


def p2_target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edge_targets(spark, sf_dir).where("target IS NOT NULL")
    sources = key_stats(weighted_values(e, "target", "source")).select("key", "n_rows", F.col("n_distinct").alias("n_sources"))
    kinds = key_stats(weighted_values(e, "target", "kind")).select("key", F.col("mode").alias("mode_kind"))
    lines = key_percentiles(weighted_values(e, "target", "line"), [0.5, 0.9])
    lines = lines.groupBy("key").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"line_p{round(100 * p)}") for p in (0.5, 0.9)])
    out = sources.join(kinds, "key").join(lines, "key", "left")
    return out.withColumnRenamed("key", "target")


def p2_caller_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scored_nodes").select("name", "callers")
    w = weighted_values(rows, "name", "callers")
    s, st = key_sums(w), key_stats(w).select(F.col("key").alias("k"), "n_distinct", "mode")
    return s.join(st, F.col("key").eqNullSafe(F.col("k"))).select(F.col("key").alias("name"), "n_rows", F.col("value_sum").alias("callers_sum"), F.col("n_distinct").alias("n_callers"), F.col("mode").alias("callers_mode"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(table(spark, sf_dir, "node_snapshots"), "snapshot_no", "id", "ord", ["signature", "line_start"])
    return changes.select(F.col("seq").alias("snapshot_no"), F.col("key").alias("id"), "change_kind")


REFERENCE_TAGS = {0: ("graph_edges", "source"), 1: ("graph_edges", "target"), 2: ("symbol_relations", "to_name")}


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_table, row_id, ref_field, at`` of the missing references, each row once."""
    nodes, shared = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "shared_symbols")
    edges, relations = table(spark, sf_dir, "graph_edges"), table(spark, sf_dir, "symbol_relations")
    begin, end, at = micros(F.col("indexed_at")), micros(F.col("removed_at")), micros(F.col("recorded_at"))
    parents = None
    for space, key in (("id", "id"), ("name", "name"), ("name", "qualified_name")):
        for rows in (parent_rows(nodes, space, F.col(key), begin, end), parent_rows(shared, space, F.col(key), begin)):
            parents = rows if parents is None else parents.unionAll(rows)
    refs = reference_rows(edges, "id", 0, F.lower(F.trim("source")), F.col("eord"), at)
    refs = refs.unionAll(reference_rows(edges, "id", 1, F.lower(F.trim("target")), F.col("eord"), at))
    refs = refs.unionAll(reference_rows(relations, "name", 2, F.trim("to_name"), F.col("rel_id"), at))
    missing = orphan_references(parents, refs).distinct()
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for _, x in sorted(REFERENCE_TAGS.items())]), F.col("tag") + 1)
    return missing.select(pick(0).alias("ref_table"), "row_id", pick(1).alias("ref_field"), "at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("ref_table", "row_id", "ref_field").distinct()


def p7_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = orphans(spark, sf_dir).groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month"))
    return months.agg(F.count(F.lit(1)).alias("n_orphans"))


QUERIES = {
    "p2_found": p2_found,
    "p2_target_stats": p2_target_stats,
    "p2_caller_sums": p2_caller_sums,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_monthly": p7_monthly,
}

_ORPHANS = """
    WITH ids AS (SELECT id AS k, indexed_at, removed_at FROM nodes
                 UNION ALL SELECT id, indexed_at, NULL FROM shared_symbols),
    names AS (SELECT name AS k, indexed_at, removed_at FROM nodes
              UNION ALL SELECT qualified_name, indexed_at, removed_at FROM nodes
              UNION ALL SELECT name, indexed_at, NULL FROM shared_symbols
              UNION ALL SELECT qualified_name, indexed_at, NULL FROM shared_symbols),
    refs AS (SELECT DISTINCT 'graph_edges' AS ref_table, eord AS row_id, 'source' AS ref_field, lower(trim(source)) AS k, recorded_at
             FROM graph_edges WHERE source IS NOT NULL
             UNION ALL
             SELECT DISTINCT 'graph_edges', eord, 'target', lower(trim(target)), recorded_at FROM graph_edges WHERE target IS NOT NULL),
    rels AS (SELECT DISTINCT 'symbol_relations' AS ref_table, rel_id AS row_id, 'to_name' AS ref_field, trim(to_name) AS k, recorded_at
             FROM symbol_relations WHERE to_name IS NOT NULL),
    missing AS (
        SELECT ref_table, row_id, ref_field, recorded_at FROM refs r WHERE NOT EXISTS (
            SELECT 1 FROM ids p WHERE p.k = r.k AND p.indexed_at <= r.recorded_at AND (p.removed_at IS NULL OR r.recorded_at < p.removed_at))
        UNION ALL
        SELECT ref_table, row_id, ref_field, recorded_at FROM rels r WHERE NOT EXISTS (
            SELECT 1 FROM names p WHERE p.k = r.k AND p.indexed_at <= r.recorded_at AND (p.removed_at IS NULL OR r.recorded_at < p.removed_at)))
"""

ORACLE = {
    "p2_found": """
        WITH t AS (SELECT lower(trim(target)) AS target FROM graph_edges WHERE target IS NOT NULL)
        SELECT target FROM t GROUP BY target HAVING count(*) >= 0.01 * (SELECT count(*) FROM t)
    """,
    "p2_target_stats": """
        WITH e AS (SELECT lower(trim(target)) AS target, lower(trim(source)) AS source, kind, line FROM graph_edges WHERE target IS NOT NULL),
        c AS (SELECT target, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM e GROUP BY 1),
        k AS (SELECT target, kind, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, kind) AS rn FROM e WHERE kind IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT target, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY target ORDER BY line) AS rn, count(*) OVER (PARTITION BY target) AS n FROM e WHERE line IS NOT NULL),
        l AS (SELECT target, min(line) FILTER (WHERE rn >= ceil(0.5 * n)) AS line_p50, min(line) FILTER (WHERE rn >= ceil(0.9 * n)) AS line_p90 FROM r GROUP BY 1)
        SELECT c.target, n_rows, n_sources, k.kind AS mode_kind, line_p50, line_p90
        FROM c LEFT JOIN k ON k.target = c.target AND k.rn = 1 LEFT JOIN l ON l.target = c.target
    """,
    "p2_caller_sums": """
        WITH v AS (SELECT name, callers, count(*) AS w FROM scored_nodes GROUP BY 1, 2),
        m AS (SELECT name, callers, row_number() OVER (PARTITION BY name ORDER BY w DESC, callers) AS rn FROM v WHERE callers IS NOT NULL)
        SELECT v.name, CAST(sum(w) AS BIGINT) AS n_rows, CAST(sum(v.callers * w) AS BIGINT) AS callers_sum, count(v.callers) AS n_callers, max(m.callers) AS callers_mode
        FROM v LEFT JOIN m ON m.name IS NOT DISTINCT FROM v.name AND m.rn = 1 GROUP BY v.name
    """,
    "p5_found": """
        WITH s AS (SELECT snapshot_no, id, arg_max(struct_pack(s := signature, l := line_start), ord) AS v FROM node_snapshots GROUP BY 1, 2),
        n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM node_snapshots)),
        cur AS (SELECT s.snapshot_no, s.id, s.v FROM s JOIN n USING (snapshot_no) WHERE n.prev IS NOT NULL),
        old AS (SELECT n.snapshot_no, s.id, s.v FROM s JOIN n ON n.prev = s.snapshot_no)
        SELECT coalesce(cur.snapshot_no, old.snapshot_no) AS snapshot_no, coalesce(cur.id, old.id) AS id,
               CASE WHEN old.id IS NULL THEN 'added' WHEN cur.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM cur FULL JOIN old ON cur.snapshot_no = old.snapshot_no AND cur.id = old.id
        WHERE old.id IS NULL OR cur.id IS NULL OR cur.v IS DISTINCT FROM old.v
    """,
    "p7_found": _ORPHANS + "SELECT DISTINCT ref_table, row_id, ref_field FROM missing",
    "p7_monthly": _ORPHANS + "SELECT ref_table, strftime(recorded_at, '%Y-%m') AS month, count(*) AS n_orphans FROM missing GROUP BY 1, 2",
}
