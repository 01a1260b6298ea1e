"""The test tables as a code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.schema import CodeGraph, owners
from symgraph.session import table


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``nodes`` and ``shared_symbols``, repeats once, kinds in lower case, line ranges in order."""
    n, s = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "shared_symbols")
    n = n.select("ord", "id", "name", "qualified_name", "kind", "file", "line_start", "line_end", "signature", "visibility", "is_async", "is_static", "is_exported", "docstring", "refs").dropDuplicates(["ord"])
    no = F.lit(False)
    s = s.select("ord", "id", "name", "qualified_name", "kind", "file", "line_start", "line_end", "signature", F.lit("public").alias("visibility"), no.alias("is_async"), no.alias("is_static"), no.alias("is_exported"), F.lit(None).cast("string").alias("docstring"), F.array().cast("array<string>").alias("refs"))
    rows = n.unionByName(s)
    return rows.withColumns({"kind": F.lower("kind"), "line_start": F.least("line_start", "line_end"), "line_end": F.greatest("line_start", "line_end")})


def code_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Vertices, and the edges of ``graph_edges`` whose two ends are known; an id means its last vertex."""
    nodes = vertices(spark, sf_dir)
    own = owners(nodes)
    e = table(spark, sf_dir, "graph_edges").dropDuplicates(["eord"])
    e = e.select("eord", F.lower(F.trim("source")).alias("s"), F.lower(F.trim("target")).alias("t"), "kind", "file", "line")
    e = e.join(own.select(F.col("id").alias("s"), F.col("ord").alias("src")), "s").join(own.select(F.col("id").alias("t"), F.col("ord").alias("dst")), "t")
    return CodeGraph(nodes, e.select("eord", "src", "dst", "kind", "file", "line"))


#: The same tables in DuckDB: ``v`` and ``e``.
SQL = """
    v AS MATERIALIZED (
        SELECT ord, id, name, qualified_name, lower(kind) AS kind, file, least(line_start, line_end) AS line_start, greatest(line_start, line_end) AS line_end,
               signature, visibility, is_async, is_static, is_exported, docstring, refs
        FROM (SELECT DISTINCT ON (ord) * FROM nodes)
        UNION ALL
        SELECT ord, id, name, qualified_name, lower(kind), file, least(line_start, line_end), greatest(line_start, line_end), signature, 'public', false, false, false, NULL, []
        FROM shared_symbols),
    own AS MATERIALIZED (SELECT id, max(ord) AS ord FROM v GROUP BY id),
    e AS MATERIALIZED (
        SELECT g.eord, a.ord AS src, b.ord AS dst, g.kind, g.file, g.line
        FROM (SELECT DISTINCT ON (eord) * FROM graph_edges) g
        JOIN own a ON a.id = lower(trim(g.source)) JOIN own b ON b.id = lower(trim(g.target)))
"""


def with_graph(query: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{', ' + more if more else ''} {query}"
