"""Ways by which a sink can be reached."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.predicates import is_sensitive, is_test_audit, path_severity
from symgraph.operators.traverse import bfs
from symgraph.schema import CodeGraph
from symgraph.session import checkpoint


def audit_paths(graph: CodeGraph, sink: DataFrame, max_depth: int = 8) -> DataFrame:
    """``sink, source, trace, length, severity``: all simple ways up the calls from a sink to a vertex without callers.

    A way has at most ``max_depth`` vertices. Callers in test files are not
    entered, but a vertex whose callers are all tests is no source. ``trace``
    goes from the source to the sink.
    """
    calls = graph.calls().select("src", "dst").distinct()
    tested = graph.nodes.where(is_test_audit(F.col("file"))).select(F.col("ord").alias("src"))
    usable = checkpoint(calls.join(tested, "src", "left_anti").select(F.col("dst").alias("at"), F.col("src").alias("next")))
    roots = graph.nodes.select("ord").join(calls.select(F.col("dst").alias("ord")), "ord", "left_anti")
    front = sink.select(F.col("ord").alias("sink"), F.col("ord").alias("at"), F.array("ord").alias("path"))
    found = [front]
    for _ in range(max_depth - 1):
        nexts = front.join(usable, "at").where(~F.array_contains("path", F.col("next")))
        front = checkpoint(nexts.select("sink", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")))
        if front.isEmpty():
            break
        found.append(front)
    ways = reduce(DataFrame.unionAll, found).join(roots.withColumnRenamed("ord", "at"), "at", "left_semi")
    out = ways.select("sink", F.col("at").alias("source"), F.reverse("path").alias("trace"), F.size("path").alias("length"))
    return out.withColumn("severity", path_severity(F.col("length")))


def audit_summary(graph: CodeGraph, paths: DataFrame) -> DataFrame:
    """One row: ways per severity, distinct source names, distinct files along the ways."""
    n = graph.nodes
    counts = paths.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])
    names = paths.join(n.select(F.col("ord").alias("source"), "name"), "source").agg(F.countDistinct("name").alias("sources"))
    files = paths.select(F.explode("trace").alias("ord")).distinct().join(n, "ord").agg(F.countDistinct("file").alias("files"))
    return counts.join(names, how="cross").join(files, how="cross")  # one row each


def named_paths(graph: CodeGraph, paths: DataFrame) -> DataFrame:
    """``severity, entry_point, entry_file, path_length, trace`` with names, as the CSV has them."""
    n = graph.nodes.select("ord", "name", "file")
    keyed = paths.withColumn("k", F.xxhash64("sink", "trace"))
    steps = keyed.select("k", "trace", F.posexplode("trace").alias("pos", "ord")).join(n.select("ord", "name"), "ord")
    traces = steps.groupBy("k", "trace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " -> ").alias("names"))
    out = keyed.join(traces, ["k", "trace"]).join(n.select(F.col("ord").alias("source"), F.col("name").alias("entry_point"), F.col("file").alias("entry_file")), "source")
    return out.select("severity", "entry_point", "entry_file", F.col("length").alias("path_length"), F.col("names").alias("trace"))


def sensitive_reach(graph: CodeGraph, source: DataFrame, max_depth: int = 8, direction: str = "up") -> DataFrame:
    """``seed, ord, hop`` of the vertices with a sensitive name within reach."""
    hit = graph.nodes.where(is_sensitive(F.col("name"))).select("ord")
    return bfs(graph.edges, source, direction, max_depth).where("hop > 0").join(hit, "ord", "left_semi").select("seed", "ord", "hop")
