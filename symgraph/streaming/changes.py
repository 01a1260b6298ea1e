"""Changes of files as a stream, and what is kept up to date by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.operators.build import build_graph
from symgraph.operators.order import row_numbers
from symgraph.operators.rank import centrality
from symgraph.schema import CodeGraph
from symgraph.session import checkpoint


def debounce(changes: DataFrame, gap: str = "150 milliseconds", late: str | None = None) -> DataFrame:
    """``path, begin, end, n, change``: a path's events no further apart than the gap are one; its last event tells what happened.

    ``changes`` has ``path, change, ts`` and may be a stream, which then needs
    ``late``, by how much events may be late. Events at the same time: the
    greatest change counts.
    """
    rows = changes.withWatermark("ts", late) if late else changes
    s = rows.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "change")).alias("last"))
    return s.select("path", F.col("w.start").alias("begin"), F.col("last.ts").alias("end"), "n", F.col("last.change").alias("change"))


def settled(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files to read again, and those that are gone."""
    gone = F.col("change") == "deleted"
    return sessions.where(~gone).select(F.col("path").alias("file")), sessions.where(gone).select(F.col("path").alias("file"))


def apply_patch(nodes: DataFrame, sessions: DataFrame, extract: Callable[[DataFrame], DataFrame], previous: DataFrame | None = None, rounds: int = 20) -> tuple[DataFrame, CodeGraph, DataFrame]:
    """Nodes, graph and centrality after the changes.

    Nodes of changed and deleted files go, ``extract(files)`` gives the new ones
    (with ``ord`` beyond all others or of their own), edges are resolved anew, and the
    ranking starts warm from the scores before.
    """
    changed, gone = settled(sessions)
    rest = nodes.join(changed.unionAll(gone).distinct(), "file", "left_anti")
    new = checkpoint(rest.unionByName(extract(changed), allowMissingColumns=True))
    graph = build_graph(new)
    graph = CodeGraph(graph.nodes, checkpoint(graph.edges))
    return new, graph, centrality(graph, rounds, previous=previous)


def patch_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame, CodeGraph, DataFrame], None], extract: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each batch of sessions patches what ``read`` gives and hands it to ``write``."""
    def batch(sessions: DataFrame, _: int) -> None:
        if not sessions.isEmpty():
            write(*apply_patch(read(), sessions, extract))

    return batch


def update_message(graph: CodeGraph, sessions: DataFrame) -> DataFrame:
    """One row ``nodes, edges, files`` of what a patch led to."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = graph.edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, how="cross").join(sessions.agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("files")), how="cross")  # one row each


def numbered(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``batch`` numbers of ``size`` rows each in the given order."""
    return row_numbers(rows, order, "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size))


def snapshot_batches(graph: CodeGraph, nodes_each: int = 50, edges_each: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by their ends' ids in numbered batches, as a first snapshot is sent."""
    from symgraph.operators.traverse import export_edges

    n = numbered(graph.nodes.select("ord", "id"), ["id", "ord"], nodes_each)
    return n, numbered(export_edges(graph), ["source", "target", "kind"], edges_each)
