"""What a change of a symbol touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.predicates import confidence, node_role, severity, severity_rank
from symgraph.operators.traverse import bfs_each
from symgraph.schema import CodeGraph


def impact(graph: CodeGraph, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """``seed, direction, ord, hop, entry_edge, severity, severity_rank``: up and down within ``max_depth`` steps (0: any number).

    A vertex on a circle through the seed comes out in both directions. The
    order of a listing is severity, hop and id.
    """
    out = bfs_each(graph.edges, seeds, ["up", "down"], max_depth, entry_edges=True).where("hop > 0")
    return out.withColumns({"severity": severity(F.col("hop")), "severity_rank": severity_rank(F.col("hop"))})


def listed(graph: CodeGraph, affected: DataFrame) -> DataFrame:
    """``affected`` with ``id`` and ``pos`` 1, 2, ... in the order of a listing of each seed: severity, steps, id."""
    w = Window.partitionBy("seed").orderBy("severity_rank", "hop", "id", "direction", "ord")
    return affected.join(graph.nodes.select("ord", "id"), "ord").withColumn("pos", F.row_number().over(w))


def impact_counts(graph: CodeGraph, seeds: DataFrame, affected: DataFrame) -> DataFrame:
    """``ord, up, down, total, confidence, role`` of every seed."""
    c = affected.groupBy(F.col("seed").alias("ord")).agg(F.count_if(F.col("direction") == "up").alias("up"), F.count_if(F.col("direction") == "down").alias("down"))
    c = seeds.select("ord").join(c, "ord", "left").fillna(0, ["up", "down"])
    return c.withColumns({"total": F.col("up") + F.col("down"), "confidence": confidence(F.col("up"), F.col("down")), "role": node_role(F.col("up"), F.col("down"))})


def severity_summary(affected: DataFrame) -> DataFrame:
    return affected.groupBy("seed", "severity").agg(F.count(F.lit(1)).alias("n"))


def explain_confidence(counts: DataFrame, affected: DataFrame) -> DataFrame:
    """``counts`` with ``reasons`` and ``suggestions``, as arrays of sentences."""
    near = affected.where("direction = 'up' AND hop = 1").groupBy(F.col("seed").alias("ord")).agg(F.count(F.lit(1)).alias("near"))
    c = counts.join(near, "ord", "left").fillna(0, ["near"])
    up, down, total, n = F.col("up"), F.col("down"), F.col("total"), F.col("near")
    alone, entry, leaf = total == 0, (total > 0) & (up == 0), (up > 0) & (down == 0)
    inner, huge, large = (up > 0) & (down > 0), total > 50, (total > 20) & (total <= 50)
    say = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    there = lambda *sentences: F.filter(F.array(*sentences), lambda x: x.isNotNull())
    # the sentences are fixed values
    reasons = there(
        say(alone, "Node appears isolated (no detected connections)"),
        say(entry, "Node is an entry point (no internal callers)"),
        say(entry, "Has ", down, " downstream dependencies"),
        say(leaf, "Node is a utility (no outgoing dependencies)"),
        say(leaf, "Called by ", up, " upstream nodes"),
        say(inner, up, " callers, ", down, " dependencies"),
        say(inner & huge, "Very large blast radius"),
        say(inner & large, "Large blast radius detected"),
        say(inner & ~huge & ~large, "Well-connected with manageable impact"),
        say(n > 0, n, " nodes will break immediately"),
    )
    suggestions = there(
        say(alone, "Verify if this is called dynamically or from external code"),
        say(entry & (down > 5), "Consider impact on downstream dependencies"),
        say(inner & huge, "This change affects a significant portion of the codebase"),
        say(inner & large, "Consider breaking this change into smaller refactors"),
        F.lit("Tests still recommended for behavioral verification"),
    )
    return c.withColumns({"reasons": reasons, "suggestions": suggestions}).drop("near")
