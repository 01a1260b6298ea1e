"""Centrality of symbols by who calls them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.predicates import is_test_rank
from symgraph.schema import CodeGraph
from symgraph.session import checkpoint, partitions

DAMPING, ROUNDS, EPSILON = 0.85, 20, 1e-9
#: Rounds between checkpoints and tests of convergence.
STRIDE = 5


def call_weights(graph: CodeGraph) -> DataFrame:
    """``src, dst, w``: the share of a caller's score that flows to each callee; a tenth from test files. Parallel calls count."""
    calls = graph.calls()
    out = calls.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    w = graph.nodes.select(F.col("ord").alias("src"), F.when(is_test_rank(F.col("file")), 0.1).otherwise(1.0).alias("tw"))
    # counted by pair first: parallel calls become one row before anything is joined
    return calls.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(out, "src").join(w, "src").select("src", "dst", (F.col("tw") * F.col("n") / F.col("out")).alias("w"))


def centrality(graph: CodeGraph, rounds: int = ROUNDS, damping: float = DAMPING, previous: DataFrame | None = None) -> DataFrame:
    """``ord, score`` in 0 to 1, the greatest being 1; none for an empty graph.

    Scores flow along calls; mass at vertices that call nothing is lost.
    ``previous`` (``ord, score``) gives a warm start: it is scaled so that one
    round keeps its sum, and ends sooner at the same scores. Rounds end early
    once no score moves by 1e-9, looked at every few rounds.
    """
    n = graph.nodes.count()
    if not n:
        return graph.nodes.select("ord", F.lit(0.0).alias("score"))
    base = (1 - damping) / n
    # a row from each vertex to itself carries its share; so a round reads the scores once and shuffles once
    own = graph.nodes.select(F.col("ord").alias("src"), F.col("ord").alias("dst"), F.lit(None).cast("double").alias("w"))
    # laid by the giving vertex once: a round moves nothing but what flows, added up by receiver first
    w = checkpoint(call_weights(graph).unionAll(own).repartition(partitions(graph.nodes.sparkSession), "src"))

    def flow(s: DataFrame) -> DataFrame:
        """The next scores, and those before as ``prev``."""
        met = w.join(s.select(F.col("ord").alias("src"), "score"), "src")
        share = F.when(F.col("w").isNull(), F.lit(base)).otherwise(F.lit(damping) * F.col("w") * F.col("score"))
        return met.groupBy(F.col("dst").alias("ord")).agg(F.sum(share).alias("score"), F.max(F.when(F.col("w").isNull(), F.col("score"))).alias("prev"))

    s = graph.nodes.select("ord", F.lit(1.0 / n).alias("score"))
    if previous is not None:
        known = previous.select("ord", F.col("score").alias("p"))
        s = checkpoint(s.join(known, "ord", "left").select("ord", F.coalesce("p", "score").alias("score")))
        r = flow(s).agg(F.sum("prev").alias("total"), F.sum("score").alias("after")).first()
        c = (r["total"] - (r["after"] - n * base)) / (n * base)
        if EPSILON < c < float("inf"):
            s = s.withColumn("score", F.col("score") / c)
    for i in range(1, rounds + 1):
        s = flow(s)
        if i % STRIDE and i < rounds:
            continue
        s = checkpoint(s)
        r = s.agg(F.max("score").alias("top"), F.max(F.abs(F.col("score") - F.col("prev"))).alias("moved")).first()
        if r["moved"] < EPSILON:
            break
    top = r["top"] if rounds > 0 else 1.0
    return s.select("ord", (F.col("score") / F.lit(top if top and top > 0 else 1.0)).alias("score"))


def hotspots(nodes: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` most central vertices."""
    return nodes.join(scores.select("ord", "score"), "ord").orderBy(F.desc("score"), "ord").limit(n)


def has_scores(scores: DataFrame | None) -> bool:
    """Whether scores were computed at all: some are greater than 0."""
    return scores is not None and not scores.where("score > 0").isEmpty()
