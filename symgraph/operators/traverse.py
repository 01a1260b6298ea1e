"""Walks along edges: bounded searches from many starts at once, and shortest paths.

Every level is one join of the frontier with the edges, an aggregation that
keeps one row per start and vertex, and an anti-join with what was reached
before. Levels are cut with a checkpoint in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.schema import CodeGraph
from symgraph.session import checkpoint, partitions

#: A frontier of at most so many rows (a few numbers and a short word each) is brought to the edges, else both are shuffled.
BROADCAST_ROWS = 50_000


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """``at, to, kind``: the edges as steps ``up`` (to callers), ``down`` or ``both``."""
    down = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind")
    up = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind")
    return {"down": down, "up": up, "both": up.unionAll(down)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, direction: str, max_depth: int = 0, entry_edges: bool = False) -> DataFrame:
    """``seed, ord, hop`` of all vertices within ``max_depth`` steps of each seed (0: any number), the seeds at hop 0.

    ``seeds`` has ``ord``. The hop is the least number of steps. With
    ``entry_edges`` there is ``entry_edge`` too: the kind of the first step on such a way, at ties that by the smallest
    vertex before, then the smallest kind.
    """
    return bfs_each(edges, seeds, [direction], max_depth, entry_edges).drop("direction")


def bfs_each(edges: DataFrame, seeds: DataFrame, directions: list[str], max_depth: int = 0, entry_edges: bool = False) -> DataFrame:
    """:func:`bfs` in several directions apart, in the same rounds; with ``direction``."""
    ways = [steps(edges, d).withColumn("direction", F.lit(i)) for i, d in enumerate(directions)]
    # laid by where a step begins, so that no level moves the edges again
    way = reduce(DataFrame.unionAll, ways).repartition(partitions(edges.sparkSession), "direction", "at")
    # parallel and repeated steps do not matter here; each pair of ends is kept with its smallest kind
    way = checkpoint(way.groupBy("direction", "at", "to").agg(F.min("kind").alias("kind")) if entry_edges else way.select("direction", "at", "to").distinct())
    start = seeds.select(F.explode(F.array(*[F.lit(i) for i in range(len(directions))])).alias("direction"), F.col("ord").alias("seed"), "ord").distinct()
    front = checkpoint(start.withColumn("entry_edge", F.lit(None).cast("string")) if entry_edges else start)
    levels, depth, key, n = [front], 0, ["direction", "seed", "to"], front.count()
    while not max_depth or depth < max_depth:
        depth += 1
        seen = reduce(DataFrame.unionAll, [x.select("direction", "seed", F.col("ord").alias("to")) for x in levels])
        near = front if n > BROADCAST_ROWS else F.broadcast(front)
        met = near.withColumnRenamed("ord", "at").join(way, ["direction", "at"])
        if entry_edges:
            first = F.coalesce("entry_edge", "kind")
            nexts = met.groupBy(*key).agg(F.min(F.struct("at", first.alias("edge")))["edge"].alias("entry_edge"))
        else:
            nexts = met.select(*key).distinct()
        front = checkpoint(nexts.join(seen, key, "left_anti").withColumnRenamed("to", "ord"))
        n = front.count()
        if not n:
            break
        levels.append(front)
    # the hop and the direction's name are not written with every row
    name = F.element_at(F.array(*[F.lit(d) for d in directions]), F.col("direction") + 1).alias("direction")
    edge = ["entry_edge"] if entry_edges else []
    return reduce(DataFrame.unionAll, [x.select(name, "seed", "ord", F.lit(k).alias("hop"), *edge) for k, x in enumerate(levels)])


def dependents(graph: CodeGraph, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``seed, ord, hop``: who depends on the seeds within ``max_depth`` steps over edges of any kind; none for 0."""
    if max_depth <= 0:
        return seeds.where("false").select(F.col("ord").alias("seed"), "ord", F.lit(0).alias("hop"))
    return bfs(graph.edges, seeds, "up", max_depth).where("hop > 0")


def shortest_path(graph: CodeGraph, start: int, end: int) -> list[int] | None:
    """The vertices of a shortest way along edges of any kind, both ends included; None if there is none.

    Of several ways the one through the smallest vertices, looked at from the end.
    """
    if start == end:
        return [start]
    spark = graph.edges.sparkSession
    way = checkpoint(graph.edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    front = spark.createDataFrame([(start, None)], "ord long, before long")
    levels = [front]
    while True:
        seen = reduce(DataFrame.unionAll, levels).select(F.col("ord").alias("to"))
        nexts = front.join(way, F.col("ord") == F.col("at")).groupBy("to").agg(F.min("at").alias("before")).join(seen, "to", "left_anti")
        front = checkpoint(nexts.select(F.col("to").alias("ord"), "before"))
        if front.isEmpty():
            return None
        levels.append(front)
        if not front.where(F.col("ord") == end).isEmpty():
            break
    path = [end]
    for level in reversed(levels[1:]):
        path.append(level.where(F.col("ord") == path[-1]).first()["before"])
    return path[::-1]


def shortest_paths(graph: CodeGraph, pairs: DataFrame) -> DataFrame:
    """``start, end, pos, ord``: :func:`shortest_path` for a table of ``start, end``, all in the same rounds; pairs without a way have no rows."""
    way = checkpoint(graph.edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    todo = checkpoint(pairs.select("start", "end").distinct())
    front = checkpoint(todo.select("start", F.col("start").alias("ord"), F.lit(None).cast("long").alias("before")).distinct())
    levels, ends = [front], []
    while True:
        met = checkpoint(todo.join(front.select("start", F.col("ord").alias("end")), ["start", "end"]))
        ends.append(met)
        todo = checkpoint(todo.join(met, ["start", "end"], "left_anti"))
        seen = reduce(DataFrame.unionAll, levels).select("start", F.col("ord").alias("to"))
        live = front.join(todo.select("start").distinct(), "start", "left_semi")
        nexts = live.join(way, F.col("ord") == F.col("at")).groupBy("start", "to").agg(F.min("at").alias("before")).join(seen, ["start", "to"], "left_anti")
        front = checkpoint(nexts.select("start", F.col("to").alias("ord"), "before"))
        if front.isEmpty():
            break
        levels.append(front)
    at, out = todo.where("false").select("start", "end", F.col("end").alias("ord")), []
    for k in range(len(levels) - 1, -1, -1):
        at = at.unionAll(ends[k].select("start", "end", F.col("end").alias("ord")))
        out.append(at.select("start", "end", F.lit(k).alias("pos"), "ord"))
        if k:
            at = checkpoint(at.join(levels[k], ["start", "ord"]).select("start", "end", F.col("before").alias("ord")))
    return reduce(DataFrame.unionAll, out)


def file_graph(graph: CodeGraph, file: str) -> tuple[DataFrame, DataFrame]:
    """The vertices of a file, and ``source, target, kind`` (names) of the edges with both ends in it."""
    n = graph.nodes.where(F.col("file") == file)
    a, b = n.select(F.col("ord").alias("src"), F.col("name").alias("source")), n.select(F.col("ord").alias("dst"), F.col("name").alias("target"))
    return n, graph.edges.drop("file").join(a, "src").join(b, "dst").select("source", "target", "kind")


def export_edges(graph: CodeGraph) -> DataFrame:
    """``source, target, kind`` with ids, a row per edge."""
    a, b = graph.nodes.select(F.col("ord").alias("src"), F.col("id").alias("source")), graph.nodes.select(F.col("ord").alias("dst"), F.col("id").alias("target"))
    return graph.edges.select("src", "dst", "kind").join(a, "src").join(b, "dst").select("source", "target", "kind")
