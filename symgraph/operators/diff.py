"""What a set of changed files touches, and whether that is too much."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.predicates import change_class, review_level, risk_level, slashes
from symgraph.operators.traverse import steps
from symgraph.schema import CodeGraph
from symgraph.session import checkpoint, partitions


def path_ends(file: Column) -> Column:
    """Every end of a path, wherever it begins, and the path itself."""
    p = slashes(file)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1))), lambda i: F.substring(p, i, F.length(p)))


def matching_files(files: DataFrame, changed: DataFrame, root: str = "") -> DataFrame:
    """``file`` of those ``files`` that end with a changed path, or equal it below ``root``.

    A bare end counts: ``x.rs`` matches ``ax.rs``. Each path lists its ends once,
    which makes it a join by equality.
    """
    wanted = changed.select(slashes(F.col("file")).alias("wanted")).where("wanted <> ''").distinct()
    if root:
        wanted = wanted.unionAll(wanted.select(F.concat(F.lit(root.rstrip("/") + "/"), "wanted"))).distinct()
    ends = files.select("file").distinct().withColumn("end", F.explode(path_ends(F.col("file"))))
    return ends.join(wanted, F.col("end") == F.col("wanted"), "left_semi").select("file").distinct()


def changed_nodes(nodes: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """The vertices whose path ends with a changed path (``file``), or equals it below ``root``."""
    return nodes.join(matching_files(nodes, files, root), "file", "left_semi")


def entry_ords(graph: CodeGraph) -> DataFrame:
    """``ord`` of the vertices that nothing but themselves points to, by edges of any kind."""
    return graph.nodes.select("ord").join(graph.edges.where("src <> dst").select(F.col("dst").alias("ord")), "ord", "left_anti")


def reached(edges: DataFrame, sources: DataFrame, direction: str, depth: int, most: int) -> DataFrame:
    """``ord, source``: of each vertex the sources it is reached from within ``depth`` steps, itself among them; ``most`` of them where there are more.

    A vertex has all its sources if they are fewer than ``most``, and exactly
    ``most`` otherwise: if those of a neighbour were cut there are enough, and if
    none were the union is whole. So a row's number grows with the vertices,
    not with sources x vertices.
    """
    way = checkpoint(steps(edges, direction).select("at", "to").distinct().repartition(partitions(edges.sparkSession), "at"))
    all_ = new = checkpoint(sources.select("ord", F.col("ord").alias("source")).distinct())
    for _ in range(depth):
        moved = new.withColumnRenamed("ord", "at").join(way, "at").select(F.col("to").alias("ord"), "source", F.lit(1).alias("fresh"))
        both = all_.withColumn("fresh", F.lit(0)).unionAll(moved).groupBy("ord", "source").agg(F.min("fresh").alias("fresh"))
        # those known before come first, so what was handed on stays
        kept = both.withColumn("k", F.row_number().over(Window.partitionBy("ord").orderBy("fresh", "source"))).where(F.col("k") <= most).drop("k")
        kept = checkpoint(kept)
        new = kept.where("fresh = 1").drop("fresh")
        if new.isEmpty():
            break
        all_ = kept.drop("fresh")
    return all_


class BlastRadius:
    """What all changed vertices touch together, and what follows from it."""

    def __init__(self, graph: CodeGraph, changed: DataFrame, max_depth: int = 5, files: DataFrame | None = None):
        """``files`` has the changed paths (``file``), as far as they are known beyond the changed vertices."""
        self.graph, self.changed = graph, checkpoint(changed.select("ord", "id", "name", "file"))
        self.files = (files.select("file") if files is not None else self.changed.select("file")).distinct()
        c = self.changed.select("ord")
        ends = graph.edges.select("src", "dst").where("src <> dst").distinct()
        #: ``ord, changed``: the direct callers of each changed vertex
        self.near = checkpoint(ends.join(c.withColumnRenamed("ord", "dst"), "dst", "left_semi").select(F.col("src").alias("ord"), F.col("dst").alias("changed")) if max_depth else c.select("ord", F.col("ord").alias("changed")).where("false"))
        counts = self.near.groupBy("ord").agg(F.count(F.lit(1)).alias("direct"))
        # a caller has indirect ones beside itself and its direct ones as soon as it has more than these
        most = (counts.agg(F.max("direct")).first()[0] or 0) + 2
        up = reached(graph.edges, c, "up", max_depth, most).where("ord <> source").groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
        self.indirect = checkpoint(up.join(counts, "ord", "left").where("n > coalesce(direct, 0)").select("ord"))
        down = reached(graph.edges, c, "down", max_depth, 2).where("ord <> source").select("ord")
        self.affected = checkpoint(up.select("ord").unionAll(down).distinct().join(graph.nodes.select("ord", "id", "name", "file"), "ord"))

    def summary(self) -> DataFrame:
        """One row: ``changed, direct_callers, indirect_callers, affected_nodes, affected_files, entrypoints, risk``. A caller may be direct of one and indirect of another."""
        one = self.affected.agg(F.countDistinct("id").alias("affected_nodes"), F.countDistinct("file").alias("affected_files"))
        ids = lambda rows, name: self.affected.join(rows.select("ord").distinct(), "ord", "left_semi").agg(F.countDistinct("id").alias(name))
        parts = [self.changed.agg(F.countDistinct("id").alias("changed")), ids(self.near, "direct_callers"), ids(self.indirect, "indirect_callers"), one, self.entrypoints().agg(F.count(F.lit(1)).alias("entrypoints"))]
        return reduce(lambda a, b: a.join(b, how="cross"), parts).withColumn("risk", risk_level(F.col("affected_nodes")))  # one row each

    def entrypoints(self) -> DataFrame:
        """``id`` of the affected vertices that have no callers."""
        return self.affected.join(entry_ords(self.graph), "ord", "left_semi").select("id").distinct()

    def files_to_update(self) -> DataFrame:
        """The affected files that match no changed path."""
        files = self.affected.select("file").distinct()
        return files.join(matching_files(files, self.files.unionAll(self.changed.select("file"))), "file", "left_anti")

    def check(self, most: int = 25) -> DataFrame:
        """The summary with ``risky``."""
        return self.summary().withColumn("risky", (F.col("affected_nodes") > most) | (F.col("entrypoints") > 0) | (F.col("indirect_callers") > most // 2))

    def diagram(self) -> str | None:
        """The first five changed vertices with up to three direct callers each, as a Mermaid graph; None if nothing is to be shown."""
        first = self.changed.orderBy("ord").limit(5)
        w = Window.partitionBy("seed").orderBy("name", "ord")
        near = self.near.join(self.affected.select("ord", "name"), "ord").withColumnRenamed("changed", "seed").withColumn("k", F.row_number().over(w)).where("k <= 3")
        rows = first.select(F.col("ord").alias("c"), F.col("name").alias("changed_name")).join(near.select("seed", "name", "k"), F.col("c") == F.col("seed"), "left").orderBy("c", "k").collect()  # 15 at most
        clean = lambda s: "".join("_" if c in ":<>()[]" else c for c in s)
        lines = list(dict.fromkeys(f"    {clean(r['name'])} --> {clean(r['changed_name'])}" for r in rows if r["name"] is not None))
        names = sorted({clean(r["changed_name"]) for r in rows})
        if not lines:
            return None
        return "\n".join(["```mermaid", "graph LR", "    classDef changed fill:#f96", *lines, *[f"    class {n} changed" for n in names], "```"])


def review(graph: CodeGraph, changed: DataFrame, details: DataFrame) -> DataFrame:
    """``ord, level`` of every changed vertex by centrality, entry point and callers (``details`` as of lookup)."""
    return changed.select("ord").join(details, "ord").select("ord", "name", review_level(F.col("centrality"), F.col("is_entry_point"), F.col("callers")).alias("level"))


def guard(blast: BlastRadius, details: DataFrame, most: int = 25, top: float = 0.4) -> DataFrame:
    """One row ``too_large, entry_changed, central_changed, verdict``."""
    d = blast.changed.select("ord").join(details, "ord").agg(F.coalesce(F.bool_or("is_entry_point"), F.lit(False)).alias("entry_changed"), F.coalesce(F.bool_or(F.col("centrality") > top), F.lit(False)).alias("central_changed"))
    s = blast.summary().select((F.col("affected_nodes") > most).alias("too_large"))
    out = s.join(d, how="cross")  # one row each
    return out.withColumn("verdict", F.when(F.col("too_large") | F.col("entry_changed") | F.col("central_changed"), "FAIL").otherwise("PASS"))


def classify_changes(files: DataFrame) -> DataFrame:
    """``class, files`` of changed paths."""
    return files.groupBy(change_class(F.col("file")).alias("class")).agg(F.count(F.lit(1)).alias("files"))


def primary_class(classes: DataFrame) -> str:
    """The first of code, test, doc and infra that occurs, else general."""
    there = {r["class"] for r in classes.collect()}  # four at most
    return next((c for c in ("code", "test", "doc", "infra") if c in there), "general")
