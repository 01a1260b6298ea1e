"""Finding symbols, and what stands around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.predicates import degree_role, is_entry_point
from symgraph.schema import CodeGraph


def by_id(nodes: DataFrame, symbol_id: str) -> DataFrame:
    """The vertex that owns the id, if any."""
    return nodes.where(F.col("id") == symbol_id).orderBy(F.desc("ord")).limit(1)


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def by_file(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where(F.col("file") == file)


def resolve_symbol(nodes: DataFrame, symbol: str, strict: bool = False) -> int | None:
    """The ``ord`` of the vertex with this id, else of the first with this name; ``KeyError`` if strict and there is none."""
    rank = F.when(F.col("id") == symbol, F.struct(F.lit(0).alias("p"), (-F.col("ord")).alias("k"))).otherwise(F.struct(F.lit(1).alias("p"), F.col("ord").alias("k")))
    row = nodes.where((F.col("id") == symbol) | (F.col("name") == symbol)).agg(F.min_by("ord", rank).alias("ord")).first()
    if row["ord"] is None and strict:
        raise KeyError(symbol)
    return row["ord"]


def resolve_target(nodes: DataFrame, target: str) -> tuple[str, int] | None:
    """File and line of a path (its line 1), an id or a name."""
    if not nodes.where(F.col("file") == target).isEmpty():
        return target, 1
    at = resolve_symbol(nodes, target)
    row = None if at is None else nodes.where(F.col("ord") == at).select("file", "line_start").first()
    return None if row is None else (row["file"], row["line_start"])


def resolve_file(nodes: DataFrame, path: str, root: str = "") -> str | None:
    """The stored spelling of a path: as given, with slashes, or with or without the root."""
    plain = path.replace("\\", "/")
    tries = list(dict.fromkeys([path, plain, plain.removeprefix("./"), plain.removeprefix(root.rstrip("/") + "/"), f"{root.rstrip('/')}/{plain}"]))
    known = {r["file"] for r in nodes.where(F.col("file").isin(tries)).select("file").distinct().collect()}
    return next((t for t in tries if t in known), None)


def degrees(graph: CodeGraph) -> DataFrame:
    """``ord, callers, callees`` of every vertex, parallel call edges counted."""
    ends = graph.calls().select(F.explode(F.array(F.struct(F.col("dst").alias("ord"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("ord"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    d = ends.groupBy("x.ord").agg(F.sum("x.i").alias("callers"), F.sum("x.o").alias("callees"))
    return graph.nodes.select("ord").join(d, "ord", "left").fillna(0, ["callers", "callees"])


def entry(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("is_entry_point", is_entry_point(F.col("name"), F.col("kind"), F.col("file")))


def detail(graph: CodeGraph, centrality: DataFrame | None = None) -> DataFrame:
    """Every vertex with ``centrality, callers, callees, is_entry_point, role``."""
    out = entry(graph.nodes).join(degrees(graph), "ord")
    out = out.join(centrality.select("ord", F.col("score").alias("centrality")), "ord", "left").fillna(0.0, ["centrality"]) if centrality is not None else out.withColumn("centrality", F.lit(0.0))
    return out.withColumn("role", degree_role(F.col("is_entry_point"), F.col("callers"), F.col("callees")))


def callers(graph: CodeGraph, of: DataFrame) -> DataFrame:
    """``of_ord`` and the calling vertices' columns, one row per parallel edge. ``of`` has ``ord``."""
    at = graph.calls().join(of.select(F.col("ord").alias("of_ord")), F.col("dst") == F.col("of_ord"))
    return at.select("of_ord", "src").join(graph.nodes, F.col("src") == F.col("ord")).drop("src")


def callees(graph: CodeGraph, of: DataFrame) -> DataFrame:
    at = graph.calls().join(of.select(F.col("ord").alias("of_ord")), F.col("src") == F.col("of_ord"))
    return at.select("of_ord", "dst").join(graph.nodes, F.col("dst") == F.col("ord")).drop("dst")


def batch_query(graph: CodeGraph, symbols: DataFrame) -> DataFrame:
    """``pos, symbol, ord`` for a list of ``pos, symbol``: the id's owner, else the first vertex of the name; unknown ones are left out."""
    n = graph.nodes
    ids = symbols.join(n.select("id", "ord"), F.col("symbol") == F.col("id")).groupBy("pos", "symbol").agg(F.max("ord").alias("a"))
    names = symbols.join(n.select("name", "ord"), F.col("symbol") == F.col("name")).groupBy("pos", "symbol").agg(F.min("ord").alias("b"))
    return ids.join(names, ["pos", "symbol"], "full").select("pos", "symbol", F.coalesce("a", "b").alias("ord"))


def first_neighbours(graph: CodeGraph, of: DataFrame, most: int = 5) -> DataFrame:
    """``ord, callers, callees``: the names of the first callers and callees of each vertex in ``of``, at most ``most``, in insertion order."""
    def names(rows: DataFrame, what: str) -> DataFrame:
        w = Window.partitionBy("of_ord").orderBy("ord", "name")
        top = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
        return top.groupBy("of_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ",").alias(what))

    out = of.select("ord").join(names(callers(graph, of), "callers").withColumnRenamed("of_ord", "ord"), "ord", "left")
    return out.join(names(callees(graph, of), "callees").withColumnRenamed("of_ord", "ord"), "ord", "left").fillna("", ["callers", "callees"])


def largest_in_file(nodes: DataFrame) -> DataFrame:
    """``file, ord``: the vertex with most lines in each file; of equals the last one."""
    return nodes.groupBy("file").agg(F.max_by("ord", F.struct(F.col("line_end") - F.col("line_start"), F.col("ord"))).alias("ord"))


def enclosing_symbol(nodes: DataFrame, sites: DataFrame, file_id: Column | None = None) -> DataFrame:
    """``site, symbol``: per call site (``site, file, line``) the smallest symbol of the file around the line, else ``<file>:__file__``.

    A range join of lines, each once, with symbols cut at blocks of 64 lines, of
    which the best one with the same part of a block is kept. So however many
    symbols and sites a file has, a block is 64 lines and 2,080 parts at most.
    """
    size = 64
    n = nodes.where("id IS NOT NULL").select("ord", "id", "file", F.col("line_start").cast("long").alias("a"), F.col("line_end").cast("long").alias("b"))
    n = n.where("a <= b").withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.col("b") / size))))
    parts = n.select("file", "block", F.greatest("a", F.col("block") * size).alias("first"), F.least("b", F.col("block") * size + (size - 1)).alias("last"), F.struct((F.col("b") - F.col("a")).alias("lines"), "ord", "id").alias("best"))
    parts = parts.groupBy("file", "block", "first", "last").agg(F.min("best").alias("best"))
    lines = sites.select("file", "line").distinct().withColumn("block", F.floor(F.col("line") / size))
    met = lines.join(parts, ["file", "block"]).where("line BETWEEN first AND last").groupBy("file", "line").agg(F.min("best")["id"].alias("id"))
    return sites.join(met, ["file", "line"], "left").select("site", F.coalesce("id", F.concat("file", F.lit(":__file__")) if file_id is None else file_id).alias("symbol"))
