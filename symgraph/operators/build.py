"""From extracted rows to a graph: numbering, symbol and import tables, and the resolution of references.

The only join of the build that is not by equality, a reference that is the end
of a qualified name, is made one by listing each name's ends once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.operators.order import row_numbers
from symgraph.schema import CodeGraph, parent_dir
from symgraph.session import checkpoint


def assign_ord(raw: DataFrame, file_order: str = "file", place: str = "pos") -> DataFrame:
    """``ord`` 1, 2, ... by file and place in it, also where one file has most rows."""
    return row_numbers(raw, [file_order, place], "ord")


def entities(nodes: DataFrame) -> DataFrame:
    """Imports feed the import tables and are no vertices."""
    return nodes.where("kind <> 'import'")


def import_bindings(nodes: DataFrame) -> DataFrame:
    """``file, local_name, module, is_namespace, ord`` of every binding of an import."""
    i = nodes.where("kind = 'import'").select("file", F.explode("refs").alias("ref"), F.col("name").alias("module"), "ord")
    return i.select("file", F.regexp_replace("ref", r"^\*as:", "").alias("local_name"), "module", F.col("ref").startswith("*as:").alias("is_namespace"), "ord")


def import_map(nodes: DataFrame) -> DataFrame:
    """``file, local_name, module``: the last import of a name in a file counts; namespaces are kept apart."""
    b = import_bindings(nodes).where("NOT is_namespace")
    return b.groupBy("file", "local_name").agg(F.max_by("module", F.struct("ord", "module")).alias("module"))


def namespace_map(nodes: DataFrame) -> DataFrame:
    b = import_bindings(nodes).where("is_namespace")
    return b.groupBy("file", "local_name").agg(F.max_by("module", F.struct("ord", "module")).alias("module"))


def symbol_table(nodes: DataFrame) -> DataFrame:
    """``fqn, ord, dir``: the last vertex of each qualified name, and its folder."""
    n = entities(nodes).where("qualified_name <> ''")
    best = n.groupBy(F.col("qualified_name").alias("fqn")).agg(F.max(F.struct("ord", "file")).alias("b"))
    return best.select("fqn", "b.ord", "b.file", parent_dir(F.col("b.file")).alias("dir"))


def name_ends(symbols: DataFrame) -> DataFrame:
    """``suffix`` and the symbol, for each end of a qualified name that begins after a dot or colon."""
    ends = F.regexp_extract_all("fqn", F.lit(r"(?<=[.:])(?=(.+))"), F.lit(1))
    return symbols.select(F.explode(F.array_distinct(ends)).alias("suffix"), "fqn", "ord", "file", "dir")


def references(nodes: DataFrame) -> DataFrame:
    """``caller, caller_file, pos, ref`` of every vertex."""
    return entities(nodes).select(F.col("ord").alias("caller"), F.col("file").alias("caller_file"), F.posexplode("refs").alias("pos", "ref"))


def resolve(nodes: DataFrame) -> DataFrame:
    """``caller, pos, ref, ord, step``: what each reference means; unresolved ones are left out.

    First the exact qualified name. Else the only symbol that ends with the
    reference, or of several the only one in the caller's folder; in a file
    with imports, a plain name that is not imported must then be of the same
    file or folder. References to the caller itself give nothing.
    """
    symbols = checkpoint(symbol_table(nodes))
    refs = references(nodes)
    exact = refs.join(symbols.select(F.col("fqn").alias("ref"), "ord"), "ref", "left")
    hit = exact.where("ord IS NOT NULL").select("caller", "pos", "ref", "ord", F.lit("exact").alias("step"))
    missed = exact.where("ord IS NULL").drop("ord").withColumn("dir", parent_dir(F.col("caller_file")))
    ends = name_ends(symbols)
    # per suffix, and per suffix and folder: how many symbols, and which if it is one; so a join never multiplies rows
    alone = ends.groupBy(F.col("suffix").alias("ref")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ord", "file", "dir")).alias("one"))
    near = ends.groupBy(F.col("suffix").alias("ref"), "dir").agg(F.count(F.lit(1)).alias("near"), F.max(F.struct("ord", "file", "dir")).alias("near_one"))
    found = missed.join(alone, "ref").join(near, ["ref", "dir"], "left")
    pick = F.when(F.col("n") == 1, F.col("one")).when(F.col("near") == 1, F.col("near_one"))
    found = found.withColumn("pick", pick).where("pick IS NOT NULL")
    names = import_map(nodes)
    found = found.join(names.select(F.col("file").alias("caller_file")).distinct().withColumn("imports", F.lit(True)), "caller_file", "left")
    found = found.join(names.select(F.col("file").alias("caller_file"), F.col("local_name").alias("ref"), F.lit(True).alias("imported")), ["caller_file", "ref"], "left")
    local = (F.col("pick.file") == F.col("caller_file")) | (F.col("pick.dir") == F.col("dir"))
    allowed = F.col("imports").isNull() | F.contains("ref", F.lit(".")) | F.col("imported").isNotNull() | local
    suffix = found.where(allowed).select("caller", "pos", "ref", F.col("pick.ord").alias("ord"), F.lit("suffix").alias("step"))
    return hit.unionAll(suffix).where("ord <> caller")


def build_graph(nodes: DataFrame, with_edges: bool = True) -> CodeGraph:
    """Vertices and resolved ``calls`` edges, in the order of caller and reference."""
    vertices = entities(nodes)
    if not with_edges:
        return CodeGraph(vertices, nodes.sparkSession.createDataFrame([], "eord long, src long, dst long, kind string, file string, line int"))
    e = row_numbers(resolve(nodes), ["caller", "pos"], "eord").select("eord", F.col("caller").alias("src"), F.col("ord").alias("dst"), F.lit("calls").alias("kind"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    return CodeGraph(vertices, e)


def resolve_names(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Live resolution of ``from_id, to_name, kind``: the target is the first vertex with exactly this name; itself is allowed."""
    first = nodes.groupBy(F.col("name").alias("to_name")).agg(F.min("ord").alias("dst"))
    own = nodes.groupBy(F.col("id").alias("from_id")).agg(F.max("ord").alias("src"))
    return relations.join(first, "to_name").join(own, "from_id").select("src", "dst", "kind")


def reindex_changed(nodes: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes of unchanged files and the fresh rows of the changed ones; edges are resolved anew from them."""
    return nodes.join(changed.select("file").distinct(), "file", "left_anti").unionByName(fresh)

