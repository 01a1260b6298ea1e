"""The tables of a code graph.

``nodes`` has a row per vertex, keyed by its insertion number ``ord``; an ``id``
may have several vertices, of which the one with the largest ``ord`` owns it.
``edges`` is a multigraph over ``ord``; parallel edges count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Node and edge kinds (fixed values).
NODE_KINDS = "function method class interface struct enum variable constant type_alias module import export constructor field section".split()
EDGE_KINDS = "calls imports extends implements uses_type references contains flows_to data_dependency".split()
VISIBILITIES = "private public protected internal".split()

NODES = (
    "ord long, id string, name string, qualified_name string, kind string, file string, line_start int, line_end int, column int, signature string, visibility string, "
    "is_async boolean, is_static boolean, is_exported boolean, docstring string, byte_start int, byte_end int, references array<string>"
)
EDGES = "eord long, src long, dst long, kind string, file string, line int"
SCHEMA_VERSION = "1"


def node_id(file: Column, qualified_name: Column, kind: Column) -> Column:
    """The 16 hex characters that name a symbol of a file."""
    return F.substring(F.md5(F.concat_ws(":", file, qualified_name, kind)), 1, 16)


def parent_dir(file: Column) -> Column:
    """The folder of a path, empty for a bare name."""
    return F.regexp_extract(F.translate(file, "\\", "/"), r"^(.*)/[^/]*$", 1)


@dataclass(frozen=True)
class CodeGraph:
    """Vertices and edges; edges may carry ``eord, file, line`` besides ``src, dst, kind``."""

    nodes: DataFrame
    edges: DataFrame

    def calls(self) -> DataFrame:
        return self.edges.where("kind = 'calls'")

    def without_files(self, files: DataFrame) -> CodeGraph:
        """The graph less the vertices of the given ``file`` rows and the edges at them."""
        gone = files.select("file").distinct()
        nodes = self.nodes.join(gone, "file", "left_anti")
        keep = nodes.select(F.col("ord").alias("k"))
        edges = self.edges.join(keep, F.col("src") == F.col("k"), "left_semi").join(keep, F.col("dst") == F.col("k"), "left_semi")
        return CodeGraph(nodes, edges)


def owners(nodes: DataFrame) -> DataFrame:
    """``id, ord``: the vertex that owns each id, the last one inserted."""
    return nodes.groupBy("id").agg(F.max("ord").alias("ord"))
