"""Source trees, snapshots of graphs, caches and change lists as DataFrames.

The folder of a library's own state inside a project is a parameter
(``state_dir``). Formats are Spark's: Parquet for snapshots, JSON and CSV for
exports; every other source or sink of Spark works as well.
"""

from __future__ import annotations

import fnmatch
import json
import os
import subprocess
import warnings
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.predicates import is_generated_change, is_generated_tool_change
from symgraph.operators.build import build_graph
from symgraph.schema import NODES, SCHEMA_VERSION, CodeGraph

#: Extensions with a grammar, and those that only the line scanner reads (fixed values).
GRAMMARS = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mts": "typescript", "cts": "typescript", "mjs": "typescript", "cjs": "typescript", "py": "python", "pyi": "python", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "cs": "csharp", "dart": "dart"}
FALLBACKS = {"kt": "kotlin", "kts": "kotlin", "swift": "swift", "rb": "ruby", "php": "php", "phtml": "php", "sh": "shell", "bash": "shell", "zsh": "shell", "md": "markdown", "markdown": "markdown"}
#: What marks the root of a project (fixed values).
ROOT_MARKERS = [".git", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "pubspec.yaml"]


def language(ext):
    """The language of an extension in any letter case, null if it is not supported."""
    e = F.lower(ext)
    return F.create_map(*[F.lit(x) for kv in {**GRAMMARS, **FALLBACKS}.items() for x in kv])[e]


def is_supported(ext):
    return F.lower(ext).isin([*GRAMMARS, *FALLBACKS])


def project_root(path: str, state_dir: str = ".symgraph") -> str:
    """The nearest folder upwards with a marker of a project; the path itself if there is none."""
    at = Path(path).resolve()
    for p in [at, *at.parents]:
        if any((p / m).exists() for m in [state_dir, *ROOT_MARKERS]):
            return str(p)
    return str(at)


def _ignored(root: Path, rel: str, rules: list[tuple[str, list[str]]]) -> bool:
    out = False
    for base, lines in rules:
        if base and not rel.startswith(base + "/"):
            continue
        name = rel[len(base) + 1 :] if base else rel
        for line in lines:
            keep, pattern = line.startswith("!"), line.lstrip("!")
            anchored, pattern = "/" in pattern.rstrip("/"), pattern.strip("/")
            parts = name.split("/")
            tries = ["/".join(parts[: i + 1]) for i in range(len(parts))] if anchored else parts
            if any(fnmatch.fnmatch(t, pattern) for t in tries):
                out = not keep
    return out


def list_files(root: str, follow_symlinks: bool = False, exclude: list[str] | None = None) -> list[tuple[str, int]]:
    """Path below the root and mtime in seconds of the supported files: nothing hidden, nothing that ``.gitignore`` or ``exclude`` names."""
    top, out, rules = Path(root), [], [("", list(exclude or []))]
    for folder, folders, files in os.walk(top, followlinks=follow_symlinks):
        base = os.path.relpath(folder, top).replace(os.sep, "/")
        base = "" if base == "." else base
        if ".gitignore" in files:
            rules.append((base, [x for x in (Path(folder) / ".gitignore").read_text(errors="replace").splitlines() if x.strip() and not x.startswith("#")]))
        place = lambda x: f"{base}/{x}" if base else x  # noqa: B023, E731
        folders[:] = sorted(x for x in folders if not x.startswith(".") and not _ignored(top, place(x), rules) and (follow_symlinks or not os.path.islink(os.path.join(folder, x))))
        for x in sorted(files):
            full, ext = os.path.join(folder, x), x.rpartition(".")[2].lower() if "." in x else ""
            if x.startswith(".") or ext not in {**GRAMMARS, **FALLBACKS} or _ignored(top, place(x), rules) or (os.path.islink(full) and not follow_symlinks):
                continue
            out.append((place(x), int(os.stat(full).st_mtime)))
    return out


def scan_files(spark: SparkSession, root: str, follow_symlinks: bool = False, exclude: list[str] | None = None) -> DataFrame:
    """``path, ext, text, mtime`` of a source tree; the walk is on the driver, the files are read by the executors."""
    found = list_files(root, follow_symlinks, exclude)
    known = spark.createDataFrame(found, "path string, mtime long")
    if not found:
        return known.select("path", F.lit("").alias("ext"), F.lit("").alias("text"), "mtime")
    read = spark.read.format("binaryFile").load([os.path.join(root, p) for p, _ in found]) if len(found) <= 1000 else spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = Path(root).resolve().as_posix().rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + top.replace(".", r"\."), "")
    text = read.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return known.join(text, "path").select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "text", "mtime")


# ------------------------------------------------------------- cache of extracted files


def split_cached(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (``file, mtime``) whose rows can be reused, their mtime being that of the cache, and those to read again."""
    c = cached.select("file", F.col("mtime").alias("cached"))
    both = files.join(c, "file", "left")
    same = F.coalesce(F.col("cached") == F.col("mtime"), F.lit(False))
    return both.where(same).drop("cached"), both.where(~same).drop("cached")


def deleted_files(cached: DataFrame, files: DataFrame) -> DataFrame:
    return cached.join(files.select("file"), "file", "left_anti").select("file")


class Store:
    """Nodes by file and the files' mtimes below a folder, in Parquet; another schema version empties it.

    Files fall into buckets by their hash. A put or remove writes the buckets of
    its files anew, as a new version beside the others, and then replaces the
    list of which version each bucket has, in one step.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._read("version") != SCHEMA_VERSION:
            self.clear()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _read(self, name: str) -> str | None:
        p = f"{self.folder}/{name}"
        return "".join(r[0] for r in self.spark.read.text(p).collect()) if self._fs.exists(self._path(name)) else None

    def _write(self, name: str, text: str) -> None:
        """A small file, written beside and moved over the old one."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        out = self._fs.create(self._path(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._path(f"{name}.new"), self._path(name), how)

    def clear(self) -> None:
        self._fs.delete(self._path(""), True)
        self._write("version", SCHEMA_VERSION)

    def _versions(self) -> dict[str, int]:
        return json.loads(self._read("current") or "{}")

    def _table(self, name: str, schema: str) -> DataFrame:
        at = [f"v{v}/{name}/bucket={b}" for b, v in sorted(self._versions().items())]
        there = [f"{self.folder}/{p}" for p in at if self._fs.exists(self._path(p))]
        return self.spark.read.option("mergeSchema", True).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        return self._table("nodes", NODES.replace(" references ", " refs ").replace(" column ", " col_no "))

    def files(self) -> DataFrame:
        return self._table("files", "file string, mtime long, n_nodes int")

    def get_mtime(self, file: str) -> int | None:
        r = self.files().where(F.col("file") == file).first()
        return r["mtime"] if r else None

    def file_nodes(self, file: str) -> DataFrame:
        return self.nodes().where(F.col("file") == file)

    def _bucket(self):
        return F.pmod(F.xxhash64("file"), F.lit(self.BUCKETS)).cast("int")

    def put(self, files: DataFrame, nodes: DataFrame) -> None:
        """Replace what is stored of the files (``file, mtime``) by their new nodes, all at once: readers see the old or the new state."""
        counts = nodes.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("n_nodes"))
        new = files.select("file", "mtime").join(counts, "file", "left").fillna(0, ["n_nodes"])
        self._replace(files.select("file"), nodes, new)

    def remove(self, files: DataFrame) -> None:
        self._replace(files.select("file"), None, None)

    def _replace(self, gone: DataFrame, nodes: DataFrame | None, files: DataFrame | None) -> None:
        touched = {r[0] for r in gone.select(self._bucket()).distinct().collect()}  # at most BUCKETS
        if not touched:
            return
        versions = self._versions()
        n = max(versions.values(), default=0) + 1
        for name, old, new in (("nodes", self.nodes(), nodes), ("files", self.files(), files)):
            rest = old.where(self._bucket().isin(list(touched))).join(gone, "file", "left_anti")
            rows = rest if new is None else rest.unionByName(new, allowMissingColumns=True)
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v{n}/{name}")
        self._write("current", json.dumps({**versions, **{str(b): n for b in touched}}))
        for b in touched:
            for name in ("nodes", "files"):
                if str(b) in versions:
                    self._fs.delete(self._path(f"v{versions[str(b)]}/{name}/bucket={b}"), True)


# ------------------------------------------------------------- snapshots and exports


def save_snapshot(graph: CodeGraph, folder: str, form: str = "parquet") -> None:
    """Nodes and edges in Parquet or JSON."""
    graph.nodes.write.mode("overwrite").format(form).save(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").format(form).save(f"{folder}/edges")


def load_snapshot(spark: SparkSession, folder: str, form: str = "parquet", schemas: tuple | None = None) -> CodeGraph:
    read = lambda name, i: (spark.read.schema(schemas[i]) if schemas else spark.read).format(form).load(f"{folder}/{name}")
    return CodeGraph(read("nodes", 0), read("edges", 1))


def is_stale(files: DataFrame, snapshot_mtime: int) -> bool:
    """Whether a supported file (``path, mtime``) is newer than the snapshot; deletions alone are not seen."""
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return not files.where(is_supported(ext) & (F.col("mtime") > snapshot_mtime)).isEmpty()


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_or_build(spark: SparkSession, folders: list[tuple[str, str]], build: Callable[[], CodeGraph], files: DataFrame | None = None, written: int = 0, store: Store | None = None, kept_fresh: bool = False) -> tuple[CodeGraph, str]:
    """The graph, and which rung of the ladder gave it.

    First the snapshots of ``(folder, format)``, unless a file of ``files`` is
    newer than ``written`` (seconds) and nobody keeps them fresh. A missing
    snapshot is passed over, as is one that cannot be read, of which a warning
    tells. If no snapshot is there at all, and nobody else may hold it, the store: its
    nodes are resolved anew. Else ``build()``. Whatever is made anew is saved
    to all the folders.
    """
    there = [(folder, form) for folder, form in folders if exists(spark, f"{folder}/nodes")]
    if kept_fresh or files is None or not is_stale(files, written):
        for folder, form in there:
            try:
                g = load_snapshot(spark, folder, form)
                g.nodes.isEmpty()
                g.edges.isEmpty()
                return g, folder
            except (PySparkException, Py4JError) as e:
                warnings.warn(f"snapshot {folder} cannot be read: {str(e)[:500]}", stacklevel=2)
    if not there and not kept_fresh and store is not None and not store.files().isEmpty():
        g, rung = build_graph(store.nodes()), "store"
    else:
        g, rung = build(), "built"
    for folder, form in folders:
        save_snapshot(g, folder, form)
    return g, rung


def export_json(graph: CodeGraph, folder: str) -> None:
    """``nodes`` and ``edges`` as JSON lines, and one row of statistics."""
    save_snapshot(graph, folder, "json")
    n = graph.nodes.agg(F.lit(SCHEMA_VERSION).alias("version"), F.count(F.lit(1)).alias("nodes"), F.countDistinct("file").alias("files"))
    n.join(graph.edges.agg(F.count(F.lit(1)).alias("edges")), how="cross").coalesce(1).write.mode("overwrite").json(f"{folder}/stats")


def write_audit_csv(named_paths: DataFrame, folder: str) -> None:
    named_paths.select("severity", "entry_point", "entry_file", "path_length", "trace").write.mode("overwrite").option("header", True).csv(folder)


# ------------------------------------------------------------- change lists


def parse_name_status(text: str, keep_deleted: bool = False) -> list[str]:
    """Paths of ``git diff --name-status``; of a rename the new one."""
    out = []
    for line in text.splitlines():
        parts = line.split("\t")
        if len(parts) >= 2 and (keep_deleted or not parts[0].startswith("D")):
            out.append(parts[2] if parts[0][:1] in "RC" and len(parts) > 2 else parts[1])
    return out


def parse_numstat(text: str, only_counted: bool = False) -> set[str]:
    """Paths of ``git diff --numstat`` with a change left once whitespace is ignored."""
    out = set()
    for line in text.splitlines():
        parts = line.split("\t")
        if len(parts) < 3:
            continue
        path = parts[2]
        if " => " in path:
            head, _, rest = path.partition("{")
            if rest:
                middle, _, tail = rest.partition("}")
                path = (head + middle.split(" => ")[1] + tail).replace("//", "/")
            else:
                path = path.split(" => ")[1]
        if not only_counted or parts[0] not in ("0", "-") or parts[1] not in ("0", "-"):
            out.add(path)
    return out


def changed_files(spark: SparkSession, root: str, base: str | None = None, head: str | None = None, tool: bool = False, state_dir: str = ".symgraph") -> DataFrame:
    """``file`` of the files that differ from the last commit, or between two commits; generated ones are left out.

    Changes of whitespace alone do not count. Untracked files do. ``tool``
    keeps deletions and demands a repository.
    """
    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=tool).stdout

    if tool and not (Path(root) / ".git").exists():
        raise ValueError(f"{root} is no repository")
    span = [f"{base}..{head or 'HEAD'}"] if base else ["HEAD"]
    names = parse_name_status(git("diff", "--name-status", "-M", "-w", *span), keep_deleted=tool)
    if not (tool and base):
        counted = parse_numstat(git("diff", "--numstat", "-M", "-w", *span), only_counted=True)
        names = [n for n in names if n in counted]
    if not base:
        names += git("ls-files", "--others", "--exclude-standard").splitlines()
    df = spark.createDataFrame([(n,) for n in sorted(set(names))], "file string")
    return df.where(~(is_generated_tool_change if tool else is_generated_change)(F.col("file"), state_dir))


def write_json(path: str, value: dict) -> None:
    """A small document, written beside and moved into place."""
    tmp = f"{path}.tmp"
    Path(tmp).write_text(json.dumps(value))
    os.replace(tmp, path)
