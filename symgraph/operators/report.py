"""Answers put together for people and tools: symbols with their surroundings, briefs, summaries of changes, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from symgraph.functions.predicates import compress_path, is_entry_point, short_signature
from symgraph.operators import lookup, stats
from symgraph.operators.budget import fold_in_order, map_capped, map_scores
from symgraph.operators.impact import impact, impact_counts
from symgraph.schema import SCHEMA_VERSION, CodeGraph, parent_dir
from symgraph.sources.files import FALLBACKS, GRAMMARS

#: Symbols that a text map shows by kind and lines instead of a signature.
_WHOLE = ("class", "interface", "struct")


def _gathered(rows: DataFrame, what: Column, name: str) -> DataFrame:
    """``ord`` and an array of ``what`` over the rows of each ``of_ord``, in the order of ``ord``; parallel edges stand apart."""
    got = rows.groupBy("of_ord").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), what.alias("x")))).alias("a"))
    return got.select(F.col("of_ord").alias("ord"), F.transform("a", lambda r: r["x"]).alias(name))


def neighbour_ids(graph: CodeGraph, of: DataFrame) -> DataFrame:
    """``ord, id, name, qualified_name, kind, file, line_start, line_end, signature, called_by, calls`` of each ``ord``; the last two are arrays of ids."""
    n = graph.nodes.join(of.select("ord"), "ord").select("ord", "id", "name", "qualified_name", "kind", "file", "line_start", "line_end", "signature")
    out = n.join(_gathered(lookup.callers(graph, of), F.col("id"), "called_by"), "ord", "left").join(_gathered(lookup.callees(graph, of), F.col("id"), "calls"), "ord", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"called_by": F.coalesce("called_by", none), "calls": F.coalesce("calls", none)})


def batch_detail(graph: CodeGraph, symbols: DataFrame, centrality: DataFrame, callers: bool = False, callees: bool = False) -> DataFrame:
    """:func:`lookup.batch_query` with what is known of each symbol, and on demand arrays ``callers`` and ``callees`` of ``id, name, kind, file``."""
    hits = lookup.batch_query(graph, symbols)
    n = graph.nodes.select("ord", "id", "name", "kind", "file", "line_start", "line_end")
    out = hits.join(n, "ord").join(centrality.select("ord", F.col("score").alias("centrality")), "ord", "left").fillna(0.0, ["centrality"])
    of, who = hits.select("ord").distinct(), F.struct("id", "name", "kind", "file")
    for wanted, near, name in ((callers, lookup.callers, "callers"), (callees, lookup.callees, "callees")):
        if wanted:
            out = out.join(_gathered(near(graph, of), who, name), "ord", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<id:string,name:string,kind:string,file:string>>")))
    return out


def briefs(graph: CodeGraph, centrality: DataFrame, of: DataFrame, title: str = "Architectural brief") -> DataFrame:
    """``ord, brief``: a page of Markdown on each ``ord`` with its callees and callers, the most central first."""
    c = centrality.select("ord", F.col("score").alias("c"))
    nodes = graph.nodes.join(c, "ord", "left").fillna(0.0, ["c"])
    with_scores = CodeGraph(nodes, graph.edges)

    def listed(rows: DataFrame, name: str) -> DataFrame:
        line = F.concat(F.lit("| `"), "name", F.lit("` | "), "kind", F.lit(" | "), F.format_number("c", 2), F.lit(" | `"), "file", F.lit("` |"))
        got = rows.groupBy("of_ord").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("a"), F.col("ord").alias("b"), line.alias("line")))).alias("x"))
        return got.select(F.col("of_ord").alias("ord"), F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias(name))

    n = nodes.join(of.select("ord"), "ord").join(listed(lookup.callees(with_scores, of), "down"), "ord", "left").join(listed(lookup.callers(with_scores, of), "up"), "ord", "left")
    head = "\n\n| Symbol | Kind | Centrality | File |\n| --- | --- | --- | --- |\n"
    part = lambda name, column, none: F.concat(F.lit(f"\n## {name}"), F.coalesce(F.concat(F.lit(head), F.col(column)), F.lit(f"\n\n{none}")), F.lit("\n"))
    text = F.concat(
        F.lit(f"# {title}: `"), "name", F.lit("`\n\n- kind: "), "kind", F.lit("\n- file: `"), "file", F.lit("`\n- centrality: "), F.format_number("c", 2), F.coalesce(F.concat(F.lit("\n- signature: `"), "signature", F.lit("`")), F.lit("")), F.lit("\n"),
        part("Calls", "down", "none: it is a leaf"), part("Called by", "up", "none: an entry point, or unused"),
    )
    return n.select("ord", text.alias("brief"))


def pr_summary(graph: CodeGraph, symbols: DataFrame, max_depth: int = 3, most: int = 5) -> DataFrame:
    """``pos, symbol, name, file, role, confidence, total, callers`` of changed symbols (``pos, symbol``); an unknown one has only the first two.

    ``callers`` are the names of the first few upstream, by severity, steps and id.
    """
    hits = lookup.batch_query(graph, symbols)
    seeds = hits.select("ord").distinct()
    affected = impact(graph, seeds, max_depth)
    up = affected.where("direction = 'up'").join(graph.nodes.select("ord", "id", "name"), "ord")
    first = up.groupBy(F.col("seed").alias("ord")).agg(F.slice(F.array_sort(F.collect_list(F.struct("severity_rank", "hop", "id", "name"))), 1, most).alias("x"))
    counts = impact_counts(graph, seeds, affected).join(first, "ord", "left")
    known = hits.join(counts, "ord").join(graph.nodes.select("ord", "name", "file"), "ord")
    known = known.select("pos", "name", "file", "role", "confidence", "total", F.array_join(F.transform(F.coalesce("x", F.expr("array()")), lambda r: r["name"]), ",").alias("callers"))
    return symbols.select("pos", "symbol").join(known, "pos", "left")


def graph_info(graph: CodeGraph) -> DataFrame:
    """One row ``nodes, edges, languages, version``; ``languages`` are those that can be read."""
    s = stats.graph_stats(graph).select("nodes", "edges")
    return s.withColumns({"languages": F.array(*[F.lit(x) for x in sorted({*GRAMMARS.values(), *FALLBACKS.values()})]), "version": F.lit(SCHEMA_VERSION)})


def overview(graph: CodeGraph, centrality: DataFrame, spots: int = 20, entries: int = 10) -> DataFrame:
    """``section, pos, name, kind, file, value``: totals, the most central symbols, the first entry points and the folders with their symbols, in one table."""
    none = F.lit(None).cast("string")
    s = stats.graph_stats(graph)
    modules = stats.module_sizes(graph.nodes).where("dir <> ''")
    total = lambda name, rows, value: rows.select(F.lit("total").alias("section"), F.lit(0).alias("pos"), F.lit(name).alias("name"), none.alias("kind"), none.alias("file"), value.cast("double").alias("value"))
    hot = graph.nodes.join(centrality.select("ord", "score"), "ord", "left").fillna(0.0, ["score"]).orderBy(F.desc("score"), "ord").limit(spots)
    entry = stats.entry_points(graph.nodes).orderBy("ord").limit(entries)

    def numbered(rows: DataFrame, section: str, order: Column, value: Column) -> DataFrame:
        # of a few rows
        got = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "ord", "name", "kind", "file", value.cast("double").alias("v")))).alias("a"))
        return got.select(F.posexplode("a").alias("pos", "r")).select(F.lit(section).alias("section"), "pos", "r.name", "r.kind", "r.file", F.col("r.v").alias("value"))

    folders = modules.select(F.lit("module").alias("section"), F.lit(0).alias("pos"), F.col("dir").alias("name"), none.alias("kind"), none.alias("file"), F.col("symbols").cast("double").alias("value"))
    out = total("nodes", s, F.col("nodes")).unionAll(total("edges", s, F.col("edges"))).unionAll(total("modules", modules.agg(F.count(F.lit(1)).alias("n")), F.col("n")))
    return out.unionAll(numbered(hot, "hotspot", -F.col("score"), F.col("score"))).unionAll(numbered(entry, "entry_point", F.lit(0), F.lit(None))).unionAll(folders)


def map_lines(nodes: DataFrame, centrality: DataFrame, tokens: int = 1024, root: str = "", focus: list[str] | None = None, exclude_tests: bool = True) -> list[str]:
    """A map as lines of text within four characters a token: a header a file, a line a symbol, a blank line after a file.

    Unlike the map in JSON it counts what is printed, in bytes with line ends,
    and ends at the first line that no longer fits; the first file and symbol
    are always shown. The last line then says how much was left out.
    """
    scored = map_scores(nodes, centrality, focus, exclude_tests)
    rows = map_capped(scored, tokens).withColumns({"short": F.coalesce(short_signature("signature"), F.col("name")), "minus": -F.col("best")})
    star = F.when(is_entry_point(F.col("name"), F.col("kind"), F.col("file")), F.lit(" ★")).otherwise(F.lit(""))
    whole = F.concat(F.lit("  "), "kind", F.lit(" "), "name", F.lit(" [L"), "line_start", F.lit("-"), "line_end", F.lit("]"))
    line = F.concat(F.when(F.col("kind").isin(*_WHOLE), whole).otherwise(F.concat(F.lit("    "), "short", F.lit("  L"), "line_start")), star)
    rows = rows.select("minus", "best_ord", "rank", "file", F.concat(compress_path(F.col("file"), root), F.lit(":")).alias("header"), line.alias("line"))
    budget, used, shown, out, files, hit = 4 * tokens, 0, 0, [], [], False

    def take(r: Row) -> bool:
        nonlocal used, shown, hit
        if hit:
            return False
        if not files or files[-1] != r["file"]:
            used += bool(files)  # the blank line after a file
            cost = len(r["header"].encode()) + 1
            if files and used + cost > budget:
                hit = True
                return False
            if files:
                out.append("")
            files.append(r["file"])
            out.append(r["header"])
            used += cost
        cost = len(r["line"].encode()) + 1
        if shown and used + cost > budget:
            left, totals = scored.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("f")).first(), shown
            out.append(f"... {left['n'] - totals} more symbols in {left['f'] - len(files)} more files; twice the tokens: {2 * tokens}")
            hit = True
            return False
        out.append(r["line"])
        used += cost
        shown += 1
        return True

    fold_in_order(rows, ["minus", "best_ord", "rank"], take, lambda: None if hit else F.lit(True), 500)
    return [f"# map: {shown} symbols, {len(files)} files, {tokens} tokens", "", *out]
