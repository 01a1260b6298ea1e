"""Counts and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.predicates import is_callback, is_component, is_entry_point, is_event_handler, is_injected, is_widget
from symgraph.schema import CodeGraph, parent_dir


def graph_stats(graph: CodeGraph) -> DataFrame:
    """One row ``nodes, files, edges``."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file").alias("files"))
    return n.join(graph.edges.agg(F.count(F.lit(1)).alias("edges")), how="cross")  # one row each


def extension(file="file"):
    return F.lower(F.regexp_extract(file, r"\.([^./\\]+)$", 1))


def files_by_extension(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(extension().alias("ext")).agg(F.countDistinct("file").alias("files"))


def module_sizes(nodes: DataFrame) -> DataFrame:
    """``dir, files, symbols`` of every folder."""
    return nodes.groupBy(parent_dir(F.col("file")).alias("dir")).agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("symbols"))


def entry_points(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_entry_point(F.col("name"), F.col("kind"), F.col("file")))


def heuristics(nodes: DataFrame) -> DataFrame:
    """One row of flags per vertex."""
    name, kind, file = F.col("name"), F.col("kind"), F.col("file")
    flags = {"widget": is_widget(name, kind), "component": is_component(name, kind, file), "event_handler": is_event_handler(name, kind), "callback": is_callback(name), "injected": is_injected(name), "entry_point": is_entry_point(name, kind, file)}
    return nodes.select("ord", *[c.alias(n) for n, c in flags.items()])


def uncertain_edges(nodes: DataFrame) -> DataFrame:
    """``source, target, kind, confidence`` that names suggest, up to three per vertex."""
    name, kind = F.col("name"), F.col("kind")
    edge = lambda cond, source, what, conf: F.when(cond, F.struct(F.lit(source).alias("source"), F.col("id").alias("target"), F.lit(what).alias("kind"), F.lit(conf).alias("confidence")))
    every = F.array(edge(is_event_handler(name, kind), "event_source", "event_handler", 0.7), edge(is_callback(name), "caller", "callback", 0.6), edge(is_widget(name, kind), "parent_widget", "widget_tree", 0.8))
    return nodes.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("e")).select("e.*")


def limitations(nodes: DataFrame) -> DataFrame:
    """One row ``callbacks, handlers, widgets, warnings``: what an analysis of the code by names may miss."""
    f = heuristics(nodes)
    c = f.agg(F.count_if("callback").alias("callbacks"), F.count_if("event_handler").alias("handlers"), F.count_if("widget").alias("widgets"))
    warn = F.array(F.when(F.col("callbacks") > 5, "callbacks"), F.when(F.col("handlers") > 3, "event_handlers"), F.when(F.col("widgets") > 0, "widget_tree"))
    return c.withColumn("warnings", F.array_join(F.filter(warn, lambda x: x.isNotNull()), ","))


def onboarding(graph: CodeGraph, scores: DataFrame, entries: int = 15, spots: int = 20) -> dict:
    """Counts, extensions, the first entry points by name and the most central symbols."""
    s = graph_stats(graph).first()
    e = entry_points(graph.nodes).orderBy("name", "ord").limit(entries).select("name", "file").collect()
    h = graph.nodes.join(scores, "ord").orderBy(F.desc("score"), "ord").limit(spots).select("name", "file", "score").collect()
    x = files_by_extension(graph.nodes).orderBy(F.desc("files"), "ext").limit(5).collect()
    return {**s.asDict(), "extensions": [r["ext"] for r in x], "entry_points": [r.asDict() for r in e], "hotspots": [r.asDict() for r in h]}


def envelope(rows: DataFrame, tool: str, version: str = "1", offset: int | None = None) -> DataFrame:
    """A DataFrame of one JSON document a row, as answers to tools are sent."""
    body = F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(tool).alias("tool"), F.lit(version).alias("version"), F.struct(*rows.columns).alias("data"), F.struct(F.lit(offset).cast("long").alias("next")).alias("meta")))
    return rows.select(body.alias("json"))


def name_sample(nodes: DataFrame, first: int = 100, each: int = 3) -> DataFrame:
    """Of the first vertices, up to three of each kind of name."""
    from pyspark.sql.window import Window

    n = nodes.orderBy("ord").limit(first)
    f = heuristics(n).select("ord", F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("widget", "component", "event_handler", "callback", "injected")]), lambda x: x.isNotNull())).alias("class"))
    return f.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("ord"))).where(F.col("k") <= each).select("class", "ord")
