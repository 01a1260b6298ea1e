"""Selections under a budget of tokens or characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.predicates import compress_path, is_entry_point, is_generated_map, is_test_map, short_signature, token_estimate
from symgraph.operators.order import running_total
from symgraph.operators.traverse import bfs, steps
from symgraph.schema import CodeGraph
from symgraph.session import checkpoint

#: Rows that are looked at in one go when a budget is filled in order.
CHUNK = 10_000
#: The same for a map, of whose symbols few fit.
MAP_CHUNK = 500
#: So many vertices that most slices come to have those of their neighbours that may fit (some hundreds each) sent to all workers.
HUBS = 128


def fold_in_order(rows: DataFrame, order: list[str], take: Callable[[Row], bool], fits: Callable[[], Column | None], chunk: int = CHUNK) -> list[Row]:
    """The rows that ``take`` accepts, asked in the order of the columns ``order`` (which name each row).

    Rows come in chunks; ``fits`` gives the condition that later rows must meet
    to be of interest, or None to stop. So only rows that may still be taken
    reach the driver, a chunk at a time.
    """
    kept, last = [], None
    while True:
        cond = fits()
        if cond is None:
            return kept
        at = rows.where(cond)
        if last is not None:
            at = at.where(F.struct(*order) > F.struct(*[F.lit(last[c]).cast(rows.schema[c].dataType) for c in order]))
        got = at.orderBy(*order).limit(chunk).collect()
        kept += [r for r in got if take(r)]
        if len(got) < chunk:
            return kept
        last = got[-1]


def slice_context(graph: CodeGraph, centrality: DataFrame, target: int, max_tokens: int, max_depth: int = 2, pinned: list[int] | None = None) -> tuple[list[Row] | DataFrame, str]:
    """The neighbourhood of a vertex under a token budget, and ``complete`` or ``token_budget``.

    Candidates within ``max_depth`` steps in either direction are asked in the
    order pinned, depth, centrality, insertion; one that does not fit is skipped and later
    smaller ones may still fit; pinned ones are always taken. 0 tokens: no
    limit, and the whole neighbourhood comes as a DataFrame in that order.
    """
    spark = graph.nodes.sparkSession
    pins = set(pinned or [])
    near = bfs(graph.edges, spark.createDataFrame([(target,)], "ord long"), "both", max_depth).select("ord", F.col("hop").alias("depth")) if max_depth > 0 else spark.createDataFrame([(target, 0)], "ord long, depth int")
    n = graph.nodes.withColumn("tokens", token_estimate(*[F.col(c) for c in ("name", "qualified_name", "file", "signature", "line_start", "line_end")]))
    rows = near.join(n, "ord").join(centrality.select("ord", "score"), "ord", "left").fillna(0.0, ["score"])
    rows = rows.select((~F.col("ord").isin(list(pins) or [-1])).alias("free"), "depth", (-F.col("score")).alias("minus"), "ord", "id", "name", "tokens")
    if not max_tokens:
        return rows.orderBy("free", "depth", "minus", "ord"), "complete"
    used, skipped = 0, False

    def take(r: Row) -> bool:
        nonlocal used, skipped
        if r["free"] and used + r["tokens"] > max_tokens:
            skipped = True
            return False
        used += r["tokens"]
        return True

    def fits() -> Column:
        return ~F.col("free") | (F.col("tokens") <= max(0, max_tokens - used))

    total = rows.count()
    kept = fold_in_order(rows, ["free", "depth", "minus", "ord"], take, fits)
    return kept, "token_budget" if skipped or len(kept) < total else "complete"


def that_may_fit(rows: DataFrame, key: str, max_tokens: int) -> DataFrame:
    """``key, ord, tokens, minus``: the rows without those that no slice with all rows of their key has room for; each partition by itself.

    A slice is asked in the order of ``minus, ord``. If it takes a row, it took
    all rows of the key before it that have no more tokens. Where these
    and the row are over the budget, the row is never taken. The first such row
    stays, so that the slice's candidates are over the budget too. What stays
    of a key and a partition is bounded by the budget.
    """

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, most, before, over = None, None, max_tokens, [], False
        for b in batches:
            keep = []
            for i, (k, ord_, tokens) in enumerate(zip(*[b[c].tolist() for c in (key, "ord", "tokens")])):
                if k != now:
                    now, last, most, before, over = k, None, max_tokens, [], False
                if ord_ == last:
                    continue
                last = ord_
                if tokens <= most:
                    if sum(t for t in before if t <= tokens) + tokens <= max_tokens:
                        before.append(tokens)
                        keep.append(i)
                        continue
                    most = tokens - 1
                    before = [t for t in before if t <= most]
                if not over:
                    over = True
                    keep.append(i)
            yield b.iloc[keep]

    rows = rows.select(key, "ord", "tokens", "minus").sortWithinPartitions(key, "minus", "ord")
    return rows.mapInPandas(few, f"{key} long, ord long, tokens long, minus double")


def slice_contexts(graph: CodeGraph, centrality: DataFrame, targets: DataFrame, max_tokens: int, max_depth: int = 2) -> DataFrame:
    """``target, pos, ord, depth, tokens, reason``: :func:`slice_context` without pins for every ``ord`` of ``targets`` at once.

    The last step of a walk looks only at those neighbours of a vertex that may
    fit; the vertices that most targets come to are not joined with them, their
    neighbours are looked up where a target is filled. The candidates of a
    target stream past in order; only what is kept of it, and of its last step
    what may fit, is held, which the budget bounds.
    """
    near = targets.select(F.col("ord").alias("target"), "ord", F.lit(0).alias("depth")).distinct()
    bounded = max_tokens > 0 and max_depth > 0
    walked = max_depth - 1 if bounded else max_depth
    if walked > 0:
        near = bfs(graph.edges, targets.select("ord").distinct(), "both", walked).select(F.col("seed").alias("target"), "ord", F.col("hop").alias("depth"))
    n = graph.nodes.select("ord", token_estimate(*[F.col(c) for c in ("name", "qualified_name", "file", "signature", "line_start", "line_end")]).cast("long").alias("tokens"))
    n = n.join(centrality.select("ord", "score"), "ord", "left").fillna(0.0, ["score"]).select("ord", "tokens", (-F.col("score")).alias("minus"))
    if bounded:
        n = checkpoint(n)
        neighbours = steps(graph.edges, "both").select("at", F.col("to").alias("ord")).distinct().join(n, "ord").repartition("at")
        neighbours = checkpoint(that_may_fit(neighbours, "at", max_tokens))
        front = near.where(F.col("depth") == walked).select("target", F.col("ord").alias("at"))
        hubs = checkpoint(front.groupBy("at").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "at").limit(HUBS).select("at"))
        held = neighbours.join(F.broadcast(hubs), "at").toPandas()
        last = that_may_fit(front.join(F.broadcast(hubs), "at", "left_anti").join(neighbours, "at"), "target", max_tokens).withColumn("depth", F.lit(max_depth))
        rows = near.join(n, "ord").unionByName(last).repartition("target").groupBy("target", "ord", "tokens", "minus").agg(F.min("depth").alias("depth"))
    else:
        rows, held = near.join(n, "ord").repartition("target"), pd.DataFrame({c: [] for c in ("at", "ord", "tokens", "minus")})
    # the hubs' neighbours in order, and by hub the places of its own
    known = held.drop_duplicates("ord").sort_values(["minus", "ord"])
    known_ords, known_tokens, known_minus = (known[c].to_numpy() for c in ("ord", "tokens", "minus"))
    place = {o: i for i, o in enumerate(known_ords.tolist())}
    places = {at: np.array([place[o] for o in g.tolist()]) for at, g in held.groupby("at")["ord"]}

    def last_step(met: list[int], asked: list[int], more: list[tuple], room: int) -> tuple[list[tuple], bool]:
        """What is kept of the last step: the neighbours of the hubs ``met``, without those ``asked`` before, and ``more``; whether that is all."""
        at = np.setdiff1d(np.concatenate([places[h] for h in met]), asked) if met else np.array([], int)
        more = [r for r in more if not (r[0] in place and (at == place[r[0]]).any())]
        ords, tokens, minus = (np.concatenate([k[at], [r[i] for r in more]]) if more else k[at] for i, k in enumerate((known_ords, known_tokens, known_minus)))
        order = np.lexsort((ords, minus))
        ords, tokens, kept, i = ords[order], tokens[order], [], 0
        while (fits := np.flatnonzero(tokens[i:] <= room)).size:
            i += int(fits[0])
            kept.append((int(ords[i]), max_depth, int(tokens[i])))
            room -= kept[-1][2]
            i += 1
        return kept, len(kept) == len(ords)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, now, kept, used, whole, met, asked, more = ["target", "pos", "ord", "depth", "tokens", "reason"], None, [], 0, True, [], [], []

        def filled() -> list[tuple]:
            rest, all_kept = last_step(met, asked, more, max_tokens - used) if bounded else ([], True)
            return [(now, pos, *k, "complete" if whole and all_kept else "token_budget") for pos, k in enumerate([*kept, *rest])]

        for b in batches:
            out = []
            for target, ord_, depth, tokens, minus in zip(*[b[c].tolist() for c in ("target", "ord", "depth", "tokens", "minus")]):
                if target != now:
                    out += filled()
                    now, kept, used, whole, met, asked, more = target, [], 0, True, [], [], []
                if depth > walked:
                    more.append((ord_, tokens, minus))
                    continue
                if depth == walked and ord_ in places:
                    met.append(ord_)
                if ord_ in place:
                    asked.append(place[ord_])
                if max_tokens and used + tokens > max_tokens:
                    whole = False
                    continue
                kept.append((ord_, depth, tokens))
                used += tokens
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(filled(), columns=names)

    ordered = rows.select("target", "ord", "depth", "tokens", "minus").sortWithinPartitions("target", "depth", "minus", "ord")
    return ordered.mapInPandas(fold, "target long, pos int, ord long, depth int, tokens long, reason string")


def prefix_context(hits: DataFrame, scores: DataFrame, max_tokens: int) -> DataFrame:
    """The most central hits before the first that overflows the budget, with ``used`` so far; a line is ten tokens.

    Where it overflows is found from the hits that have tokens, of which a
    budget holds few; only what lies before is added up in order.
    """
    rows = hits.join(scores.select("ord", "score"), "ord", "left").fillna(0.0, ["score"]).withColumns({"tokens": (F.col("line_end") - F.col("line_start")) * 10, "minus": -F.col("score")})
    used, over = 0, None

    def take(r: Row) -> bool:
        nonlocal used, over
        used += r["tokens"]
        if over is None and used > max_tokens:
            over = r
        return False

    fold_in_order(rows.where("tokens > 0").select("minus", "ord", "tokens"), ["minus", "ord"], take, lambda: None if over else F.lit(True))
    if over:
        rows = rows.where((F.col("minus") < over["minus"]) | ((F.col("minus") == over["minus"]) & (F.col("ord") < over["ord"])))
    return running_total(rows, ["minus", "ord"], F.col("tokens"), "used").drop("minus")


def map_scores(nodes: DataFrame, centrality: DataFrame, focus: list[str] | None = None, exclude_tests: bool = True) -> DataFrame:
    """``score`` of each vertex that may stand on a map."""
    n = nodes.where(~F.col("kind").isin("import", "export", "module")).where(~is_generated_map(F.col("file")))
    if exclude_tests:
        n = n.where(~is_test_map(F.col("file")))
    n = n.join(centrality.select("ord", F.col("score").alias("c")), "ord", "left")
    bonus = F.when(F.col("kind").isin("class", "interface", "struct"), 0.1).when(F.col("kind") == "constructor", -0.1).when(F.col("kind").isin("field", "constant"), -0.2).otherwise(0.0)
    wanted = F.lit(False)
    for f in focus or []:
        wanted = wanted | F.contains("file", F.lit(f.strip("*")))
    entry = F.when(is_entry_point(F.col("name"), F.col("kind"), F.col("file")), 0.3).otherwise(0.0)
    return n.withColumn("score", F.coalesce("c", F.lit(0.0)) + entry + bonus + F.when(wanted, 0.3).otherwise(0.0)).drop("c")


def file_cap(tokens: int) -> int:
    return 5 if tokens <= 1024 else 8 if tokens <= 2048 else 12


def map_capped(scored: DataFrame, tokens: int = 1024) -> DataFrame:
    """The best few vertices of each file with ``rank`` in it and ``best``, the file's best score."""
    w = Window.partitionBy("file").orderBy(F.desc("score"), "ord")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= file_cap(tokens))
    return top.withColumn("best", F.max("score").over(Window.partitionBy("file"))).withColumn("best_ord", F.max(F.when(F.col("rank") == 1, F.col("ord"))).over(Window.partitionBy("file")))


def build_map(nodes: DataFrame, centrality: DataFrame, tokens: int = 1024, focus: list[str] | None = None, exclude_tests: bool = True, root: str = "") -> dict:
    """A map of the files by their best symbols, within four characters a token.

    Files come by their best symbol. A symbol that overflows ends its file
    only; the next files are tried until the characters are used up. The first
    symbol is always shown.
    """
    scored = map_scores(nodes, centrality, focus, exclude_tests)
    rows = map_capped(scored, tokens).withColumns({"short": F.coalesce(short_signature("signature"), F.col("name")), "minus": -F.col("best")})
    # a symbol is of interest as long as no symbol before it in its file, nor itself, is too long for what is left
    rows = rows.withColumn("longest", F.max(F.length("short")).over(Window.partitionBy("file").orderBy("rank")))
    rows = rows.select("minus", "best_ord", "rank", "file", "longest", compress_path(F.col("file"), root).alias("path"), "name", "kind", "short", "score", "line_start", F.length("short").alias("chars"))
    budget, used, ended, at = 4 * tokens, 0, set(), None

    def take(r: Row) -> bool:
        nonlocal used, at
        at = r["file"]
        cost = r["chars"] + 50
        if used >= budget or r["file"] in ended:
            return False
        if used and used + cost > budget:
            ended.add(r["file"])
            return False
        used += cost
        return True

    def fits() -> Column | None:
        if used >= budget:
            return None
        return F.lit(True) if not used else (F.col("file") == F.lit(at)) | (F.col("longest") + 50 <= budget - used)

    kept = fold_in_order(rows, ["minus", "best_ord", "rank"], take, fits, MAP_CHUNK)
    files: dict[str, list] = {}
    for r in kept:
        files.setdefault(r["path"], []).append({"name": r["name"], "kind": r["kind"], "line": r["line_start"], "signature": r["short"], "centrality": round(r["score"], 2)})
    return {"schema": "symgraph.map.v1", "symbols_total": scored.count(), "symbols_shown": len(kept), "files": [{"path": p, "symbols": s} for p, s in files.items()]}


def map_page(built: dict, offset: int = 0, limit: int = 50) -> dict:
    """A page of a map's files."""
    files = built["files"]
    return built | {"files": files[offset : offset + limit], "total_files": len(files), "next_offset": offset + limit if offset + limit < len(files) else None}


def map_text(built: dict) -> str:
    """A map as lines of text."""
    lines = []
    for f in built["files"]:
        lines += [f["path"], *[f"  {s['kind']} {s['signature']} :{s['line']}" for s in f["symbols"]]]
    return "\n".join(lines)
