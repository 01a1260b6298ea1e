"""Searching symbols by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.predicates import is_test_cli


def matches(query: str):
    """A condition on ``name``: contains the query in any letter case; a query of one byte is a prefix; an empty one, or a single character of several bytes, matches nothing."""
    q, n = query.lower(), F.lower("name")
    if not q or (len(q) == 1 and len(q.encode()) > 1):
        return F.lit(False)
    return n.startswith(q) if len(q.encode()) == 1 else F.contains(n, F.lit(q))


def search(nodes: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """All vertices that match, by insertion."""
    out = nodes.where(matches(query))
    return out.where(F.col("kind") == kind) if kind else out


def search_any(nodes: DataFrame, query: str, limit: int = 10, exclude_tests: bool = False) -> DataFrame:
    """Terms separated by ``|``: matches of the first term come first, a symbol only once (its first vertex), at most ``limit``."""
    terms = [t for t in (x.strip() for x in query.split("|")) if t]
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(terms))):
        rank = F.when(matches(terms[i]), i).otherwise(rank)
    hits = nodes.withColumn("term", rank).where("term IS NOT NULL")
    if exclude_tests:
        hits = hits.where(~is_test_cli(F.col("file")))
    once = hits.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("term", "ord"))).where("k = 1").drop("k")
    return once.orderBy("term", "ord").limit(limit)


def page(hits: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int, bool, int | None]:
    """A page of the hits by insertion; their number, whether there are more, and the next offset."""
    total = hits.count()
    more = offset + limit < total
    return hits.orderBy("ord").offset(offset).limit(limit), total, more, offset + limit if more else None


def discover(nodes: DataFrame, centrality: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The most central matches."""
    hits = search(nodes, query).join(centrality.select("ord", "score"), "ord", "left").fillna(0.0, ["score"])
    return hits.orderBy(F.desc("score"), "ord").limit(limit)


def name_grams(nodes: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """``gram, ord``: the runs of 2 to 4 characters of each lower-case name, once each."""
    n = F.lower("name")
    def runs(k: int):
        return F.when(F.length(n) >= k, F.transform(F.sequence(F.lit(1), F.length(n) - k + 1), lambda i: F.substring(n, i, F.lit(k)))).otherwise(F.array())

    return nodes.select(F.explode(F.array_distinct(F.concat(*[runs(k) for k in range(least, most + 1)]))).alias("gram"), "ord")


def gram_candidates(grams: DataFrame, query: str) -> DataFrame:
    """``ord`` of the names that hold all grams of a query; whether they hold the query itself is still to be checked."""
    q = query.lower()
    k = min(4, len(q))
    wanted = sorted({q[i : i + k] for i in range(len(q) - k + 1)}) if k >= 2 else []
    return grams.where(F.col("gram").isin(wanted)).groupBy("ord").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("ord")


def _winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, met = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                met.append(c)
                break
    if not met:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m, swaps = len(met), sum(x != y for x, y in zip(met, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def suggest(nodes: DataFrame, degrees: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """Symbols like a query that has no match: ``ord, relevance, callers``, the best first.

    100 equal in any letter case, 80 an id that ends with it, 60 a prefix, 40
    contained, 30 a Jaro-Winkler similarity over 0.75; then by callers.
    """
    q = query.lower()

    @F.pandas_udf("double")
    def similarity(names: pd.Series) -> pd.Series:
        return names.map(lambda n: _winkler(n, q), na_action="ignore")

    n = F.lower("name")
    sure = F.when(n == q, 100).when(F.lower("id").endswith(q), 80).when(n.startswith(q), 60).when(F.contains(n, F.lit(q)), 40)
    rows = nodes.select("ord", sure.alias("sure"), n.alias("n"))
    rows = rows.where("sure IS NOT NULL").select("ord", F.col("sure").alias("relevance")).unionAll(rows.where("sure IS NULL").where(similarity("n") > 0.75).select("ord", F.lit(30)))
    return rows.join(degrees.select("ord", "callers"), "ord").orderBy(F.desc("relevance"), F.desc("callers"), "ord").limit(limit)
