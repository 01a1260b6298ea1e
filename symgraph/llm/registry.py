"""All queries of the training-data operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm.bpe import encode_corpus
from symgraph.llm.mixing import Mixture
from symgraph.llm.origin import fit_classifiers, not_hand_written
from symgraph.llm.packing import BUCKETS, pack_items
from symgraph.llm.parsing import invalid_files, invalid_rates
from symgraph.llm.residue import find_residue
from symgraph.llm.topk import top_n
from symgraph.session import table


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(table(spark, sf_dir, "context_nodes"), table(spark, sf_dir, "context_slices"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).where("oversize").select("slice_id", F.col("item_no").cast("int").alias("item_no")).distinct()


def p1_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir)


def p1_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: slices, items, tokens, the fewest windows that could do, and whether no more than 1.1 times as many were needed."""
    p = packed(spark, sf_dir).where("capacity IS NOT NULL")
    items = p.groupBy("capacity", "slice_id", "item_no").agg(F.sum("tokens").alias("tokens"))
    s = items.groupBy("capacity", "slice_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    w = p.groupBy("capacity", "slice_id", "window_no").agg(F.max("windows").alias("n")).groupBy("capacity", "slice_id").agg(F.sum("n").alias("windows"))
    least = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("long")
    out = s.join(w, ["capacity", "slice_id"]).groupBy("capacity").agg(F.count(F.lit(1)).alias("slices"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum(least).alias("lower_bound"), F.sum("windows").alias("windows"))
    return out.withColumn("within", F.col("windows") <= 1.1 * F.col("lower_bound")).drop("windows")


def p1_windows_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows needed by the buckets of the dynamic program, with a single bucket, and at the very least."""
    def used(buckets: int) -> int:
        p = pack_items(table(spark, sf_dir, "context_nodes"), table(spark, sf_dir, "context_slices"), buckets).where("capacity IS NOT NULL")
        return p.groupBy("slice_id", "window_no").agg(F.max("windows").alias("n")).agg(F.sum("n")).first()[0] or 0

    least = p1_fill(spark, sf_dir).agg(F.sum("lower_bound")).first()[0] or 0
    return spark.createDataFrame([(used(BUCKETS), used(1), least)], "windows long, one_bucket long, lower_bound long")


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "scored_nodes")
    best = top_n(s, F.replace("file", F.lit("\\"), F.lit("/")), F.col("score"), F.col("ord"), 5)
    return best.select(F.col("grp").alias("file"), F.col("ident").alias("ord"), "score", "rank")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_top(spark, sf_dir).select("file", "ord")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "source_files")).select("path")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(table(spark, sf_dir, "source_files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_hand_written(table(spark, sf_dir, "source_files")).select("path")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_hand_written(table(spark, sf_dir, "source_files"))


def p6_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each classifier does on repositories held out, against the giveaways it does not see."""
    report = fit_classifiers(table(spark, sf_dir, "source_files")).report
    return spark.createDataFrame(report, "classifier string, files int, giveaways int, found int, precision double, recall double")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).selection()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).shares()


def p9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed blocks in training order: shard, slot, source number, repetition and block of the source."""
    return mixture(spark, sf_dir).slots


def p9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed blocks in training order with the token ids of each."""
    return mixture(spark, sf_dir).token_blocks()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and windows per kind of residue."""
    found = find_residue(table(spark, sf_dir, "documents"))
    return found.groupBy("kind").agg(F.countDistinct("doc_id").alias("documents"), F.sum("windows").alias("windows"))


QUERIES = {
    "p1_found": p1_found,
    "p1_windows": p1_windows,
    "p1_fill": p1_fill,
    "p1_windows_used": p1_windows_used,
    "p3_found": p3_found,
    "p3_top": p3_top,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p6_found": p6_found,
    "p6_kinds": p6_kinds,
    "p6_validation": p6_validation,
    "p8_ids": p8_ids,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p9_blocks": p9_blocks,
    "p9_tokens": p9_tokens,
    "p10_found": p10_found,
    "p10_kinds": p10_kinds,
}

_TOP = """
    WITH s AS (SELECT replace(file, chr(92), '/') AS file, ord, max(score) AS score FROM scored_nodes
               WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
    r AS (SELECT file, ord, score, CAST(row_number() OVER (PARTITION BY file ORDER BY score DESC, ord) AS INTEGER) AS rank FROM s)
"""

ORACLE = {
    "p1_found": """
        SELECT DISTINCT n.slice_id, n.item_no FROM context_nodes n JOIN context_slices s USING (slice_id)
        WHERE s.max_tokens > 0 AND n.token_estimate > s.max_tokens
    """,
    "p1_fill": """
        WITH i AS (SELECT slice_id, item_no, max(greatest(coalesce(token_estimate, 0), 0)) AS t FROM context_nodes GROUP BY 1, 2),
        s AS (SELECT slice_id, CAST(max(max_tokens) AS BIGINT) AS capacity FROM context_slices GROUP BY 1),
        p AS (SELECT capacity, slice_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens FROM i JOIN s USING (slice_id) WHERE capacity > 0 GROUP BY 1, 2)
        SELECT capacity, count(*) AS slices, CAST(sum(n) AS BIGINT) AS items, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(greatest(1, (tokens + capacity - 1) // capacity)) AS BIGINT) AS lower_bound, true AS within FROM p GROUP BY 1
    """,
    "p3_found": _TOP + "SELECT file, ord FROM r WHERE rank <= 5",
    "p3_top": _TOP + "SELECT file, ord, score, rank FROM r WHERE rank <= 5",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
