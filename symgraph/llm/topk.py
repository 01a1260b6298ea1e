"""The N best items of every group, also of groups with a large share of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.session import partitions


def top_n(df: DataFrame, group: Column, score: Column, ident: Column, n: int, subgroups: int | None = None) -> DataFrame:
    """``grp, ident, score, rank``: the ``n`` items with the highest score in each group.

    Every group is hashed by item into subgroups; each subgroup is ranked and
    keeps ``n``, and only these survivors are ranked again. With the square root
    of rows / ``n`` as number of subgroups, which is taken if none is given,
    neither stage sees more than about the square root of rows x ``n`` rows of a
    group at once, even of one that holds all rows. Ties are broken by the smaller
    ``ident``. Items without a score (null or NaN) or without an identifier are
    left out. An item that occurs several times in a group counts once, with its
    highest score. A null group is a group like any other. An empty table, or
    an ``n`` below 1, gives no rows.
    """
    rows = df.select(group.alias("grp"), ident.alias("ident"), score.cast("double").alias("score")).where("score IS NOT NULL AND NOT isnan(score) AND ident IS NOT NULL")
    salts = subgroups or max(1, math.isqrt(df.count() // max(n, 1)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(salts)).cast("int"))
    laid = salted.select("grp", "salt", "ident", "score").repartition(partitions(df.sparkSession), "grp", "salt")
    once = laid.groupBy("grp", "salt", "ident").agg(F.max("score").alias("score"))
    best = [F.desc("score"), F.asc("ident")]
    kept = once.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*best))).where(F.col("rank") <= n)
    final = kept.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*best)))
    return final.where(F.col("rank") <= n).select("grp", "ident", "score", "rank")
