"""Per-key results over tables in which a few keys hold most rows.

Value-frequency compression: rows are first counted by (key, value), which
spreads even the hottest key over all tasks and combines on the map side. What
each key needs (row counts, exact distinct counts, sums, modes, percentiles) is
then derived from the weighted values. Every second step is a combinable
aggregate or works on a bounded number of blocks, so no task ever holds the
rows, or even the distinct values, of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.session import checkpoint

#: Bits of a value that one level of the percentile search resolves: a key has
#: at most 2**16 blocks on a level.
RADIX_BITS = 16


def weighted_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows ``(key, value, weight)``: how often each value occurs under each key.

    A null key or value is a group like any other. Repeated rows add weight.
    """
    return df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def key_stats(weighted: DataFrame) -> DataFrame:
    """``key, n_rows, n_distinct, mode, mode_rows`` out of weighted values.

    Null values count in ``n_rows`` only; a key with null values alone has
    ``n_distinct`` 0 and a null mode. Among equally frequent values the
    smallest is the mode. An empty table gives no rows.
    """
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))))
    return (
        weighted.groupBy("key")
        .agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_distinct"), best.alias("best"))
        .select("key", "n_rows", "n_distinct", F.col("best.v").alias("mode"), (-F.col("best.w")).alias("mode_rows"))
    )


def key_sums(weighted: DataFrame) -> DataFrame:
    """``key, n_rows, value_sum`` out of weighted numeric values (nulls add nothing; all null: null)."""
    return weighted.groupBy("key").agg(F.sum("weight").alias("n_rows"), F.sum(F.col("value").cast("long") * F.col("weight")).alias("value_sum"))


def key_percentiles(weighted: DataFrame, shares: Sequence[float], bits: int = 32) -> DataFrame:
    """``key, share, value``: the smallest value at or below which ``share`` of a key's rows lie.

    Exact for whole numbers of ``bits`` bits. The value's leading 16 bits are
    found first from the weights of the key's blocks, then the next 16 inside
    the chosen block, and so on; a window therefore sees at most 65,536 blocks
    of a key, however many rows it has. Null values are left out.
    """
    spark = weighted.sparkSession
    rows = weighted.where("value IS NOT NULL").select("key", F.col("value").cast("long").alias("value"), "weight")
    picks: DataFrame | None = None
    for shift in range(bits - RADIX_BITS, -1, -RADIX_BITS):
        block = F.shiftright("value", shift)
        if picks is None:
            blocks = rows.groupBy("key", block.alias("block")).agg(F.sum("weight").alias("weight"))
            total = F.sum("weight").over(Window.partitionBy("key"))
            before = F.sum("weight").over(Window.partitionBy("key").orderBy("block")) - F.col("weight")
            at = blocks.select("key", "block", "weight", before.alias("before"), total.alias("total"))
            at = at.withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
            at = at.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total"))))
        else:
            inner = rows.withColumn("outer", F.shiftright("value", shift + RADIX_BITS))
            p = picks.withColumnRenamed("key", "k")
            met = inner.join(p, F.col("key").eqNullSafe(F.col("k")) & (F.col("outer") == F.col("prefix")))
            blocks = met.groupBy("key", "share", "need", block.alias("block")).agg(F.sum("weight").alias("weight"))
            before = F.sum("weight").over(Window.partitionBy("key", "share").orderBy("block")) - F.col("weight")
            at = blocks.withColumn("before", before)
        found = at.where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("weight")))
        picks = found.select("key", "share", F.col("block").alias("prefix"), (F.col("need") - F.col("before")).alias("need"))
    assert picks is not None, spark
    return picks.select("key", "share", F.col("prefix").alias("value"))


def heavy_keys(weighted: DataFrame, share: float) -> DataFrame:
    """``key, n_rows, n_distinct, mode, mode_rows`` of the non-null keys holding at least ``share`` of the rows with a key.

    There are at most ``1 / share`` of them, whatever the size of the table.
    """
    known = weighted.where("key IS NOT NULL")
    total = known.agg(F.sum("weight").alias("n"))
    return key_stats(known).where(F.col("n_rows") >= F.lit(share) * total.scalar())


def hot_groups(df: DataFrame, key: Column, rows_per_task: int) -> DataFrame:
    """``key, salts``: the groups of more than ``rows_per_task`` rows, and into how many subgroups each is to be hashed."""
    counts = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > rows_per_task).select("key", F.ceil(F.col("n") / F.lit(rows_per_task)).cast("int").alias("salts"))


def sized_join(small: DataFrame, most: int = 10_000) -> DataFrame:
    """``small`` written once, and marked for broadcast if it has at most ``most`` rows; else it is joined by a shuffle, whose skew Spark splits as it runs."""
    small = checkpoint(small)
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small
