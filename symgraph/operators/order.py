"""Numbers and sums along a global order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.session import checkpoint


def running_total(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row in the given order, which must tell all rows apart.

    Rows are laid in ranges of the order and written, so that the ranges are the
    same whoever reads them; a range adds up its own rows after the total of the
    ranges before it, of which there is one row each.
    """
    laid = rows.withColumn(name, value).repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id())
    laid = checkpoint(laid)
    each = laid.groupBy("_range").agg(F.sum(name).alias("_sum"))
    ahead = each.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_ahead"))  # a row per range
    within = F.sum(name).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return laid.withColumn(name, within).join(F.broadcast(ahead), "_range").withColumn(name, F.col(name) + F.col("_ahead")).drop("_range", "_ahead")


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` 1, 2, ... in the given order."""
    return running_total(rows, order, F.lit(1).cast("long"), name)
