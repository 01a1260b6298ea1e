"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.session import checkpoint

#: More delivered snapshots than this are joined without a broadcast.
BROADCAST_SNAPSHOTS = 100_000


def snapshot_states(df: DataFrame, seq: str, key: str, version: str, values: Sequence[str]) -> DataFrame:
    """``seq, key, values...``: the one state of every record in every snapshot.

    Repeated rows collapse; of several states the one with the largest
    ``version`` counts, and among equal versions the greatest values, so the
    result never depends on row order. Rows without a snapshot number belong to
    no snapshot and are left out; a null key is a record like any other.
    """
    state = F.max(F.struct(F.col(version).alias("ver"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))
    rows = df.where(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("seq"), F.col(key).alias("key")).agg(state.alias("s"))
    return rows.select("seq", "key", *[F.col(f"s.v{i}").alias(f"v{i}") for i in range(len(values))])


def snapshot_changes(df: DataFrame, seq: str, key: str, version: str, values: Sequence[str]) -> DataFrame:
    """``seq, key, change_kind``: per delivered snapshot but the first, what changed since the one delivered before it.

    ``EXCEPT ALL`` both ways removes the records that stayed the same; only what
    is left over is joined by key: on both sides it is ``changed``, on one
    ``added`` or ``removed``. Values are compared exactly and null equals null.
    Numbers that were never delivered are skipped over. Fewer than two
    snapshots give no rows.
    """
    spark = df.sparkSession
    numbers = sorted(r[0] for r in df.select(seq).where(F.col(seq).isNotNull()).distinct().collect())  # one per delivery
    kind = df.schema[seq].dataType.simpleString()
    follow = spark.createDataFrame(list(zip(numbers, numbers[1:])), f"seq {kind}, next_seq {kind}")
    if len(numbers) <= BROADCAST_SNAPSHOTS:
        follow = F.broadcast(follow)
    states = checkpoint(snapshot_states(df, seq, key, version, values))  # read four times, also after an executor is lost
    rest = ["key", *[f"v{i}" for i in range(len(values))]]
    before = states.join(follow, "seq").select(F.col("next_seq").alias("seq"), *rest)
    now = states.join(follow.select(F.col("next_seq").alias("seq")), "seq").select("seq", *rest)
    come = now.exceptAll(before).select("seq", "key", F.lit(True).alias("come"))
    gone = before.exceptAll(now).select(F.col("seq").alias("old_seq"), F.col("key").alias("old_key"), F.lit(True).alias("gone"))
    both = come.join(gone, (F.col("seq") == F.col("old_seq")) & F.col("key").eqNullSafe(F.col("old_key")), "full")
    label = F.when(F.col("gone").isNull(), "added").when(F.col("come").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("seq", "old_seq").alias("seq"), F.when(F.col("come"), F.col("key")).otherwise(F.col("old_key")).alias("key"), label.alias("change_kind"))
