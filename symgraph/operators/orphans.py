"""References to records that do not exist at the time of the reference.

Keys are hashed to 128 bits and range-partitioned by the leading bits, which
makes the ranges equal without sampling. The parents of a range are kept as
arrays sorted by key and start time; the references of the range stream past
in Arrow batches and are looked up by binary search. Ranges with too many
references (one key may hold a third of them) are split over several tasks,
each of which gets the range's parents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.session import partitions

NEVER = 2**63 - 1
#: Parents of one range, at most some tens of MB of arrays in a task.
PARENTS_PER_RANGE = 400_000
MOST_RANGES = 1 << 16


def parent_rows(df: DataFrame, space: str, key: Column, start: Column, end: Column | None = None) -> DataFrame:
    """``h1, h2, a, b``: a key's hashes and the time it is valid in, from ``a`` until before ``b`` (microseconds).

    Rows without a key or a start never hold. ``space`` keeps the keys of
    different tables apart.
    """
    rows = df.select(key.alias("k"), start.alias("a"), (F.lit(None) if end is None else end).cast("long").alias("b"))
    rows = rows.where("k IS NOT NULL AND a IS NOT NULL").select(*_hashes(space), "a", F.coalesce("b", F.lit(NEVER)).alias("b"))
    return rows


def reference_rows(df: DataFrame, space: str, tag: int, key: Column, row_id: Column, at: Column) -> DataFrame:
    """``h1, h2, a, b, tag``: a reference's key hashes, its time ``a`` and its row id ``b``; null keys are no references."""
    rows = df.select(key.alias("k"), at.alias("a"), row_id.cast("long").alias("b")).where("k IS NOT NULL")
    return rows.select(*_hashes(space), "a", "b", F.lit(tag).cast("int").alias("tag"))


def _hashes(space: str) -> list[Column]:
    return [F.xxhash64(F.lit(space), F.col("k")).alias("h1"), F.xxhash64(F.lit(f"{space}/2"), F.reverse("k"), F.col("k")).alias("h2")]


class _Range:
    """The parents of one range: keys and starts in order, and the latest end among a key's rows so far."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        h1, h2, start, end = (np.concatenate(x) for x in zip(*parts))
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        self.key = np.cumsum(new) - 1
        self.h1, self.h2 = h1[new], h2[new]
        self.starts, start_at = np.unique(start, return_inverse=True)
        self.width = len(self.starts) + 1
        self.code = self.key * self.width + start_at + 1
        ends, end_at = np.unique(end, return_inverse=True)
        latest = np.maximum.accumulate(self.key * (len(ends) + 1) + end_at) - self.key * (len(ends) + 1)
        self.end = ends[latest]

    def holds(self, h1: np.ndarray, h2: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.h1, h1)
        last = len(self.h1) - 1
        while True:  # again only for different keys with the same first hash
            inside = np.minimum(k, last)
            same = (k <= last) & (self.h1[inside] == h1)
            wrong = same & (self.h2[inside] != h2)
            if not wrong.any():
                break
            k = k + wrong
        pos = np.searchsorted(self.code, inside * self.width + np.searchsorted(self.starts, at, "right"), "right") - 1
        there = np.maximum(pos, 0)
        return same & (pos >= 0) & (self.key[there] == inside) & (self.end[there] > at)


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misses out of rows sorted by range, parents before references."""
    group, parts, index = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        g, ref, h1, h2, a = (_numpy(batch, x) for x in ("g", "ref", "h1", "h2", "a"))
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (ref[1:] != ref[:-1])) + 1
        missed = []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(g)]):
            if g[lo] != group:
                group, parts, index = g[lo], [], None
            if not ref[lo]:
                parts.append(tuple(x[lo:hi].copy() for x in (h1, h2, a, _numpy(batch, "b"))))
                continue
            if index is None and parts:
                index, parts = _Range(parts), []
            gone = np.ones(hi - lo, bool) if index is None else ~index.holds(h1[lo:hi], h2[lo:hi], a[lo:hi])
            missed.append(lo + np.flatnonzero(gone))
        if missed:
            at = pa.array(np.concatenate(missed))
            yield pa.RecordBatch.from_arrays([batch.column(x).take(at) for x in ("tag", "b", "a")], ["tag", "row_id", "at"])


def orphan_references(parents: DataFrame, references: DataFrame) -> DataFrame:
    """``tag, row_id, at``: the references for which no parent of the key holds at their time.

    ``parents`` and ``references`` come from :func:`parent_rows` and
    :func:`reference_rows`, of any number of tables, united. A reference
    without a time is missing, as no parent is known to hold then. Repeated
    references come out as often as they come in; any number of overlapping or
    repeated parent rows of a key is fine. Without parents every reference is
    missing.
    """
    spark = references.sparkSession
    tasks = partitions(spark)
    n = min(MOST_RANGES, 1 << math.ceil(math.log2(max(256, parents.count() / PARENTS_PER_RANGE))))
    where = F.shiftrightunsigned("h1", 64 - int(math.log2(n))).cast("int").alias("r")
    counts = {r["r"]: r["count"] for r in references.groupBy(where).count().collect()}  # one number a range
    fair = max(50_000, sum(counts.values()) / (4 * tasks))
    splits = [(r, math.ceil(c / fair)) for r, c in counts.items() if c > fair]
    hot = F.broadcast(spark.createDataFrame(splits, "r int, splits int"))  # at most 4 a task
    p = parents.select(where, "*").join(hot, "r", "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)))
    r = references.select(where, "*").join(hot, "r", "left").withColumn("s", F.pmod(F.xxhash64("b", "a", "tag"), F.coalesce("splits", F.lit(1))).cast("int"))
    cols = [(F.col("r").cast("long") * 1_000_000 + F.col("s")).alias("g"), F.col("h1"), F.col("h2"), F.coalesce("a", F.lit(-NEVER)).alias("a"), F.col("b")]
    both = p.select(*cols, F.lit(None).cast("int").alias("tag"), F.lit(False).alias("ref")).unionByName(r.select(*cols, F.col("tag"), F.lit(True).alias("ref")))
    laid = both.repartition(tasks, "g").sortWithinPartitions("g", "ref", "h1", "h2", "a")
    out = laid.mapInArrow(_probe, "tag int, row_id long, at long")
    return out.withColumn("at", F.when(F.col("at") != -NEVER, F.timestamp_micros("at")))
