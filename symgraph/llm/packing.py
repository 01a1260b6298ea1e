"""Items of varying length into windows of fixed capacity.

The lengths of all items form one global histogram of bounded size. Dynamic
programming chooses the bucket boundaries that minimise padding (the sum, over
all items, of bucket bound less length). Inside a slice, windows are the
token-budget batches of a bucket: it takes its items into a batch as long as
the room left holds the bucket's bound, and a batch that is done with its
bucket goes on to the largest bucket whose bound it still holds. What a batch
loses is what the bounds exceed the lengths by, the padding that the dynamic
program minimises. Slices with very many items are hashed into subgroups of
bounded size which are packed on their own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.groups import whole_groups
from symgraph.operators.skew import hot_groups, sized_join
from symgraph.session import partitions

BUCKETS = 64
#: Lengths up to this are counted one by one, longer ones in 128 steps an octave: under 3,400 bins for any INT.
EXACT_LENGTHS, STEPS = 512, 7
#: Rows of a subgroup, which a task holds as a whole; a subgroup's last windows are all that cutting up a slice can cost.
ROWS_PER_GROUP = 20_000


def length_bin(length: Column) -> Column:
    """The upper bound of the histogram bin of a length."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(EXACT_LENGTHS)))) - STEPS)
    return F.when(length <= EXACT_LENGTHS, length).otherwise(F.ceil(length / step) * step).cast("long")


def optimal_bounds(bins: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` of the sorted ``bins`` as bucket bounds, with the least total padding; none for no bins."""
    n = len(bins)
    if n <= k:
        return bins
    bound = bins.astype(float)
    c, s = np.r_[0, np.cumsum(counts, dtype=float)], np.r_[0, np.cumsum(counts * bound)]
    best, back = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(k):
        now, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            cost = best[:j] + bound[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            at[j] = int(np.argmin(cost))
            now[j] = cost[at[j]]
        now[0] = 0
        best = now
        back.append(at)
    out, j = [], n
    for at in reversed(back):
        if not j:
            break
        out.append(bins[j - 1])
        j = at[j]
    return np.array(out[::-1])


def pack_group(lengths: np.ndarray, capacity: int, bounds: np.ndarray) -> np.ndarray:
    """The window of each item, from 0 on without gaps; no window holds more than ``capacity``.

    Lengths of zero or less take no room and go to window 0. All lengths must
    fit. Equal lengths keep their order, so the result depends on that alone.
    """
    window = np.zeros(len(lengths), np.int64)
    sized = np.flatnonzero(lengths > 0)
    bucket = np.searchsorted(bounds, lengths[sized])
    order = np.lexsort((-lengths[sized], -bucket))
    limits, placed, room = bounds.tolist(), [], []
    # the open batches by the largest bucket whose bound they hold, and a bit for each bucket that has any
    batches: list[list[int]] = [[] for _ in limits]
    any_ = 0
    for j, length in zip(bucket[order].tolist(), lengths[sized][order].tolist()):
        fits = any_ >> j
        if fits:
            at = j + (fits & -fits).bit_length() - 1  # the least room that holds the bucket's bound
            w = batches[at].pop()
            if not batches[at]:
                any_ ^= 1 << at
        else:
            w = len(room)
            room.append(capacity)
        room[w] -= length
        at = bisect_right(limits, room[w]) - 1
        if at >= 0:
            batches[at].append(w)
            any_ |= 1 << at
        placed.append(w)
    window[sized[order]] = placed
    return window


PACKED = "slice_id long, item_no long, capacity long, window_no long, windows long, tokens long, oversize boolean"


def _pack(bounds: np.ndarray):
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in whole_groups(batches, ["slice_id", "salt"]):
            col = {c: frame[c].to_numpy() for c in ("slice_id", "item_no", "tokens", "capacity", "salts", "salt")}
            lost = pd.isna(col["item_no"])
            out: list[tuple] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                no, tokens, null = col["item_no"][lo:hi], col["tokens"][lo:hi], lost[lo:hi]
                if hi - lo > 1:  # repeated rows lie together, the largest estimate first
                    first = np.r_[True, ~((no[1:] == no[:-1]) | (null[1:] & null[:-1]))]
                    no, tokens = no[first], tokens[first]
                capacity, salts, salt = int(col["capacity"][lo]), int(col["salts"][lo]), int(col["salt"][lo])
                whole, over = tokens // capacity, tokens > capacity
                whole[~over] = 0
                rest = tokens - whole * capacity
                window = pack_group(rest, capacity, bounds)
                laid = ~over | (rest > 0)
                n = int(window.max()) + 1 if laid.any() else 0
                first_full = n + np.cumsum(whole) - whole
                for pick, at, count, amount in ((laid, window, np.ones_like(whole), rest), (over, first_full, whole, whole * capacity)):
                    if pick.any():
                        k = int(pick.sum())
                        out.append((np.full(k, col["slice_id"][lo]), no[pick], np.full(k, capacity), at[pick] * salts + salt, count[pick], amount[pick], over[pick]))
            if out:
                yield pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(names)})

    return run


def pack_items(items: DataFrame, slices: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Lay the items of each slice into windows of the slice's capacity.

    ``items`` has ``slice_id, item_no, token_estimate``; ``slices`` has
    ``slice_id, max_tokens``; other columns do not matter. Result:
    ``slice_id, item_no, capacity, window_no, windows, tokens, oversize``, one
    row per item and one more for an item larger than the capacity: such an
    item alone is split, ``windows`` consecutive windows from ``window_no`` on
    are filled by it wholly and its rest is laid like any other item.

    Null, zero and negative estimates take no room. Repeated keys count once,
    with their largest estimate. A slice without a positive ``max_tokens`` is
    unlimited: all its items lie in window 0, its capacity is null. Items whose
    slice is missing or null come out with null ``window_no`` and ``capacity``.
    Of a repeated slice the largest ``max_tokens`` counts.
    """
    i = items.select(F.col("slice_id").cast("long").alias("slice_id"), F.col("item_no").cast("long").alias("item_no"), F.greatest(F.coalesce(F.col("token_estimate").cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    hot = hot_groups(i, F.col("slice_id"), ROWS_PER_GROUP).where("key IS NOT NULL")
    s = slices.groupBy(F.col("slice_id").cast("long").alias("slice_id")).agg(F.max(F.col("max_tokens").cast("long")).alias("capacity"), F.lit(True).alias("there"))
    hot = sized_join(hot)
    s = s.join(hot, F.col("slice_id") == F.col("key"), "left").select("slice_id", "capacity", "there", F.coalesce("salts", F.lit(1)).alias("salts"))
    s = s.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    i = i.join(hot, F.col("slice_id") == F.col("key"), "left").withColumn("salt", F.pmod(F.xxhash64("item_no"), F.coalesce("salts", F.lit(1))).cast("int")).drop("key", "salts")
    i = i.repartition(partitions(items.sparkSession), "slice_id", "salt").join(s, ["slice_id", "salt"], "left")
    limited = i.where("capacity > 0")
    piece = F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens"))
    hist = limited.where(piece > 0).groupBy(length_bin(piece).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the bins
    hist.sort()
    bounds = optimal_bounds(np.array([r["bin"] for r in hist], np.int64), np.array([r["n"] for r in hist], np.int64), buckets)
    packed = limited.sortWithinPartitions("slice_id", "salt", "item_no", F.desc("tokens")).mapInPandas(_pack(bounds), PACKED)
    free = i.where("capacity IS NULL OR capacity <= 0").groupBy("slice_id", "item_no").agg(F.max("tokens").alias("tokens"), F.max("there").alias("there"))
    free = free.select("slice_id", "item_no", F.lit(None).cast("long").alias("capacity"), F.when(F.col("there"), F.lit(0)).cast("long").alias("window_no"), F.lit(1).cast("long").alias("windows"), "tokens", F.lit(False).alias("oversize"))
    return packed.unionByName(free)
