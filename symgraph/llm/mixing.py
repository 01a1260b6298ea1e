"""Mixing sources to target weights, in blocks of equal size.

The documents of a source, in pseudorandom order, form one stream of tokens
that is cut into blocks; the last block of a source may be shorter, and a
source's weight is kept in tokens, not in blocks. The number of blocks is the
largest that lets every source reach its weight within its repeat cap. The
output is divided into shards; how many blocks of each source a shard holds is
drawn so that the totals come out exact: the shards are halved again and again,
and each half draws its counts out of those of the whole. So the counts of one
shard follow from the seed alone, and every task makes its own. Slot k of a
source is the k-th entry of its pseudorandom block order (one order per
repetition), and slots, blocks and documents are joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.llm.tokens import TOKENIZER, token_counts
from symgraph.session import checkpoint, spread

BLOCK_TOKENS = 1024
SHARD_BLOCKS = 1024
DOCS_PER_BUCKET = 50_000


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Entry ``index`` of a pseudorandom order of ``0 .. n - 1``: a Feistel network of four rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            h = right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def quotas(weights: np.ndarray, capacity: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Blocks per source: tokens as the weights, none above its capacity (in blocks), as many as possible. ``size`` is the tokens in a source's block on average."""
    size = np.ones(len(weights)) if size is None else size
    use = (weights > 0) & (capacity > 0)
    if not use.any():
        return np.zeros(len(weights), np.int64)
    w = np.where(use, weights, 0) / weights[use].sum()
    total = ((capacity * size)[use] / w[use]).min()
    q = np.zeros(len(weights), np.int64)
    q[use] = np.floor(w[use] * total / size[use] + 0.5 - 1e-9)
    return np.minimum(q, capacity)


def _draw(quota: np.ndarray, n: int, seed: tuple[int, ...]) -> np.ndarray:
    """``n`` blocks out of ``quota``, without putting back."""
    rng, total = np.random.default_rng(seed), int(quota.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(quota, n, method="marginals")
    take = np.zeros_like(quota)  # beyond what can be drawn exactly: with the open quotas as weights
    while take.sum() < n:
        left = quota - take
        take = take + np.minimum(rng.multinomial(n - int(take.sum()), left / left.sum()), left)
    return take


def shard_row(quota: np.ndarray, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source in a shard of ``slots`` blocks, and in all shards before it."""
    first, a, b = np.zeros_like(quota), 0, -(-int(quota.sum()) // slots)
    while b - a > 1:
        middle = (a + b) // 2
        left = _draw(quota, (middle - a) * slots, (seed, a, b))
        if shard < middle:
            quota, b = left, middle
        else:
            quota, first, a = quota - left, first + left, middle
    return quota, first


def shard_counts(quota: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """Blocks per shard and source; columns sum to ``quota``."""
    rows = [shard_row(quota, slots, k, seed)[0] for k in range(-(-int(quota.sum()) // slots))]
    return np.array(rows, np.int64).reshape(len(rows), len(quota))


SLOTS = "shard long, slot long, src int, epoch long, block long"


def _slots(quota: np.ndarray, per_shard: int, n_blocks: list[int], seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"].tolist():
                counts, first = shard_row(quota, per_shard, shard, seed)
                place, size = 0, int(counts.sum())
                for src in np.flatnonzero(counts).tolist():
                    k = np.arange(first[src], first[src] + counts[src])
                    epoch, index = k // n_blocks[src], k % n_blocks[src]
                    block = np.empty_like(k)
                    for e in np.unique(epoch):
                        at = epoch == e
                        block[at] = permute(index[at], n_blocks[src], seed * 1_000_003 + src * 1009 + int(e))
                    slot = permute(np.arange(place, place + len(k)), size, seed * 7919 + shard)
                    place += len(k)
                    yield pd.DataFrame({"shard": shard, "slot": slot, "src": src, "epoch": epoch, "block": block})

    return run


def _pieces(path: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from symgraph.llm.bpe import encoder, groups

        for b in batches:
            out, ids = [], [x for g in groups(b["text"].tolist()) for x in encoder(path).encode(g)]
            for src, begin, n, x in zip(b["src"], b["begin"], b["n_tokens"], ids):
                if len(x) == n:  # of rows with one identifier, that which was counted
                    cuts = [0, *range(size - begin % size, n, size), n]
                    out += [(src, (begin + i) // size, (begin + i) % size, x[i:j]) for i, j in zip(cuts, cuts[1:]) if j > i]
            yield pd.DataFrame(out, columns=["src", "block", "at", "ids"])

    return run


class Mixture:
    """A drawn mixture: ``slots`` (the blocks in training order), ``token_blocks`` (with their tokens), ``selection`` (per document) and ``shares`` (per source)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 1, tokenizer: str = TOKENIZER, shard_blocks: int = SHARD_BLOCKS):
        """``documents`` has ``doc_id, text, source``; ``targets`` has ``source, target_weight, max_repeats`` (a row per source, few).

        Null and empty texts have no tokens and are never drawn; documents of
        null or unlisted sources neither. A listed source without tokens,
        weight or repeats gives nothing, and the weights of the others are
        scaled to 1. Repeated rows of a document count once.
        """
        spark = documents.sparkSession
        t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).orderBy("source").collect()
        self.targets = [(r["source"], float(r["w"] or 0), int(r["r"] or 0)) for r in t]
        kinds = spark.createDataFrame([(s, i) for i, (s, _, _) in enumerate(self.targets)], "source string, src int")
        counted = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", token_counts("text", tokenizer).alias("n_tokens"))
        counted = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.*")
        counted = checkpoint(counted.join(F.broadcast(kinds), "source").where("n_tokens > 0"))
        sums = {r["src"]: (r["n"], r["docs"]) for r in counted.groupBy("src").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
        self.tokens = [int(sums.get(i, (0, 0))[0]) for i in range(len(self.targets))]
        buckets = max(16, -(-sum(d for _, d in sums.values()) // DOCS_PER_BUCKET))
        at = counted.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
        ahead = at.groupBy("src", "bucket").agg(F.sum("n_tokens").alias("n"))
        ahead = ahead.withColumn("base", F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).drop("n")
        inside = F.sum("n_tokens").over(Window.partitionBy("src", "bucket").orderBy("h", "doc_id")) - F.col("n_tokens")
        placed = at.withColumn("inside", inside).join(ahead, ["src", "bucket"])
        self.placed = placed.select("doc_id", "source", "src", "n_tokens", (F.col("base") + F.col("inside")).alias("begin"))
        n_blocks = [-(-n // block_tokens) for n in self.tokens]
        capacity = np.array([b * r for b, (_, _, r) in zip(n_blocks, self.targets)], np.int64)
        weights = np.array([w if c else 0 for c, (_, w, _) in zip(capacity, self.targets)], float)
        mean = np.array([n / b if b else 1.0 for n, b in zip(self.tokens, n_blocks)])
        self.quota, self.block_tokens = quotas(weights, capacity, mean), block_tokens
        self.scaled = (weights / weights.sum() if weights.sum() > 0 else weights).tolist()
        self.documents, self.tokenizer = documents, tokenizer
        shards = -(-int(self.quota.sum()) // shard_blocks)
        ids = spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4)))
        self.slots = ids.mapInPandas(_slots(self.quota, shard_blocks, n_blocks, seed), SLOTS)

    def token_blocks(self) -> DataFrame:
        """``shard, slot, source, epoch, block, ids``: the drawn blocks with their tokens, of which all but a source's last have ``block_tokens``.

        Documents are cut where blocks end; the pieces of a block, never more
        tokens than a block has, are laid together, and joined by index to every
        slot that draws it.
        """
        used = self.selection().select("doc_id")
        text = self.documents.select(F.col("doc_id").alias("d"), "source", "text").join(self.placed.join(used, "doc_id", "left_semi").select(F.col("doc_id").alias("d"), "source", "src", "begin", "n_tokens"), ["d", "source"])
        pieces = text.select("src", "begin", "n_tokens", "text").mapInPandas(_pieces(self.tokenizer, self.block_tokens), "src int, block long, at int, ids array<int>")
        once = pieces.groupBy("src", "block", "at").agg(F.max("ids").alias("ids"))
        blocks = once.groupBy("src", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
        kinds = F.broadcast(blocks.sparkSession.createDataFrame([(i, s) for i, (s, _, _) in enumerate(self.targets)], "src int, source string"))  # few
        return self.slots.join(blocks, ["src", "block"]).join(kinds, "src").select("shard", "slot", "source", "epoch", "block", "ids")

    def selection(self) -> DataFrame:
        """``doc_id, source, n_tokens, times_used, tokens_drawn`` of every document that is used; a block's repeats count for each document in it."""
        size = F.lit(self.block_tokens)
        uses = self.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))
        end = F.col("begin") + F.col("n_tokens")
        parts = self.placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((end - 1) / size))))
        overlap = F.least(end, (F.col("block") + 1) * size) - F.greatest(F.col("begin"), F.col("block") * size)
        met = parts.join(uses, ["src", "block"])
        return met.groupBy("doc_id", "source", "n_tokens").agg(F.max("uses").alias("times_used"), F.sum(overlap * F.col("uses")).alias("tokens_drawn"))

    def shares(self) -> DataFrame:
        """``source, target_weight, scaled_target, max_repeats, tokens, documents_used, tokens_drawn, share`` of every listed source; the scaled targets leave out sources that have nothing to give."""
        drawn = self.selection().groupBy("source").agg(F.count(F.lit(1)).alias("documents_used"), F.sum("tokens_drawn").alias("tokens_drawn"))
        spark = drawn.sparkSession
        t = spark.createDataFrame([(s, w, float(c), r, n) for (s, w, r), c, n in zip(self.targets, self.scaled, self.tokens)], "source string, target_weight double, scaled_target double, max_repeats int, tokens long")
        out = t.join(drawn, "source", "left").fillna(0, ["documents_used", "tokens_drawn"])
        total = F.sum("tokens_drawn").over(Window.partitionBy(F.lit(1)))  # a row per listed source
        return out.withColumn("share", F.when(total > 0, F.col("tokens_drawn") / total).otherwise(F.lit(0.0)))
