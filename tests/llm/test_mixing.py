from collections import Counter

import numpy as np

from symgraph.llm.bpe import encoder
from symgraph.llm.mixing import Mixture, permute, quotas, shard_counts, shard_row
from symgraph.llm.tokens import TOKENIZER, token_counts

DOCS, TARGETS = "doc_id long, text string, source string, src string, n_tokens string", "source string, target_weight double, max_repeats int"


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 1000):
        assert sorted(permute(np.arange(n), n, 9).tolist()) == list(range(n))
    assert permute(np.arange(1000), 1000, 9).tolist() != permute(np.arange(1000), 1000, 10).tolist()


def test_counts_meet_quotas():
    q = quotas(np.array([0.5, 0.3, 0.2]), np.array([1000, 100, 1000]))
    assert q.tolist() == [167, 100, 67]
    # a source whose only block is half as long weighs half a block
    assert quotas(np.array([0.5, 0.5]), np.array([100, 3]), np.array([8.0, 4.0])).tolist() == [1, 3] and quotas(np.array([0.5, 0.5]), np.array([0, 3])).tolist() == [0, 3]
    c = shard_counts(q, 10, 3)
    assert (c.sum(0) == q).all() and (c[:-1].sum(1) == 10).all()
    assert quotas(np.array([0.0]), np.array([5])).tolist() == [0] and shard_counts(np.zeros(2, int), 10, 1).shape == (0, 2)


def mix(spark, docs, targets, block=8):
    return Mixture(spark.createDataFrame([(*d, "", "") for d in docs], DOCS), spark.createDataFrame(targets, TARGETS), block_tokens=block)


def test_shares_caps_and_blocks(spark):
    docs = [(i, "word " * (3 + i % 40), "big" if i % 10 else "small") for i in range(400)]
    docs += docs[:5] + [(1000, None, "big"), (1001, "", "small"), (1002, "text", None), (1003, "text", "unlisted"), (1004, "a long text " * 2000, "big")]
    m = mix(spark, docs, [("big", 0.8, 1), ("small", 0.2, 3), ("nothing", 0.5, 2), (None, 0.1, 1), ("never", 0.1, 0)])
    sel = {r.doc_id: r for r in m.selection().collect()}
    caps = {"big": 1, "small": 3}
    assert sel and all(r.times_used <= caps[r.source] and 0 < r.tokens_drawn <= r.times_used * r.n_tokens for r in sel.values())
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["big"].share - 0.8) < 0.02 and abs(shares["small"].share - 0.2) < 0.02
    assert shares["nothing"].share == shares["never"].share == 0 and len(shares) == 4
    slots = m.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) == m.quota.sum()
    assert max(Counter((r.src, r.block, r.epoch) for r in slots).values()) == 1
    drawn = Counter((r.src, r.block) for r in slots)
    assert all(n <= list(m.targets)[s][2] for (s, _), n in drawn.items())


def test_same_seed_same_mixture(spark):
    docs = [(i, "word " * (3 + i % 40), "a") for i in range(50)]
    one, two = (sorted(map(tuple, mix(spark, d, [("a", 1.0, 2)]).selection().collect())) for d in (docs, docs[::-1]))
    assert one == two and len(one) == 50


def test_blocks_hold_the_tokens_of_their_documents(spark):
    docs = [(i, f"word {i} " * (1 + i % 9), "a" if i % 3 else "b") for i in range(60)] + [(60, "none " * 500, "b"), (1, "word 1 " * 2, "a"), (1, "other text", "a")]
    m = mix(spark, docs, [("a", 0.6, 2), ("b", 0.4, 1)])
    blocks = {(r.shard, r.slot): r for r in m.token_blocks().collect()}
    assert len(blocks) == m.slots.count() and set(blocks) == {(r.shard, r.slot) for r in m.slots.collect()}
    source = [s for s, _, _ in m.targets]
    size = {(source[i], k): min(8, n - 8 * k) for i, n in enumerate(m.tokens) for k in range(-(-n // 8))}
    assert all(len(r.ids) == size[r.source, r.block] for r in blocks.values())
    stream = {(r.source, r.block): r.ids for r in blocks.values()}
    known, placed = encoder(TOKENIZER), m.placed.collect()
    for r in placed:
        text = next(t for i, t, _ in docs if i == r.doc_id and len(known.encode([t])[0]) == r.n_tokens)
        got = [stream.get((r.source, k // 8), [None] * 8)[k % 8] for k in range(r.begin, r.begin + r.n_tokens)]
        assert all(a is None or a == b for a, b in zip(got, known.encode([text])[0])), r


def test_shards_are_drawn_apart():
    q = np.array([500, 37, 0, 63])
    c = shard_counts(q, 10, 4)
    for k in range(len(c)):
        row, first = shard_row(q, 10, k, 4)
        assert (row == c[k]).all() and (first == c[:k].sum(0)).all()
    assert abs(c[:, 0].mean() - 500 / 60) < 0.01 and c[:, 1].std() < 2


def test_nothing_to_draw(spark):
    assert mix(spark, [], [("a", 1.0, 2)]).selection().collect() == []
    assert mix(spark, [(1, "text", "a")], []).selection().collect() == []


def test_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(token_counts("t")).collect()] == [2, 0, 0]
