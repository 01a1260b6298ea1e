import random

import pytest

from symgraph.llm.bpe import Encoder, byte_letters, encode_corpus
from symgraph.llm.tokens import TOKENIZER

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(4)
    any_of = lambda n, top: "".join(chr(c) for c in (rng.randrange(1, top) for _ in range(n)) if not 0xD800 <= c < 0xE000)
    return [
        "", " ", "\n\n  \t", "it's 'S we'll I'd", "<|endoftext|>", "naïve façade", "汉字" * 3000, "한국어 텍스트", "aaaaaaa aaaa" * 50, "a" * 20_001, "ab" * 9999,
        " " * 3000 + "x", "  \u0085\x1c", "😀👩‍👩‍👧", "꟝\U00032000\U000105c1", any_of(2000, 0x3000), any_of(2000, 0x110000), "=-" * 500,
    ]


def test_same_ids_as_the_public_library(public):
    e, texts = Encoder(TOKENIZER), odd_texts()
    for text, ids in zip(texts, e.encode(texts)):
        assert ids == public(text), text[:20]
    assert e.encode([None, "", "again"]) == [[], [], public("again")]


def test_ids_decode_to_the_text():
    e, texts = Encoder(TOKENIZER), [t for t in odd_texts() if t]
    import json

    vocab, letters = json.load(open(TOKENIZER))["model"]["vocab"], byte_letters()
    tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
    assert [b"".join(tokens[i] for i in ids).decode() for ids in e.encode(texts)] == texts


def test_corpus(spark, public):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", "y"), (None, "no id", "")]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == [(0, public("no id")), (1, public("hello world")), (1, public("hello world")), (2, []), (3, [])]
    assert encode_corpus(spark.createDataFrame([], "doc_id int, text string")).collect() == []
