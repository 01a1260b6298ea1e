"""Byte-level BPE encoding of whole texts by recursive DuckDB queries.

Each partition splits its texts into the words of the tokenizer's pattern and
encodes every distinct word once. The words' tokens are rows by position; a
recursive query joins neighbouring tokens with the merge table and contracts
each word's pair of least rank, leftmost first, until no pair can be merged;
an ordered aggregation gives the ids. All occurrences of the pair in a word
are contracted in one step: what a merge creates is only part of pairs of
higher rank, so this equals contracting them one after the other.

Words are cut beforehand wherever two neighbouring bytes occur next to each
other in no token at all. No merge can cross such a place, so the ids stay the
same, and long runs without blanks (as in Chinese text) fall into short pieces.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from symgraph.llm.tokens import TOKENIZER
from symgraph.session import spread

#: How the tokenizer family splits text into words (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces kept by a worker; the cache is emptied beyond that.
CACHE_PIECES = 400_000

ENCODE = """
WITH RECURSIVE t(step, w, pos, tok) AS (
    SELECT 0, w, pos, tok FROM pieces
    UNION ALL
    (WITH pairs AS (
        SELECT step, w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM t),
    ranked AS (
        SELECT p.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY p.w) AS best
        FROM pairs p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt),
    numbered AS (
        SELECT *, coalesce(rank = best, false) AS hit, row_number() OVER (PARTITION BY w ORDER BY pos) AS n
        FROM ranked WHERE best IS NOT NULL),
    runs AS (
        SELECT *, n - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS run FROM numbered),
    taken AS (
        SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY pos) % 2 = 1 AS take FROM runs),
    kept AS (
        SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY pos) AS eaten FROM taken)
    SELECT step + 1, w, pos, CASE WHEN take THEN merged ELSE tok END FROM kept WHERE NOT eaten)
),
last AS (SELECT w, max(step) AS step FROM t GROUP BY w)
SELECT t.w, list(t.tok ORDER BY t.pos) AS ids FROM t JOIN last USING (w, step) GROUP BY t.w
"""


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def unassigned() -> str:
    """Ranges of the letters and digits that the regex module knows but the tokenizer library's older Unicode tables do not."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    whole = ByteLevel(add_prefix_space=False).pre_tokenize_str

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    late = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and len(whole(f"a{c}")) > 1 and len(whole(f"1{c}")) > 1]
    ends = [i for i in range(len(late)) if i + 1 == len(late) or late[i + 1] != late[i] + 1]
    return "".join(f"\\U{late[i]:08x}-\\U{late[j]:08x}" for i, j in zip([0, *[e + 1 for e in ends]], ends))


class Encoder:
    """A vocabulary file, its merge table in an own in-memory database, and the pieces met so far."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.base = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.base[b] = vocab[letter]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        table = pa.table({"a": [vocab[a] for a, _ in merges], "b": [vocab[b] for _, b in merges], "rank": range(len(merges)), "merged": [vocab[a + b] for a, b in merges]})
        self.joined = np.zeros((256, 256), bool)
        for a, b in merges:
            token = bytes(letters[c] for c in a + b)
            self.joined[list(token[:-1]), list(token[1:])] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        self.db.register("merges_in", table)
        self.db.execute("CREATE TABLE merges AS SELECT a::INTEGER AS a, b::INTEGER AS b, rank::INTEGER AS rank, merged::INTEGER AS merged FROM merges_in")
        self.common = regex.compile(PATTERN).findall
        late = unassigned()
        self.late = regex.compile(f"[{late}]").search if late else lambda t: None
        self.careful = regex.compile("(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\s@@\p{N}]").replace(r"\p{L}", f"[\\p{{L}}--[{late}]]").replace(r"@@\p{N}", f"[[\\p{{L}}\\p{{N}}]--[{late}]]").replace(r"?\p{N}", f"?[\\p{{N}}--[{late}]]")).findall if late else self.common
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[bytes, list[int]] = {}

    def split(self, text: str) -> list[str]:
        return (self.common if text.isascii() or not self.late(text) else self.careful)(text)

    def cut(self, word: bytes) -> list[bytes]:
        if len(word) < 2:
            return [word]
        b = np.frombuffer(word, np.uint8)
        at = (np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])]

    def encode_pieces(self, pieces: list[bytes]) -> None:
        """Rows of at most some 200,000 positions at a time; pieces of one byte need no query."""
        todo, size = [], 0
        for p in pieces:
            if len(p) == 1:
                self.pieces[p] = [int(self.base[p[0]])]
                continue
            todo.append(p)
            size += len(p)
            if size > 200_000:
                self._query(todo)
                todo, size = [], 0
        if todo:
            self._query(todo)

    def _query(self, pieces: list[bytes]) -> None:
        lengths = np.array([len(p) for p in pieces])
        w = np.repeat(np.arange(len(pieces)), lengths)
        pos = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tok = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        self.db.register("pieces", pa.table({"w": w.astype(np.int32), "pos": pos.astype(np.int32), "tok": tok.astype(np.int32)}))
        for i, ids in self.db.execute(ENCODE).fetchall():
            self.pieces[pieces[i]] = ids
        self.db.unregister("pieces")

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of which are encoded afterwards."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.pieces) > CACHE_PIECES or len(self.words) > CACHE_PIECES:
            self.words, self.pieces = {}, {}
        new = {w for words in split for w in words if w not in self.words}
        cuts = {w: self.cut(w.encode("utf-8")) for w in new}
        self.encode_pieces(list({p for ps in cuts.values() for p in ps if p not in self.pieces}))
        for w, ps in cuts.items():
            self.words[w] = self.pieces[ps[0]] if len(ps) == 1 else [i for p in ps for i in self.pieces[p]]
        return split

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        split, known = self.learn(texts), self.words
        return [[i for w in words for i in known[w]] for words in split]

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        split, known = self.learn(texts), self.words
        return [sum([len(known[w]) for w in words]) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Texts are handed to the encoder in groups of about this many characters.
GROUP_CHARS = 2_000_000


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x for g in groups(batch.column("text").to_pylist()) for x in encoder(path).encode(g)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, without special tokens.

    Null and empty texts get an empty list. The strings of special tokens in a
    text are ordinary text. Repeated rows come out as often as they come in.
    ``path`` is the vocabulary file of a byte-level BPE tokenizer.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text")
    return spread(rows).mapInArrow(_encode(path), f"doc_id {kind}, ids array<int>")
