"""Documents with template residue, filler, error messages or demands for scripts in place of content.

Texts are read in passage windows: the sentences of a line, where a quotation
belongs whole to its sentence. Labelled exemplars are retrieved for a window
through an inverted index over their heaviest terms and compared by TF-IDF
containment, both ways: the share of an exemplar's weight that is found in the
window, and the share of the window's weight that the exemplars found cover. A
window that is covered highly stands for residue; a sentence that merely quotes
or mentions such words is covered little.

The brackets of template parts are windows of their own. The syntax of template
engines is a term by its shape; what other brackets hold is compared, by the
same containment, with exemplars of field names and of demands to fill in. A
part does not count in a sentence whose other words speak of placeholders.

Weights come from the document frequencies of all terms of the corpus. They no
longer rise below a frequency of ``RARE``, so only the terms above it, of which
there are at most (distinct terms of a document on average) / ``RARE``, are
brought to the tasks.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import residue_exemplars as X
from symgraph.session import spread

#: Least share of an exemplar found in a window, and of a window covered by exemplars.
RECALL, COVER = 0.6, 0.6
#: The same for filler whose words come in any order: its cover alone counts.
WORDS_COVER = 0.75
#: A part does not count if words about placeholders, two at least, have this share of the weight of the rest of its sentence.
MENTION_SHARE = 0.2
#: A sentence with so many words outside its quotations only mentions what it quotes.
LEAST_OUTSIDE = 4
#: Filler in free order must weigh so many times as much as the rarest word: less may be words of another language.
LEAST_FILLER = 1.5
#: Words in a smaller share of the documents, which no exemplar has either, are left out when filler in free order is weighed.
FAMILIAR = 0.02
#: A window of one word, repeated so often, is filler.
REPEATED = 3
#: Rarer terms weigh no more than one in this share of all documents.
RARE = 0.005
#: Letters of a word that count: endings are cut off.
STEM = 6

#: The kinds of exemplars that windows of prose are compared with; ``words`` is filler in free order.
PROSE = ("error", "script", "filler", "words")

_CJK = "぀-ヿ㐀-鿿가-힣"
_WORD = re.compile(rf"[{_CJK}]+|[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_MARKS = re.compile("[\u0300-\u036f]+")
_OCR = str.maketrans("015", "ols")
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isalpha() and d[0].isascii() and c.islower())
_BARE = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)

#: Brackets of template engines, by which a part with a name inside is known whatever the name; and date masks.
_NAME = r"\s*[#/^>&!$=*-]{0,2}\s*(?=[\w .:'\-]*?[^\W\d_]{2})\w[\w .:'\-]*?"
_ENGINE = [("{{ name }}", r"\{\{", r"\}\}"), ("{% name %}", r"\{%", r"%\}"), ("<% name %>", r"<%", r"%>"), ("[% name %]", r"\[%", r"%\]"), ("<? name ?>", r"<\?(?:=|php)?", r"\?>"), ("${ name }", r"\$\{", r"\}"), ("#{ name }", r"#\{", r"\}"),
    ("{$ name }", r"\{\$", r"\}"), ("[[ name ]]", r"\[\[", r"\]\]"), ("<< name >>", r"<<", r">>"), ("@@ name @@", r"@@", r"@@"), ("%% name %%", r"%%", r"%%"), ("« MERGEFIELD name »", r"«\s*MERGEFIELD\b", r"»")]
_PART = re.compile(
    "|".join(f"(?P<e{i}>{a}{_NAME}\\s*{b})" for i, (_, a, b) in enumerate(_ENGINE))
    + r"|(?P<mask>\b[DMYJTAX]{2,4}(?P<sep>[./-])[DMYJTAX]{2,4}(?P=sep)[DMYJTAX]{2,4}\b)"
    + r"|(?P<open>[\[<{|$«%]|__|\*\*)(?P<inner>[^\n\[\]<>{}|$«»%]+?)(?:[\]>}|$»%]|__|\*\*)"
    + r"|[(〔【](?P<round>[^\n()〔〕【】]+)[)〕】]",
    re.I,
)
#: What every part has somewhere; figures alone in brackets are none.
_TRIGGER = re.compile(r"[{<$@%|«]|[\[(〔【](?!\d*[\])〕】])|\*\*|__|[DMYJTAXdmyjtax]{2}[./-]")
_ELEMENT = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]*)?/?>")
_CAMEL = re.compile(r"(?<=[^\W\d_])_?\d+$|(?<=[a-z])(?=[A-Z])|_")


def plain(text: str) -> str:
    """Lower case without accents; Hangul stays whole."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", text))).lower()


def plain_terms(text: str) -> list[str]:
    """:func:`terms` of a text that is plain already."""
    if text.isascii():
        words = _ASCII_WORD.findall(text)
        out = [t[:STEM] for t in words if t.isalpha()]
        if len(out) < len(words):
            out += [t.translate(_OCR)[:STEM] for t in words if not t.isalpha() and not t.isdigit()]
        return out
    out = []
    for t in _WORD.findall(text):
        if "぀" <= t[0] <= "힣":
            out += [t[i : i + 2] for i in range(len(t) - 1)] or [t]
        elif t.isalpha():
            out.append(t[:STEM])
        elif not t.isdigit():
            out.append(t.translate(_OCR)[:STEM])
    return out


def terms(text: str) -> list[str]:
    """Words without accents and endings, figures left out; pairs of characters of Chinese, Japanese and Korean runs."""
    return plain_terms(plain(text))


def part_terms(inner: str) -> list[str]:
    """The words of a template part; a number that stands alone is a word that no exemplar has."""
    words = [w for piece in inner.split() for w in _CAMEL.sub(" ", piece).split()]
    return [t for w in words for t in (["#"] if w.isdigit() else terms(w))]


_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』')
_QUOTES = re.compile('["“„«「『]')
_END = re.compile(rf"[.!?](?=\s|[{_CJK}])|[。！？]")


def windows(text: str) -> Iterator[str]:
    """The sentences of each line; a quotation is not split, nor is an abbreviation's or number's dot without a blank after it."""
    for line in text.splitlines():
        if not line.strip():
            continue
        held = [(m.start(), m.end()) for m in _QUOTED.finditer(line)] if _QUOTES.search(line) else []
        begin = 0
        for m in _END.finditer(line):
            if any(a < m.start() < b - 1 for a, b in held):
                continue
            yield line[begin : m.end()]
            begin = m.end()
        if line[begin:].strip():
            yield line[begin:]


Family = tuple[str, str]


def families() -> list[Family]:
    """Kind and pattern of every family of exemplars."""
    groups = {"error": X.ERROR, "script": X.SCRIPT, "filler": X.FILLER, "words": X.FILLER_WORDS, "name": X.NAMES, "demand": X.DEMANDS, "shape": X.SHAPES, "repeat": X.REPEATS}
    return [(kind, f) for kind, fs in groups.items() for f in fs]


@lru_cache(maxsize=1)
def _mention() -> frozenset[str]:
    return frozenset(terms(X.MENTION))


class Exemplars:
    """The inverted index of the labelled exemplars, with weights from the corpus."""

    def __init__(self, df: dict[str, int], n: int, keep: Callable[[Family], bool] = lambda f: True):
        """``df`` holds the document frequencies of the terms of ``RARE`` and above; ``keep`` chooses families, for held-out tests."""
        least = RARE * n
        self.heaviest = max(math.log((n + 1) / (least + 0.5)), 0.05)
        self.weight = {t: max(math.log((n + 1) / (max(k, least) + 0.5)), 0.05) for t, k in df.items()}
        self.familiar = frozenset(t for t, k in df.items() if k >= FAMILIAR * n)
        self.kinds: list[str] = []
        self.terms: list[frozenset[str]] = []
        self.total: list[float] = []
        self.index: dict[str, list[int]] = defaultdict(list)
        known: dict[tuple[str, frozenset[str]], None] = {}
        for kind, family in filter(keep, families()):
            for text in [family] if kind in ("words", "shape", "repeat") else X.expand(family):
                ts = frozenset([text]) if kind == "repeat" else frozenset([text.replace("-", "/").replace(".", "/").upper() if "{" not in text and "name" not in text else text]) if kind == "shape" else frozenset(part_terms(text) if kind in ("name", "demand") else terms(text))
                if ts:
                    known[kind, ts] = None
        for i, (kind, ts) in enumerate(known):
            self.kinds.append(kind)
            self.terms.append(ts)
            self.total.append(sum(map(self.weigh, ts)))
            # an exemplar of which a share is found has one of its heaviest terms found: those that hold more than the rest may miss
            seen = 0.0
            for t in sorted(ts, key=lambda t: (-self.weigh(t), t)):
                self.index[t].append(i)
                seen += self.weigh(t)
                if kind != "words" and seen > (1 - RECALL) * self.total[i] + 1e-9:
                    break
        #: the terms of all exemplars of a kind: a window of which they do not cover enough needs no retrieval
        self.vocabulary = {kind: frozenset(t for k, ts in known if k == kind for t in ts) for kind in dict.fromkeys(k for k, _ in known)}
        self.known = frozenset().union(*self.vocabulary.values())
        self.first = frozenset(t for t, ids in self.index.items() if any(self.kinds[i] in PROSE for i in ids))

    def weigh(self, term: str) -> float:
        return self.weight.get(term, self.heaviest)

    def contained(self, tf: dict[str, int], kinds: tuple[str, ...]) -> str | None:
        """The kind of the exemplars that are found in a window and cover it, if any."""
        weigh, rare, weights, all_, known, familiar = self.weight.get, self.heaviest, {}, 0.0, 0.0, 0.0
        for t, n in tf.items():
            w = weights[t] = n * weigh(t, rare)
            all_ += w
            if t in self.known:
                known += w
            elif t in self.familiar:
                familiar += w
        if known < COVER * all_ and known < WORDS_COVER * (known + familiar):
            return None
        # filler is full of words that no one knows: they speak neither for it nor against
        whole = {k: known + familiar if k == "words" else all_ for k in kinds}
        kinds = tuple(k for k in kinds if k in self.vocabulary and sum(w for t, w in weights.items() if t in self.vocabulary[k]) >= (WORDS_COVER if k == "words" else COVER) * whole[k])
        if not kinds:
            return None
        met: dict[str, set[str]] = {}
        for i in {i for t in tf for i in self.index.get(t, ()) if self.kinds[i] in kinds}:
            ts = self.terms[i]
            found = [t for t in ts if t in tf]
            if self.kinds[i] == "words" or sum(map(self.weigh, found)) >= RECALL * self.total[i]:
                met.setdefault(self.kinds[i], set()).update(found)
        best: tuple[float, str] | None = None
        for kind, found in met.items():
            weight = sum(weights[t] for t in found)
            cover = weight / whole[kind]
            if cover >= WORDS_COVER and weight >= LEAST_FILLER * self.heaviest if kind == "words" else cover >= COVER:
                best = max(best or (cover, kind), (cover, kind))
        return best[1] if best else None

    def is_part(self, m: re.Match, text: str) -> bool:
        """Whether brackets are an unfilled template part."""
        got = m.groupdict()
        if got["mask"]:
            return self.contained({re.sub(r"[.-]", "/", got["mask"]).upper(): 1}, ("shape",)) is not None
        for i, (shape, *_) in enumerate(_ENGINE):
            if got[f"e{i}"]:
                return self.contained({shape: 1}, ("shape",)) is not None
        inner = got["inner"] or got["round"]
        if got["open"] == "<" and re.search(rf"</\s*{re.escape(inner)}\s*>", text, re.I):
            return False
        words = part_terms(inner)
        return bool(words) and self.contained(Counter(words), ("demand",) if got["round"] else ("name", "demand")) is not None

    def has_part(self, window: str, text: str) -> bool:
        """Whether a window of ``text`` has an unfilled template part, and is not about placeholders itself."""
        parts = [m for m in _PART.finditer(window) if self.is_part(m, text)]
        if not parts:
            return False
        rest = window
        for m in reversed(parts):
            rest = rest[: m.start()] + " " + rest[m.end() :]
        tf = Counter(terms(rest))
        spoken = _mention().intersection(tf)
        return len(spoken) < 2 or sum(map(self.weigh, spoken)) < MENTION_SHARE * sum(map(self.weigh, tf))

    def prose(self, window: str, words: list[str] | None = None) -> str | None:
        """The kind of residue that the words of a window show, or None; the window is plain text."""
        words = plain_terms(window) if words is None else words
        distinct = set(words)
        if len(words) >= REPEATED and len(distinct) == 1:
            return "filler" if self.contained(Counter([X.REPEATS[0]]), ("repeat",)) else None
        if self.first.isdisjoint(distinct):
            return None
        if _QUOTES.search(window) or "<" in window:
            words = plain_terms(_ELEMENT.sub(" ", outside(window)))
        got = self.contained(Counter(words), PROSE)
        return "filler" if got == "words" else got

    def kind(self, window: str, text: str | None = None) -> str | None:
        """The kind of residue in a window of ``text``, or None."""
        said = outside(window)
        if _TRIGGER.search(said) and self.has_part(said, text or window):
            return "template"
        return self.prose(plain(window))

    def residue(self, text: str) -> Iterator[tuple[str, str]]:
        """Kind and window of each residue of a text."""
        if _TRIGGER.search(text):
            for w in windows(text):
                if _TRIGGER.search(w) and _TRIGGER.search(said := outside(w)) and self.has_part(said, text):
                    yield "template", w
        first = self.first
        for w in windows(plain(text)):
            words = plain_terms(w)
            if not first.isdisjoint(words) or len(words) != len(set(words)):
                kind = self.prose(w, words)
                if kind:
                    yield kind, w


def outside(window: str) -> str:
    """What a sentence that quotes says itself, if that is enough words; else the sentence."""
    if not _QUOTES.search(window):
        return window
    rest = _QUOTED.sub(" ", window)
    return rest if LEAST_OUTSIDE <= len(terms(rest)) < len(terms(window)) else window


def document_frequencies(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Of the column ``text``: the terms in at least ``RARE`` of the documents with their number, and the number of documents."""
    t = F.translate(F.lower("text"), _ACCENTED, _BARE)
    words = F.regexp_extract_all(t, F.lit(rf"([a-z]{{1,{STEM}}})[a-z]*"), F.lit(1))
    pairs = F.regexp_extract_all(t, F.lit(rf"(?=([{_CJK}]{{2}}))"), F.lit(1))
    pairs = F.when(F.regexp_like(t, F.lit(f"[{_CJK}]")), pairs).otherwise(F.array().cast("array<string>"))
    n = texts.count()
    counts = texts.where("text IS NOT NULL").select(F.explode(F.array_distinct(F.concat(words, pairs))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return {r["term"]: r["df"] for r in counts.where(F.col("df") >= RARE * n).collect()}, n  # bounded as said above


def _scan(index: Exemplars):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                kinds: dict[str, list] = {}
                for kind, w in index.residue(text or ""):
                    kinds.setdefault(kind, [0, w.strip()[:200]])[0] += 1
                out += [(doc_id, kind, n, first) for kind, (n, first) in kinds.items()]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "windows", "example"])

    return run


def find_residue(documents: DataFrame) -> DataFrame:
    """``doc_id, kind, windows, example``: per document with residue and kind of it, how many windows and the first one.

    Kinds are ``template``, ``filler``, ``error`` and ``script``. Whole texts are
    read. Null, empty and blank texts have no residue. Repeated rows of a
    document come out as often as they come in. Two passes over the texts: one
    counts the document frequencies of all terms, one scans.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    d = spread(documents.select("doc_id", "text"))
    index = d.sparkSession.sparkContext.broadcast(Exemplars(*document_frequencies(d.select("text"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _scan(index.value)(batches)

    return d.mapInPandas(run, f"doc_id {kind}, kind string, windows long, example string")
