"""Files that no one wrote by hand: generated, minified, third-party and data-only ones.

Linear support-vector classifiers, one per kind, are trained on hashed
character n-grams of the text, hashed n-grams of the comments it begins with,
and path components, of a bounded sample of the files themselves. Labels come
from giveaways (usual phrases in header comments, names and folders, extreme
shapes). The phrases that give an answer away are masked before anything is
hashed, so the classifiers learn what such files look like beside them.

The repositories of the sample fall into parts of about equal size. The
classifier that judges a part was trained on the other parts only, and its
threshold chosen among these (trained on one, scored on another), so neither is
learned from the repositories it is measured on. Giveaways are known of a part
of the positives only: files of the training parts that are found without one
count as positive in the next round. What is reported is measured against the
giveaways alone.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.parsing import language_of
from symgraph.llm.syntax import parse
from symgraph.session import checkpoint, spread

#: About how many files are used for training, chosen by the hash of their path, and their most characters.
TRAIN_FILES = 8_000
TRAIN_CHARS = 50_000
#: Bits of the hashes of n-grams of the text, n-grams of the header, and path components.
BITS = (18, 16, 14)
NGRAMS = (3, 5)
PARTS = 3
ROUNDS = 3
EPOCHS = 6
#: How far above the median a file without a giveaway must score to be found, in robust standard deviations.
OUTLYING = 5.0
COST, POSITIVE_COST = 0.5, 3.0
KINDS = ("generated", "minified", "third_party", "data")

#: Phrases that generators are known to write, among them the marks of Go, .NET, Facebook's tools, protocol buffers, Thrift, Cargo and Entity Framework.
GENERATED_HEADER = re.compile(
    r"\b(?:auto(?:matically)?|machine)[- ]?(?:generated|created|produced|written)\b|\b(?:code |file |source )?(?:was |is )?generated (?:automatically |code )?(?:by|from|with|using)\b|@generated\b|</?auto-?generated[^>\n]*>"
    r"|\bdo not (?:hand[- ])?(?:edit|modify|change)(?: (?:manually|by hand|this file|directly))?|\b(?:should|must) not be (?:edited|modified|changed)(?: (?:manually|by hand|directly))?|\bnot intended for manual editing|\b(?:changes|edits|modifications)\b[^.\n]{0,30}\b(?:will|may) be (?:lost|overwritten)(?: if [^.\n]*)?|\bregenerated?\b",
    re.I,
)
#: Phrases of the notices of common open licences, and of files that say where they are from.
LIBRARY_HEADER = re.compile(
    r"\bthird[- ]party\b|\b(?:copied|vendored|imported|taken) from\b|\bdistributed under the\b[^.\n]*|\b(?:re)?licen[cs]ed under\b[^.\n]*|\bpermission is hereby granted\b[^.\n]*|\bredistribution and use in source and binary forms\b|\bsee (?:the )?(?:file |accompanying )?(?:licen[cs]e|copying|notice)\b[^.\n]*|\bthe software is provided\b[^.\n]*|\bgnu (?:lesser |affero )?general public licen[cs]e\b|@licen[cs]e\b|\(c\)[^\n]{0,60}\bcontributors\b",
    re.I,
)
LIBRARY_FOLDERS = frozenset("node_modules bower_components vendor vendored third_party third-party thirdparty 3rdparty deps external externals site-packages jspm_packages".split())
GENERATED_NAME = re.compile(r"(?:\.pb\.(?:go|cc|h)|\.pb-c\.[ch]|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts)|\.g\.(?:java|dart|cs|ts)|outerclass(?:\.g)?\.java|\.generated\.\w+|_generated\.\w+|\.designer\.\w+|\.gen\.\w+)$", re.I)
MINIFIED_NAME = re.compile(r"(?:[.-]min|\.bundle|\.chunk|\.[0-9a-f]{6,32})\.(?:js|mjs|css)$", re.I)

_COMMENT = re.compile(r"\s*(?:/\*[\s\S]*?\*/|(?:(?://|--|;)[^\n]*|#(?![!\[]|\s*(?:include|define|if|ifdef|ifndef|endif|pragma)\b)[^\n]*)(?:\n|$))")
_BANG = re.compile(r"^#!(?!\[)[^\n]*\n")
_QUOTED = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`")


def split_header(text: str) -> tuple[str, str]:
    """The comments a file begins with, and the rest."""
    m = _BANG.match(text)
    begin = at = m.end() if m else 0
    while m := _COMMENT.match(text, at):
        if m.end() == at:
            break
        at = m.end()
    return text[begin:at], text[at:]


def words_share(text: str) -> float:
    """The share of a text's visible characters that belong to words of code, not to numbers, long strings and punctuation."""
    seen = len(re.sub(r"\s", "", text))
    bare = re.sub(r"\"[^\"\n]{60,}\"|'[^'\n]{60,}'", "", text)
    bare = re.sub(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d_.]*)\w*", "", bare)
    return len(re.sub(r"[^A-Za-z]", "", bare)) / seen if seen else 1.0


def giveaways(path: str, text: str) -> set[str]:
    """The kinds that a file's header, name, folders or shape give away."""
    out = set()
    header, body = split_header(text)
    said = _QUOTED.sub(" ", header)
    parts = path.replace("\\", "/").split("/")
    if GENERATED_HEADER.search(said) or GENERATED_NAME.search(path):
        out.add("generated")
    if LIBRARY_HEADER.search(said) or LIBRARY_FOLDERS & {p.lower() for p in parts[1:-1]}:
        out.add("third_party")
    longest = max((len(x) for x in body.splitlines()), default=0)
    blank = sum(c.isspace() for c in body) / max(len(body), 1)
    if MINIFIED_NAME.search(path) or (longest > 300 and blank < 0.06 and words_share(body) > 0.2):
        out.add("minified")
    if len(body) > 120 and words_share(body) < 0.15:
        out.add("data")
    return out


def masked(header: str) -> str:
    """A header without the phrases that give an answer away; figures are alike."""
    return re.sub(r"\d+", "0", LIBRARY_HEADER.sub("\x01", GENERATED_HEADER.sub("\x01", header))).lower()


_POWERS = {n: np.array([pow(1_000_003, n - 1 - i, 2**64) for i in range(n)], np.uint64) for n in NGRAMS}


_RUN = re.compile(r"[A-Za-z0-9+/=_-]{40,}")


def _grams(text: str, bits: int) -> np.ndarray:
    """Hashes of the n-grams that occur; blanks are alike, and long runs without any break count by their length only."""
    plain = _RUN.sub(lambda m: "\x01" * (len(m.group()) // 8), text)
    b = np.frombuffer(re.sub(r"[^\S\n]+", " ", plain).encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    there = np.zeros(1 << bits, bool)
    for n in NGRAMS:
        if len(b) >= n:
            h = np.zeros(len(b) - n + 1, np.uint64)
            for i in range(n):
                h += b[i : len(b) - n + 1 + i] * _POWERS[n][i]
            there[((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)] = True
    return np.flatnonzero(there).astype(np.int32)


def path_words(path: str) -> list[str]:
    """The folders below the repository, and what follows the name's first dot or last underscore."""
    parts = path.replace("\\", "/").lower().split("/")
    name = re.sub(r"[0-9a-f]{6,}", "#", parts[-1])
    return [f"/{p}" for p in parts[1:-1]] + [f".{name.partition('.')[2]}", f"_{re.split(r'[_-]', name)[-1]}"]


Features = tuple[np.ndarray, np.ndarray]
_FIRST = (0, 1 << BITS[0], (1 << BITS[0]) + (1 << BITS[1]))
SIZE = sum(1 << b for b in BITS)


def feature_index(path: str, text: str) -> np.ndarray:
    """The features that a file has, ascending: n-grams of its text, of its masked header, and path components."""
    header, body = split_header(text)
    named = np.array([zlib.crc32(w.encode()) & ((1 << BITS[2]) - 1) for w in path_words(path)], np.int32)
    groups = (_grams(body, BITS[0]), _grams(masked(header), BITS[1]), np.unique(named))
    return np.concatenate([g + np.int32(first) for g, first in zip(groups, _FIRST)])


def weighted(index: np.ndarray) -> Features:
    """Index and value; the values of each group of features have length 1."""
    cuts = np.searchsorted(index, [*_FIRST, SIZE])
    return index, np.concatenate([np.full(b - a, 1 / np.sqrt(max(b - a, 1)), np.float32) for a, b in zip(cuts[:-1], cuts[1:])])


def train(rows: list[Features], labels: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support-vector classifier, by dual coordinate descent."""
    w, bias, rng = np.zeros(size, np.float32), 0.0, np.random.default_rng(seed)
    y = np.where(labels, 1.0, -1.0).tolist()
    top = np.where(labels, POSITIVE_COST, COST).tolist()
    alpha = [0.0] * len(rows)
    norm = [float(v @ v) + 1.0 for _, v in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            index, value = rows[i]
            g = y[i] * (float(w[index] @ value) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[index] += np.float32(step) * value
                bias += step
                alpha[i] = new
    return w, bias


def scored(model: tuple[np.ndarray, float], rows: list[Features]) -> np.ndarray:
    return np.array([float(model[0][i] @ v) + model[1] for i, v in rows])


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Where scores of files without a giveaway stand out: ``OUTLYING`` robust deviations above their median, from -0.9 to 0; 0 without any giveaway.

    Giveaways are known of a part of the positives only, so no cut that is best
    against them would do.
    """
    if not labels.any() or labels.all():
        return 0.0
    rest = scores[~labels]
    middle = np.median(rest)
    spread_ = 1.4826 * np.median(np.abs(rest - middle))
    return float(min(max(middle + OUTLYING * spread_, -0.9), 0.0))


def parts_of(repos: list[str]) -> dict[str, int]:
    """A part for each repository: the largest first, each to the part with fewest files so far."""
    size, out = [0] * PARTS, {}
    for repo, n in sorted(Counter(repos).items(), key=lambda x: (-x[1], x[0])):
        out[repo] = min(range(PARTS), key=lambda k: (size[k], k))
        size[out[repo]] += n
    return out


Fitted = list[tuple[np.ndarray, float, float]]


def fit_kind(rows: list[Features], labels: np.ndarray, part: np.ndarray) -> tuple[Fitted, tuple[int, int, int, float, float]]:
    """For each part: weights, bias and threshold by the other parts; and how the parts' files are judged by them, against the labels: files, labelled, found, precision, recall."""
    fitted, found = [], np.zeros(len(rows), bool)
    for k in range(PARTS):
        others, y = [np.flatnonzero(part == j) for j in range(PARTS) if j != k], labels.copy()
        at = np.concatenate(others)
        for _ in range(ROUNDS):
            scores = np.zeros(len(rows))
            for held in others:  # each of the other parts by what the rest of them teach
                rest = np.concatenate([o for o in others if o is not held])
                scores[held] = scored(train([rows[i] for i in rest], y[rest], SIZE), [rows[i] for i in held])
            cut = best_threshold(scores[at], y[at])
            y[at] |= scores[at] > cut  # a file without a giveaway that is found this way is a positive example from now on
        w, b = train([rows[i] for i in at], y[at], SIZE)
        fitted.append((w, b, cut))
        own = np.flatnonzero(part == k)
        found[own] = scored((w, b), [rows[i] for i in own]) > cut
    right, said, true = int((found & labels).sum()), int(found.sum()), int(labels.sum())
    return fitted, (len(rows), true, said, right / said if said else 0.0, right / true if true else 0.0)


class Classifiers:
    """Weights, bias and threshold by kind and part, the parts of the repositories, and how each kind did on repositories held out (against the giveaways)."""

    def __init__(self, models: dict[str, Fitted], parts: dict[str, int], report: list[tuple]):
        self.models, self.parts, self.report = models, parts, report

    def kinds(self, path: str, repo: str | None, text: str) -> list[str]:
        """The kinds a file is, the surest first. A repository that no classifier has seen is judged by any of them."""
        index, value = weighted(feature_index(path, text))
        part = self.parts.get(repo or "", zlib.crc32((repo or "").encode()) % PARTS)
        got = []
        for kind, fitted in self.models.items():
            w, b, cut = fitted[part]
            score = float(w[index] @ value) + b - cut
            if score > 0:
                got.append((-score, kind))
        return [k for _, k in sorted(got)]


def fit_classifiers(files: DataFrame, train_files: int = TRAIN_FILES) -> Classifiers:
    """Trained on about ``train_files`` files of at most ``TRAIN_CHARS`` characters, a task per kind.

    The files are those whose path's hash is below a bound, so no text leaves
    the executors: features are made where a file lies, and laid together by
    kind. The driver gets the weights.
    """
    usable = files.where("path IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= TRAIN_CHARS)
    n = usable.count()
    steps = 1 << 30
    bound = min(steps, -(-train_files * steps // max(n, 1)))
    sample = usable.select("path", F.coalesce("repo", F.lit("")).alias("repo"), "text").where(F.pmod(F.xxhash64("path"), F.lit(steps)) < bound)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, r, sum(1 << KINDS.index(k) for k in giveaways(p, t)), feature_index(p, t)) for p, r, t in zip(b["path"], b["repo"], b["text"])]
            yield pd.DataFrame(rows, columns=["path", "repo", "labels", "features"])

    rows = checkpoint(spread(sample).mapInPandas(featured, "path string, repo string, labels int, features array<int>"))
    parts = parts_of([r["repo"] for r in rows.select("repo").collect()])  # of the sample

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        kind = int(b["kind"].iloc[0])
        b = b.sort_values("path", kind="stable")
        feats = [weighted(np.asarray(f, np.int32)) for f in b["features"]]
        labels = (b["labels"].to_numpy() >> kind & 1).astype(bool)
        fitted, report = fit_kind(feats, labels, np.array([parts[r] for r in b["repo"]], int))
        return pd.DataFrame({"kind": [kind], "fitted": [pickle.dumps((fitted, report))]})

    every = rows.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))]))).repartition(len(KINDS) * 4, "kind")
    fitted = {r["kind"]: pickle.loads(r["fitted"]) for r in every.groupBy("kind").applyInPandas(fit, "kind int, fitted binary").collect()}  # noqa: S301 - our own
    return Classifiers({k: fitted[i][0] for i, k in enumerate(KINDS) if i in fitted}, parts, [(k, *fitted[i][1]) for i, k in enumerate(KINDS) if i in fitted])


def not_hand_written(files: DataFrame, train_files: int = TRAIN_FILES) -> DataFrame:
    """``path, kind, kinds``: the files that a program generated or minified, that are copies of a library, or that hold data only.

    ``files`` has ``path, repo, ext, text``. ``kind`` is the surest one. Files
    that are no valid program of their language are left out, as are null paths
    and null or blank texts. A path that is listed several times comes out
    once. Whole texts are read.
    """
    sc = files.sparkSession.sparkContext
    fitted = sc.broadcast(fit_classifiers(files, train_files))  # 17 MB whatever the files
    made = sc.broadcast({lang: parse.tables(lang) for lang in parse.LEXERS})
    parsers: dict[str, parse.Parser] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = fitted.value
        for b in batches:
            out = []
            for path, repo, lang, text in zip(b["path"], b["repo"], b["language"], b["text"]):
                kinds = judge.kinds(path, repo, text)
                if kinds and lang:
                    if lang not in parsers:
                        parsers[lang] = parse.parser(lang, made.value[lang])
                    if parse.first_error(text, lang, parsers[lang]):
                        continue
                if kinds:
                    out.append((path, kinds[0], ",".join(kinds)))
            yield pd.DataFrame(out, columns=["path", "kind", "kinds"])

    known = files.where("path IS NOT NULL AND length(trim(text)) > 0").select("path", "repo", language_of(F.col("ext"), F.col("path")).alias("language"), "text")
    found = spread(known).mapInPandas(run, "path string, kind string, kinds string")
    return found.groupBy("path").agg(F.min("kind").alias("kind"), F.min("kinds").alias("kinds"))
