"""Source files that are no programs of their language.

Every file is read by the table-driven parser of its language as one stream of
tokens from the first to the last; the line of the first token that no
continuation of the text before it allows is reported. The tables are built
once from the bundled grammars and broadcast; their size depends on the
grammars alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.syntax import parse
from symgraph.session import spread

PARSED = "path string, repo string, language string, error_line int"


def language_of(ext: Column, path: Column) -> Column:
    """The language by extension in any letter case; without one by the path's; null if unknown."""
    e = F.lower(F.trim(F.when(F.length(F.trim(ext)) > 0, ext).otherwise(F.regexp_extract(path, r"\.([^./\\]+)$", 1))))
    e = F.regexp_replace(e, r"^\.", "")
    return F.create_map(*[F.lit(x) for kv in parse.LANGUAGES.items() for x in kv])[e]


def parse_files(files: DataFrame) -> DataFrame:
    """``path, repo, language, error_line`` of every row with a known language; 0 for a valid program.

    ``files`` has ``path, repo, ext, text``. Whole texts are parsed. A null text
    is no program; an empty one is, except in languages that demand a clause
    (Go). Repeated rows come out as often as they come in.
    """
    made = files.sparkSession.sparkContext.broadcast({lang: parse.tables(lang) for lang in parse.LEXERS})
    parsers: dict[str, parse.Parser] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = []
            for lang, text in zip(b["language"], b["text"]):
                if lang not in parsers:
                    parsers[lang] = parse.parser(lang, made.value[lang])
                lines.append(parse.first_error(text, lang, parsers[lang]))
            yield pd.DataFrame({"path": b["path"], "repo": b["repo"], "language": b["language"], "error_line": pd.Series(lines, dtype="int32", index=b.index)})

    known = files.select("path", "repo", language_of(F.col("ext"), F.col("path")).alias("language"), "text").where("language IS NOT NULL")
    return spread(known).mapInPandas(run, PARSED)


def invalid_files(files: DataFrame) -> DataFrame:
    """``path, repo, language, error_line`` of the files that do not parse, each path once (with its first error)."""
    bad = parse_files(files).where("error_line > 0")
    return bad.groupBy("path", "repo", "language").agg(F.min("error_line").alias("error_line"))


def invalid_rates(files: DataFrame) -> DataFrame:
    """``repo, language, files, invalid, rate``; a path that is listed several times counts once."""
    each = parse_files(files).groupBy("repo", "language", "path").agg(F.max((F.col("error_line") > 0).cast("int")).alias("bad"))
    out = each.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("invalid"))
    return out.withColumn("rate", F.col("invalid") / F.col("files"))
