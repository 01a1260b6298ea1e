"""Symbols of languages without a grammar, line by line, in plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A name: letters, digits, underscores and hyphens.
NAME = r"([\p{L}\p{N}_-]+)"

#: Per language, in order: how a line begins, and the kind of what follows (fixed values).
RULES: dict[str, list[tuple[str, str]]] = {
    "kotlin": [("fun ", "function"), ("class ", "class"), ("data class ", "class"), ("object ", "class"), ("interface ", "interface"), ("enum class ", "enum")],
    "swift": [("func ", "function"), ("class ", "class"), ("struct ", "struct"), ("enum ", "enum"), ("protocol ", "interface"), ("extension ", "module")],
    "ruby": [("def self.", "function"), ("def ", "function"), ("class ", "class"), ("module ", "module")],
    "php": [("function ", "function"), ("class ", "class"), ("interface ", "interface"), ("trait ", "interface")],
    "shell": [("function ", "function")],
    "markdown": [("### ", "section"), ("## ", "section"), ("# ", "section")],
}
COMMENTS = ("//", "#", "/*", "*", "<!--")


#: What declares a symbol without such a beginning, with its name, and the symbol's kind.
OTHERWISE = {"shell": (rf"{NAME}\s*\(\)", "function"), "markdown": (r"#\S*\s+(\S+)", "section")}


def _pattern(language: str) -> str:
    """One pattern with groups for how a line begins, the name after that, and the name otherwise."""
    begins = "|".join(b.replace(".", r"\.") for b, _ in RULES[language])
    return rf"^(?:({begins})\s*{NAME}|{OTHERWISE.get(language, (r'(?!)()', ''))[0]})"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def scan_lines(files: DataFrame) -> DataFrame:
    """``file, pos, name, qualified_name, kind, line_start, line_end, col_no, signature`` of files ``path, language, text``.

    The name stands for the qualified name; a symbol is its line; nothing is
    referred to. Comment lines and lines that declare nothing are skipped.
    """
    known = files.where(F.col("language").isin(list(RULES)) & F.col("text").isNotNull())
    lines = known.select(F.col("path").alias("file"), "language", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "raw"))
    line = F.trim("raw")
    lines = lines.withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    line = F.col("line")
    comment = F.lit(False)
    for c in COMMENTS:
        comment = comment | line.startswith(c)
    lines = lines.where((line != "") & ((F.col("language") == "markdown") | ~comment))
    lines = lines.withColumn("pattern", _lookup({lang: _pattern(lang) for lang in RULES}, F.col("language")))
    lines = lines.select("file", "pos", "raw", "line", "language", *[F.expr(f"regexp_extract(line, pattern, {g})").alias(f"g{g}") for g in (1, 2, 3)])
    begun = _lookup({f"{lang}/{b}": k for lang, rules in RULES.items() for b, k in rules}, F.concat("language", F.lit("/"), "g1"))
    other = _lookup({lang: k for lang, (_, k) in OTHERWISE.items()}, F.col("language"))
    out = lines.select("file", "pos", "raw", "line", F.when(F.col("g2") != "", F.col("g2")).otherwise(F.regexp_replace("g3", "^#+", "")).alias("name"), F.when(F.col("g2") != "", begun).otherwise(other).alias("kind")).where("name <> ''")
    indent = F.octet_length(F.regexp_extract("raw", r"^(\s*)", 1))
    n = F.col("pos") + 1
    return out.select("file", "pos", "name", F.col("name").alias("qualified_name"), "kind", n.alias("line_start"), n.alias("line_end"), indent.alias("col_no"), F.col("line").alias("signature"))
