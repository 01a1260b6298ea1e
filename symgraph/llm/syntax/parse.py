"""From a file's text and extension to its first unrecoverable error."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from symgraph.llm.syntax import grammars, lexers
from symgraph.llm.syntax.tables import END, Parser, build

#: Extension (lower case) to language.
LANGUAGES = {"py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "c": "c", "h": "c"}
LEXERS: dict[str, Callable[[str], list[tuple]]] = {"python": lexers.python, "rust": lexers.rust, "go": lexers.go, "java": lexers.java, "typescript": lexers.typescript, "javascript": lexers.javascript, "c": lexers.c}
#: Languages in which a text without any token is no program.
NEVER_EMPTY = {"go"}


def _words(words) -> str:
    return " | ".join(f"'{w}'" for w in sorted(words))


def grammar(language: str) -> tuple[str, str]:
    """The grammar text of a language, and its start."""
    if language == "python":
        return grammars.PYTHON, "file"
    if language == "go":
        return grammars.GO, "file"
    if language == "c":
        return grammars.C, "file"
    if language == "java":
        return grammars.JAVA.replace("NAME '-' NAME", "NAME '-' 'sealed'"), "file"
    if language == "rust":
        words = _words(w for w in lexers.RUST_WORDS if w not in ("true", "false"))
        punct = _words("... ..= :: -> => .. == != <= >= && || <<= - + * / % & | ^ ! < > , : . ; = ? @ # $ ~".split())
        text = grammars.RUST.replace("WORD_LIST", words + " | 'true' | 'false' | '_'").replace("PUNCT_LIST", punct)
        return re.sub(r"file: .*\nlast: .*\n", "file: (inner | item)+ ;\n", text), "file"
    out = []
    for line in grammars.SCRIPT.splitlines():
        if line[:1] == ("-" if language == "typescript" else "%"):
            continue
        out.append(line[1:] if line[:1] in "-%" else line)
    text = "\n".join(out)
    soft = lexers.TS_SOFT if language == "typescript" else lexers.JS_SOFT
    text = text.replace("SOFT_LIST", _words(soft)).replace("KEYWORD_LIST", _words(lexers.JS_WORDS))
    rules = []
    for rule in re.split(r"(?<= ;)\n", text):
        if "@" in re.sub(r"'@'", "", rule):
            bare = rule.replace("'@'", "\0")
            rules += [bare.replace("@", "").replace("\0", "'@'"), bare.replace("@", "_s").replace("\0", "'@'")]
        else:
            rules.append(rule)
    return "\n".join(rules), "file"


@lru_cache(maxsize=16)
def tables(language: str):
    return build(*grammar(language))


def parser(language: str, made=None) -> Parser:
    return Parser(made or tables(language), ";" if language in ("javascript", "typescript") else None)


def first_error(text: str | None, language: str, p: Parser) -> int:
    """The line of the first unrecoverable error, 0 if the text is a program of the language. A null text is none; C must be one by every reading of its conditions."""
    if text is None:
        return 1
    for tokens in lexers.c_readings(text) if language == "c" else [LEXERS[language](text)]:
        if len(tokens) == 1:
            if language in NEVER_EMPTY:
                return 1
            continue
        at = p.run(tokens)
        if at >= 0:
            return tokens[at][1]
    return 0
