"""Symbols and references of source files.

Python is read with the interpreter's own parser. The other languages are read
by a scanner over tokens and braces: it knows where declarations begin and end
and which container they stand in, and takes names before an opening bracket
for calls. It is approximate where a grammar would be exact. Extractors are
plain functions by language; others may be registered.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.extract.lines import RULES, scan_lines
from symgraph.session import spread
from symgraph.sources.files import language

ROWS = (
    "file string, pos int, name string, qualified_name string, kind string, line_start int, line_end int, col_no int, signature string, visibility string, "
    "is_async boolean, is_static boolean, is_exported boolean, docstring string, byte_start int, byte_end int, refs array<string>, error string"
)


def row(name: str, kind: str, line: int, end: int, qualified: str | None = None, **more) -> dict:
    base = {"name": name, "qualified_name": qualified or name, "kind": kind, "line_start": line, "line_end": end, "col_no": 0, "signature": None, "visibility": "private", "is_async": False, "is_static": False, "is_exported": False, "docstring": None, "byte_start": 0, "byte_end": 0, "refs": []}
    return base | more


# ------------------------------------------------------------- Python


def _py_visibility(name: str) -> str:
    return "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") and not name.startswith("__") else "public"


def _py_calls(node: ast.AST) -> list[str]:
    out = set()
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            text = ast.unparse(n.func)
            if re.fullmatch(r"[\w.]+", text):
                out.add(text)
    return sorted(out)


def python(text: str) -> list[dict]:
    out: list[dict] = []
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)

    def at(n: ast.AST) -> dict:
        return {"col_no": n.col_offset, "byte_start": starts[n.lineno - 1] + n.col_offset, "byte_end": starts[n.end_lineno - 1] + n.end_col_offset}

    def visit(body: list[ast.stmt], owner: str | None, top: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                sig = f"def {n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in n.decorator_list)
                out.append(row(n.name, "method" if owner else "function", n.lineno, n.end_lineno, f"{owner}.{n.name}" if owner else n.name, signature=sig, visibility=_py_visibility(n.name), is_async=isinstance(n, ast.AsyncFunctionDef), is_static=static, is_exported=not n.name.startswith("_"), docstring=ast.get_docstring(n), refs=_py_calls(n), **at(n)))
                visit(n.body, None, False)
            elif isinstance(n, ast.ClassDef):
                out.append(row(n.name, "class", n.lineno, n.end_lineno, signature=f"class {n.name}", visibility=_py_visibility(n.name), is_exported=not n.name.startswith("_"), docstring=ast.get_docstring(n), refs=sorted({ast.unparse(b) for b in n.bases if re.fullmatch(r"[\w.]+", ast.unparse(b))}), **at(n)))
                visit(n.body, n.name, False)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out.append(row(a.name, "import", n.lineno, n.end_lineno, refs=[f"*as:{a.asname}" if a.asname else a.name], **at(n)))
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                out.append(row(module, "import", n.lineno, n.end_lineno, refs=sorted({a.asname or a.name for a in n.names}), **at(n)))
            elif top and isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        out.append(row(t.id, "constant" if t.id.isupper() else "variable", n.lineno, n.end_lineno, visibility=_py_visibility(t.id), is_exported=not t.id.startswith("_"), **at(n)))
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                visit(n.body, owner, top)
                visit(getattr(n, "orelse", []), owner, top)

    visit(ast.parse(text).body, None, True)
    return out


# ------------------------------------------------------------- languages with braces

_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.){2,}'(?!\w)|`(?:[^`\\]|\\.)*`")
_TOKEN = re.compile(r"[^\W\d]\w*|::|->|=>|\S")
#: What stands before a bracket without being called.
_NOT_CALLS = frozenset("if for while switch match return catch function fn func def new sizeof typeof super this await throw in of case else do try finally synchronized using lock foreach when where".split())

#: Keywords that no declaration can have as its name, where a pattern could take them for one.
_RESERVED = {
    "c": frozenset("if for while switch return else do sizeof".split()), "cpp": frozenset("if for while switch return else do sizeof catch try new delete throw".split()), "java": frozenset("if for while switch return else do catch try synchronized new throw".split()),
    "csharp": frozenset("if for foreach while switch return else do catch try lock using new throw".split()), "dart": frozenset("if for while switch return else do catch try throw".split()),
}

#: Per language, in order: a pattern at the start of a declaration and its kind; the name is group ``n``, an owner group ``o``.
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|override|virtual|sealed|readonly|native|synchronized|extern|inline|const|unsafe|partial|declare|factory|external|late|var|covariant|constexpr|explicit|friend|typename|unsigned|signed|pub(?:\([^)]*\))?)\s+)*"
_TYPE = r"(?:[\w:.]+(?:<[^;{}()]*>)?(?:\[\])*[\s*&?]+)+"
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [(rf"{_MODS}fn\s+(?P<n>\w+)", "function"), (rf"{_MODS}struct\s+(?P<n>\w+)", "struct"), (rf"{_MODS}enum\s+(?P<n>\w+)", "enum"), (rf"{_MODS}trait\s+(?P<n>\w+)", "interface"), (r"impl(?:<[^{;]*?>)?\s+(?:[^{;]*?\sfor\s+)?(?P<o>\w+)", "impl"), (rf"{_MODS}mod\s+(?P<n>\w+)", "module"), (rf"{_MODS}use\s+(?P<n>[^;]+)", "import"), (rf"{_MODS}(?:static|const)\s+(?:mut\s+)?(?P<n>\w+)\s*:", "constant"), (rf"{_MODS}type\s+(?P<n>\w+)", "type_alias")],
    "typescript": [(rf"{_MODS}function\s*\*?\s*(?P<n>\w+)", "function"), (rf"{_MODS}class\s+(?P<n>\w+)", "class"), (rf"{_MODS}interface\s+(?P<n>\w+)", "interface"), (rf"{_MODS}enum\s+(?P<n>\w+)", "enum"), (rf"{_MODS}type\s+(?P<n>\w+)[^=;]*=", "type_alias"), (rf"{_MODS}(?:const|let|var)\s+(?P<n>\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^;{{}}]*?\)|\w+)\s*(?::[^=;{{}}]+)?=>", "function"), (rf"{_MODS}(?:const|let|var)\s+(?P<n>\w+)\s*(?::[^=;]+)?=\s*(?:async\s+)?function\b", "function"), (r"import\b(?P<n>[^;\n]+)", "import"), (rf"{_MODS}(?:get\s+|set\s+)?(?P<n>[#\w]+)\s*(?:<[^(]*>)?\([^;{{}}]*\)\s*(?::[^{{;]+)?(?=\{{)", "method?")],
    "go": [(r"func\s+\(\s*\w*\s*\*?(?P<o>\w+)[^)]*\)\s*(?P<n>\w+)", "method"), (r"func\s+(?P<n>\w+)", "function"), (r"(?P<n>type|const|var|import)\s*\(", "group"), (r"type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b", "struct"), (r"type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b", "interface"), (r"type\s+(?P<n>\w+)", "type_alias"), (r"package\s+(?P<n>\w+)", "module"), (r"const\s+(?P<n>\w+)", "constant"), (r"var\s+(?P<n>\w+)", "variable"), (r"import\s+(?P<n>[^\n]+)", "import")],
    "java": [(rf"{_MODS}(?P<n>\w+)\s*\([^;{{}}]*\)\s*(?:throws[^{{;]*)?(?=\{{)", "constructor?"), (rf"{_MODS}(?:@\w+\s+)*{_MODS}(?:class|record)\s+(?P<n>\w+)", "class"), (rf"{_MODS}@?interface\s+(?P<n>\w+)", "interface"), (rf"{_MODS}enum\s+(?P<n>\w+)", "enum"), (r"package\s+(?P<n>[\w.]+)", "module"), (r"import\s+(?:static\s+)?(?P<n>[\w.*]+)", "import"), (rf"{_MODS}(?:<[^>]*>\s*)?{_TYPE}(?P<n>\w+)\s*\([^;{{}}]*\)\s*(?:throws[^{{;]*)?(?=[{{;])", "method?"), (rf"{_MODS}{_TYPE}(?P<n>\w+)\s*(?==[^=]|;)", "field?")],
    "c": [(r"typedef\s+(?P<k>struct|enum|union)\b\s*(?P<n>\w+)?\s*(?=\{)", "typedef"), (r"typedef\s[^;{]*?\(\s*\*\s*(?P<n>\w+)\s*\)[^;{]*;", "type_alias"), (r"typedef\s[^;{]*?(?P<n>\w+)\s*(?:\[[^;]*\]\s*)?;", "type_alias"), (r"struct\s+(?P<n>\w+)\s*(?=\{)", "struct"), (r"enum\s+(?P<n>\w+)\s*(?=\{)", "enum"), (r"#\s*include\s*(?P<n>[^\n]+)", "import"), (rf"{_MODS}{_TYPE}(?P<n>\w+)\s*\([^;{{}}]*\)\s*(?=[{{;])", "function")],
}
_TEMPLATE = r"(?:template\s*<[^{;]*?>\s*)?"
DECLARATIONS["cpp"] = [(rf"{_TEMPLATE}{_MODS}class\s+(?P<n>\w+)(?=[^;(){{]*\{{)", "class"), (rf"{_TEMPLATE}{_MODS}struct\s+(?P<n>\w+)(?=[^;(){{]*\{{)", "struct"), (r"enum\s+(?:class\s+|struct\s+)?(?P<n>\w+)(?=[^;(){]*\{)", "enum"), (r"(?:inline\s+)?namespace\s+(?P<n>[\w:]+)\s*(?=\{)", "module"), (r"using\s+(?P<n>[^;=]+);", "import"), (rf"{_TEMPLATE}{_MODS}(?:{_TYPE})?(?P<o>\w+)::(?P<n>~?\w+)\s*\([^;{{}}]*\)[^;{{}}]*(?=\{{)", "method"), (rf"{_TEMPLATE}{_MODS}(?P<n>~?\w+)\s*\([^;{{}}]*\)[^;{{}}]*(?=[{{;])", "constructor?"), *[x for x in DECLARATIONS["c"] if x[1] not in ("struct", "enum", "function")], (rf"{_TEMPLATE}{_MODS}{_TYPE}(?P<n>\w+)\s*\([^;{{}}]*\)[^;{{}}]*(?=[{{;])", "function"), (rf"{_MODS}{_TYPE}(?P<n>\w+)\s*(?:\[[^;\]]*\]\s*)?(?:=[^;]*)?;", "field?")]
DECLARATIONS["csharp"] = [(rf"{_MODS}(?P<n>\w+)\s*\([^;{{}}]*\)[^;{{}}]*(?=\{{)", "constructor?"), (r"using\s+(?P<n>[\w.]+)\s*;", "import"), (r"namespace\s+(?P<n>[\w.]+)", "module"), (rf"{_MODS}(?:class|record)\s+(?P<n>\w+)", "class"), (rf"{_MODS}interface\s+(?P<n>\w+)", "interface"), (rf"{_MODS}struct\s+(?P<n>\w+)", "struct"), (rf"{_MODS}enum\s+(?P<n>\w+)", "enum"), (rf"{_MODS}{_TYPE}(?P<n>\w+)\s*(?:<[^>]*>)?\([^;{{}}]*\)[^;{{}}]*(?=\{{|=>|;)", "method?"), (rf"{_MODS}{_TYPE}(?P<n>\w+)\s*(?=\{{|=[^=]|;)", "field?")]
DECLARATIONS["dart"] = [(r"import\s+(?P<n>[^;]+)", "import"), (r"library\s+(?P<n>[\w.]+)", "module"), (rf"{_MODS}class\s+(?P<n>\w+)", "class"), (r"mixin\s+(?P<n>\w+)", "interface"), (r"extension\s+(?P<n>\w+)", "type_alias"), (r"enum\s+(?P<n>\w+)", "enum"), (rf"{_MODS}{_TYPE}(?:get\s+|set\s+)?(?P<n>\w+)\s*(?:\([^;{{}}]*\))?\s*(?:async\*?\s*)?(?=\{{|=>)", "function"), (rf"{_MODS}(?P<n>\w+(?:\.\w+)?)\s*\([^;{{}}]*\)\s*(?=\{{|;|:)", "constructor?"), (rf"{_MODS}{_TYPE}(?P<n>\w+)\s*(?=[=;])", "variable")]
_COMPILED = {lang: [(re.compile(p), kind) for p, kind in rules] for lang, rules in DECLARATIONS.items()}
_OWNERS = frozenset(["class", "interface", "struct", "enum", "impl", "module", "type_alias"])
_DOTTED_DROPPED = frozenset(["typescript", "dart", "cpp"])


def _visibility(lang: str, text: str, name: str, owner: str | None, access: str | None) -> str:
    """``owner`` is the kind of what the declaration stands in, ``access`` the label that it stands under."""
    head = text.split(name)[0] if name in text else text
    if lang == "rust":
        return "internal" if re.search(r"pub\((?:crate|super)", head) else "public" if re.search(r"\bpub\b", head) else "private"
    if lang == "go":
        return "public" if name[:1].isupper() else "private"
    if lang == "dart":
        return "private" if name.startswith("_") else "public"
    if lang == "c":
        return "private" if re.search(r"\bstatic\b", head) else "public"
    if lang == "cpp":
        return access or ("private" if owner == "class" or (owner is None and re.search(r"\bstatic\b", head)) else "public")
    for v in ("public", "private", "protected", "internal"):
        if re.search(rf"\b{v}\b", head):
            return v
    if lang == "csharp":
        return "public" if owner == "interface" else "internal" if owner in (None, "module") else "private"
    return {"java": "internal", "typescript": "public"}.get(lang, "private")


def _calls(lang: str, text: str) -> list[str]:
    out = set()
    for m in re.finditer(r"((?:[^\W\d]\w*(?:::<[^>()]*>)?(?:\.|::|->))*[^\W\d]\w*)!?\s*\(", text):
        full = re.sub(r"::<[^>()]*>", "", m.group(1))
        before = text[max(0, m.start() - 12) : m.start()]
        if full in _NOT_CALLS or re.search(r"\b(?:fn|func|function|def|new)\s+$", before):
            continue
        if "." in full:
            first, _, rest = full.partition(".")
            if first in ("this", "super", "base") and "." not in rest and lang in ("typescript", "dart", "java", "csharp"):
                out.add(rest)
                continue
            if lang in _DOTTED_DROPPED:
                continue
        out.add(full)
    return sorted(out)


def _bindings(lang: str, text: str) -> tuple[str, list[str]]:
    """Module and bound names of an import."""
    if lang == "typescript":
        m = re.search(r"from\s*(['\"])(.*?)\1|^\s*(['\"])(.*?)\3", text)
        module = (m.group(2) or m.group(4)) if m else text.strip()
        head = text.split(" from ")[0]
        space = re.search(r"\*\s*as\s+(\w+)", head)
        names = [x.split(" as ")[-1].strip() for x in re.findall(r"\{([^}]*)\}", head)[:1] for x in x.split(",") if x.strip()]
        default = re.match(r"\s*(?:type\s+)?(\w+)\s*(?:,|$)", head)
        return module, sorted({*names, *([f"*as:{space.group(1)}"] if space else []), *([default.group(1)] if default and " from " in text else [])})
    if lang == "go":
        path = re.search(r"[\"`]([^\"`]+)[\"`]", text)
        return (path.group(1) if path else text.strip()), []
    if lang == "dart":
        path = re.search(r"['\"]([^'\"]+)['\"]", text)
        return (path.group(1) if path else text.strip()), []
    # names that other languages import are not bound by file: no rule says which of them a call means
    return text.strip().strip(";<>\"'").strip(), []


_STOPS = re.compile(r"[()\[\]{};]")
_LABEL = re.compile(r"(public|private|protected)\s*:(?!:)")
_END = re.compile(r"[()\[\]{};\n]")


def _opening(plain: str, at: int) -> int:
    """Where the body of a declaration opens, or -1 if it ends before; brackets of parameters and types are passed over."""
    level = 0
    for m in _STOPS.finditer(plain, at):
        c = m.group()
        if not level and c in "{;})]":
            return m.start() if c == "{" else -1
        level += (c in "([") - (c in ")]")
    return -1


def _closing(plain: str, opened: int) -> int:
    """Behind the brace that closes the one at ``opened``, or the end of the text."""
    level = 0
    for m in re.compile(r"[{}]").finditer(plain, opened):
        level += 1 if m.group() == "{" else -1
        if not level:
            return m.end()
    return len(plain)


def _expression_end(plain: str, at: int) -> int:
    """Where an expression that begins at ``at`` ends: at a semicolon, a bracket that closes what is around it, or a line's end."""
    level = 0
    for m in _END.finditer(plain, at):
        c = m.group()
        if c in "([{":
            level += 1
        elif c in ")]}":
            level -= 1
            if level < 0:
                return m.start()
        elif not level and (c == ";" or plain[at : m.start()].strip()):
            return m.start()
    return len(plain)


_SPECS = {"type": "type_alias", "const": "constant", "var": "variable", "import": "import"}


def braces(lang: str) -> Callable[[str], list[dict]]:
    rules, reserved = _COMPILED[lang], _RESERVED.get(lang, frozenset())

    def extract(text: str) -> list[dict]:
        # literals and comments become blanks of the same length; imports are read from the text itself
        plain = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        out: list[dict] = []
        lines = [0, *(m.end() for m in re.finditer("\n", text))]
        line_of = lambda i: bisect_right(lines, i)
        #: name, depth, kind and access label of what a declaration stands in
        owners: list[list] = []
        depth, at, n, fresh = 0, 0, len(plain), True

        def add(name: str, kind: str, begin: int, end: int, holder: str | None, head: str, **more) -> None:
            owner = owners[-1] if owners and depth == owners[-1][1] else None
            sep = "::" if lang == "cpp" else "."
            seen = _visibility(lang, head, name, owner and owner[2], owner and owner[3])
            exported = bool(re.search(r"\b(?:pub|export|public)\b", head)) or (lang == "go" and name[:1].isupper())
            out.append(row(name, kind, line_of(begin), line_of(max(end - 1, begin)), f"{holder}{sep}{name}" if holder else name, visibility=seen, is_async=bool(re.search(r"\basync\b", head)), is_static=bool(re.search(r"\bstatic\b", head)), is_exported=exported, col_no=begin - lines[line_of(begin) - 1], byte_start=begin, byte_end=end, **more))

        def group(word: str, begin: int) -> int:
            """The lines in round brackets after ``type``, ``const``, ``var`` or ``import``, each a declaration; behind the brackets."""
            end, level, start = begin, 0, True
            while end < n:
                c = (text if word == "import" else plain)[end]
                if level == 0 and c == ")":
                    return end + 1
                if level == 0 and start and not c.isspace():
                    stop = min((x for x in (plain.find("\n", end), plain.find(";", end)) if x >= 0), default=n)
                    if word == "import":
                        module, names = _bindings(lang, text[end:stop])
                        out.append(row(module, "import", line_of(end), line_of(end), refs=names, byte_start=end, byte_end=stop))
                    elif m := re.compile(r"(\w+)(?:\[[^\]]*\])?\s*(struct\b|interface\b)?").match(plain, end):
                        opened = plain.find("{", m.end()) if m.group(2) and word == "type" else -1
                        add(m.group(1), m.group(2) if opened >= 0 else _SPECS[word], end, _closing(plain, opened) if opened >= 0 else stop, None, "")
                    start = False
                level += (c in "([{") - (c in ")]}")
                start = start or (level == 0 and c in "\n;")
                end += 1
            return n

        while at < n:
            c = plain[at]
            if c.isspace():
                at += 1
                continue
            if c == "}":
                depth -= 1
                while owners and owners[-1][1] > depth:
                    owners.pop()
                fresh, at = True, at + 1
                continue
            if c in ";{":
                depth += c == "{"
                fresh, at = True, at + 1
                continue
            owner = owners[-1] if owners else None
            inside = owner is not None and depth == owner[1]
            if (fresh or (at and plain[at - 1] == "\n")) and (depth == 0 or inside):
                if lang == "cpp" and inside and (label := _LABEL.match(plain, at)):
                    owner[3], at = label.group(1), label.end()
                    continue
                for pattern, kind in rules:
                    m = pattern.match(plain, at) if kind != "import" else pattern.match(text, at)
                    if not m or (kind.endswith("?") and not inside):
                        continue
                    kind = kind.rstrip("?")
                    name = m.groupdict().get("n") or m.groupdict().get("o")
                    if name in reserved or (kind == "constructor" and owner and name.split(".")[0].lstrip("~") != owner[0]):
                        continue
                    if kind == "import":
                        module, names = _bindings(lang, name)
                        out.append(row(module, "import", line_of(at), line_of(m.end() - 1), refs=names, byte_start=at, byte_end=m.end()))
                        at = m.end()
                        break
                    if kind == "group":
                        at = group(name, m.end())
                        break
                    if kind == "typedef":
                        end = _closing(plain, m.end())
                        alias = re.compile(r"\s*\**\s*(\w+)[^;{}]*;").match(plain, end)
                        if name:
                            add(name, "enum" if m.group("k") == "enum" else "struct", at, end, None, "")
                        if alias:
                            add(alias.group(1), "type_alias", at, alias.end(), None, "", signature=f"typedef {m.group('k')} {alias.group(1)}")
                        at = alias.end() if alias else end
                        break
                    opened = -1 if plain[m.end() - 1] == ";" or (kind == "module" and lang in ("java", "go")) else _opening(plain, m.end())
                    body = opened >= 0
                    end = _closing(plain, opened) if body else m.end()
                    code = plain[opened:end] if body else ""
                    if lang == "typescript" and plain[m.end() - 2 : m.end()] == "=>" and not plain[m.end() :].lstrip().startswith("{"):
                        body, end = False, _expression_end(plain, m.end())
                        code = plain[m.end() : end]
                    elif lang == "go" and kind in _SPECS.values():
                        body, end = False, _expression_end(plain, m.end())
                    holder = m.groupdict().get("o") or (owner[0] if inside and owner[2] != "module" else None)
                    if kind in ("function", "constructor") and lang == "cpp" or kind == "function":
                        kind = "method" if holder and lang != "go" else "function"
                    if kind != "impl":
                        signature = re.sub(r"\s+", " ", text[at : opened if body else m.end()]).strip().rstrip("{;").strip()
                        refs = _calls(lang, code) if kind in ("function", "method", "constructor") else []
                        add(name, kind, at, end, holder, plain[at : m.end()], signature=signature, refs=refs)
                    if body and kind in _OWNERS:
                        owners.append([name, depth + 1, kind, None])
                        depth += 1
                        at = opened + 1
                    elif body and plain[end - 1] != "}":
                        at = opened + 1  # never closed, as by a conflict of merging: what follows is still looked at
                    else:
                        at = end
                    break
                else:
                    fresh, at = False, _TOKEN.match(plain, at).end()
                    continue
                fresh = True
                continue
            fresh, at = False, _TOKEN.match(plain, at).end()
        return out

    return extract


EXTRACTORS: dict[str, Callable[[str], list[dict]]] = {"python": python, **{lang: braces(lang) for lang in DECLARATIONS}}


def register(lang: str, extractor: Callable[[str], list[dict]]) -> None:
    """Give a language another extractor."""
    EXTRACTORS[lang] = extractor


def extract_text(text: str | None, lang: str, file: str) -> tuple[list[dict], str | None]:
    """Rows of one file, and what went wrong."""
    if not text:
        return [], None if file.endswith("__init__.py") else "empty file"
    try:
        return EXTRACTORS[lang](text.replace("\r\n", "\n")), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}"[:200]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ROWS.split(", ")]
    for b in batches:
        out = []
        for path, lang, text in zip(b["path"], b["language"], b["text"]):
            rows, error = extract_text(text, lang, path)
            if error:
                rows = [{"error": error}]
            out += [dict.fromkeys(names) | {"file": path, "pos": i} | r for i, r in enumerate(rows)]
        yield pd.DataFrame(out, columns=names).astype({k: "Int32" for k in ("pos", "line_start", "line_end", "col_no", "byte_start", "byte_end")} | {k: "boolean" for k in ("is_async", "is_static", "is_exported")})


def extract_nodes(files: DataFrame) -> DataFrame:
    """Node rows (without ``ord`` and ``id``) of files ``path, ext, text``; a file that fails gives one row with ``error``.

    Files of languages that are not supported give nothing.
    """
    known = files.withColumn("language", language(F.col("ext"))).where("language IS NOT NULL").select("path", "language", "text")
    by_lines = scan_lines(known).select(
        "file", "pos", "name", "qualified_name", "kind", "line_start", "line_end", "col_no", "signature", F.lit("private").alias("visibility"), *[F.lit(False).alias(x) for x in ("is_async", "is_static", "is_exported")],
        F.lit(None).cast("string").alias("docstring"), F.lit(0).alias("byte_start"), F.lit(0).alias("byte_end"), F.array().cast("array<string>").alias("refs"), F.lit(None).cast("string").alias("error"),
    )
    return spread(known.where(~F.col("language").isin(list(RULES)))).mapInPandas(_extract, ROWS).unionByName(by_lines)
