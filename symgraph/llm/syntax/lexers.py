"""Token streams of source texts. A token is ``(kinds, line, after a line break)``; what cannot be a token is ``ERROR``."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

END = "$end"


class Lines:
    def __init__(self, text: str):
        self.starts = [0, *[m.end() for m in re.finditer(r"\n", text)]]

    def at(self, pos: int) -> int:
        return bisect_right(self.starts, pos)


def normal(text: str) -> str:
    """One kind of line end, and no byte-order mark."""
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


# ---------------------------------------------------------------- Python

PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PY_SOFT = frozenset(["match", "case", "type"])
_PY = re.compile(
    r"(?P<name>[^\W\d]\w*)"
    r"|(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|==|<=|>=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|>>|<<|[-+*/%@&|^~<>()\[\]{},:.;=])"
)
_PY_STRING = re.compile(r"([rRbBuUfFtT]{0,2})('''|\"\"\"|'|\")")
_PY_AUG = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


def _py_string(text: str, pos: int, quote: str, formatted: bool) -> int:
    """Where a string that opens before ``pos`` ends, or -1."""
    n, long = len(text), len(quote) == 3
    while pos < n:
        c = text[pos]
        if c == "\\":
            pos += 2
        elif text.startswith(quote, pos):
            return pos + len(quote)
        elif c == "\n" and not long:
            return -1
        elif formatted and c == "{":
            if text.startswith("{{", pos):
                pos += 2
                continue
            depth, pos = 1, pos + 1
            while pos < n and depth:
                c = text[pos]
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= 1
                elif c in "\"'":
                    m = _PY_STRING.match(text, pos)
                    pos = _py_string(text, m.end(), m.group(2), False)
                    if pos < 0:
                        return -1
                    continue
                elif c == "\n" and not long:
                    return -1
                pos += 1
            if depth:
                return -1
        else:
            pos += 1
    return -1


def python(text: str) -> list[tuple]:
    text = normal(text)
    if text and text[-1] != "\n":
        text += "\n"
    lines, out, n = Lines(text), [], len(text)
    pos, depth, indents, begin = 0, [], [(0, 0)], True

    def add(kinds, at: int) -> None:
        out.append((kinds, lines.at(at), False))

    while pos < n:
        if begin and not depth:
            col = alt = 0
            at = pos
            while pos < n and text[pos] in " \t\f":
                if text[pos] == "\t":
                    col, alt = (col // 8 + 1) * 8, alt + 1
                elif text[pos] == "\f":
                    col = alt = 0
                else:
                    col, alt = col + 1, alt + 1
                pos += 1
            if pos < n and text[pos] == "#":
                pos = text.find("\n", pos)
            if pos >= n:
                break
            if text[pos] == "\n":
                pos += 1
                continue
            if text[pos] == "\\" and text.startswith("\\\n", pos) and not text[pos + 2 :].strip():
                pos = n
                break
            top, top_alt = indents[-1]
            if col == top:
                if alt != top_alt:
                    add("ERROR", at)
            elif col > top:
                if alt <= top_alt:
                    add("ERROR", at)
                indents.append((col, alt))
                add("INDENT", at)
            else:
                while indents[-1][0] > col:
                    indents.pop()
                    add("DEDENT", at)
                if indents[-1] != (col, alt):
                    add("ERROR", at)
            begin = False
        c = text[pos]
        if c in " \t\f":
            pos += 1
        elif c == "#":
            pos = text.find("\n", pos)
        elif c == "\n":
            if not depth:
                add("NEWLINE", pos)
                begin = True
            pos += 1
        elif c == "\\" and text.startswith("\\\n", pos):
            pos += 2
            if pos >= n:
                add("ERROR", n - 1)
        elif m := _PY_STRING.match(text, pos):
            prefix = m.group(1).lower()
            if prefix and ("".join(sorted(prefix)) not in ("b", "br", "f", "fr", "r", "u", "t", "rt")):
                add("ERROR", pos)
                break
            end = _py_string(text, m.end(), m.group(2), "f" in prefix or "t" in prefix)
            if end < 0:
                add("ERROR", pos)
                break
            add("BYTES" if "b" in prefix else "STRING", pos)
            pos = end
        elif m := _PY.match(text, pos):
            value, kind = m.group(), m.lastgroup
            if kind == "name":
                add(value if value in PY_WORDS else ("NAME", value) if value in PY_SOFT else "NAME", pos)
            elif kind == "num":
                end = m.end()
                tail = re.compile(r"\w*").match(text, end).group()
                bad = (tail and tail not in ("and", "or", "if", "else", "in", "is", "for", "not")) or re.fullmatch(r"0+[1-9]\d*", value)
                add("ERROR" if bad else "NUMBER", pos)
            else:
                if value in "([{":
                    depth.append(value)
                elif value in ")]}" and (not depth or depth.pop() + value not in ("()", "[]", "{}")):
                    add("ERROR", pos)
                add("AUG" if value in _PY_AUG else value, pos)
            pos = m.end()
        else:
            add("ERROR", pos)
            break
    if depth:
        add("ERROR", n - 1)
    if not begin:
        add("NEWLINE", n - 1)
    out.extend(("DEDENT", lines.at(n - 1), False) for _ in indents[1:])
    out.append((END, lines.at(max(n - 1, 0)), True))
    return out


# ---------------------------------------------------------------- languages with braces


def _scan(text: str, pattern: re.Pattern, classify) -> list[tuple]:
    """Tokens by one pattern with groups ``skip``, ``bad`` and those that ``classify(group, value, out)`` knows."""
    lines, out, pos, n, fresh = Lines(text), [], 0, len(text), True
    match = pattern.match
    while pos < n:
        m = match(text, pos)
        if not m or m.end() == pos:
            out.append(("ERROR", lines.at(pos), fresh))
            break
        kind = m.lastgroup
        if kind == "skip":
            if "\n" in m.group():
                fresh = True
        else:
            out.append((classify(kind, m.group()), lines.at(pos), fresh))
            fresh = False
            if kind == "bad":
                break
        pos = m.end()
    out.append((END, lines.at(max(n - 1, 0)), True))
    return out


_C_NUM = r"(?:0[xX][0-9a-fA-F']*\.?[0-9a-fA-F']*(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*)?\.\d[\d']*(?:[eE][+-]?\d+)?|\d[\d']*\.?(?:[eE][+-]?\d+)?)[uUlLfFdDzZ]*(?!\w)"
C_WORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while "
    "_Alignas _Alignof _Atomic _Bool _Generic _Noreturn _Static_assert _Thread_local alignas alignof bool static_assert thread_local typeof constexpr nullptr".split()
)
C_ALIASES = {"__inline": "inline", "__inline__": "inline", "__const": "const", "__volatile__": "volatile", "__volatile": "volatile", "__restrict": "restrict", "__restrict__": "restrict", "__signed__": "signed", "__typeof__": "typeof", "__attribute__": "__attribute__", "__attribute": "__attribute__", "__asm__": "asm", "__asm": "asm", "asm": "asm", "__extension__": "__extension__"}
_C = re.compile(
    r"(?P<skip>\s+|//(?:[^\\\n]|\\[\s\S])*|/\*[\s\S]*?\*/|\\\n)"
    r"|(?P<string>(?:u8|[uUL])?\"(?:[^\"\\\n]|\\[\s\S])*\")|(?P<char>(?:u8|[uUL])?'(?:[^'\\\n]|\\[\s\S])+')"
    rf"|(?P<num>{_C_NUM})|(?P<name>[^\W\d]\w*|\$\w*)"
    r"|(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[-+*/%&|^~!<>()\[\]{},:.;=?])|(?P<bad>[\s\S])"
)
_C_ASSIGN = frozenset("+= -= *= /= %= &= |= ^= <<= >>=".split())


def _c_kind(kind: str, value: str):
    if kind == "name":
        value = C_ALIASES.get(value, value)
        return value if value in C_WORDS or value in ("__attribute__", "asm", "__extension__") else "NAME"
    if kind == "op":
        return "ASSIGN" if value in _C_ASSIGN else value
    return {"string": "STRING", "char": "CHAR", "num": "NUMBER"}.get(kind, "ERROR")


_DIRECTIVE = re.compile(r"^[ \t]*(?:#|%:)[ \t]*(\w*)((?:[^\n\\]|\\[\s\S])*)", re.M)


def _directives(text: str) -> tuple[list[tuple[str, tuple]], list[tuple[str, int]], int]:
    """The text without preprocessor lines, in pieces with the branches ``(condition, position)`` they stand in; per condition its wording and the branch to be read unless another is asked for; where a condition is not closed or opened, or -1."""
    plain = re.compile(r"//(?:[^\\\n]|\\[\s\S])*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|^[ \t]*(?:#|%:)(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*", re.M)
    out, pos, stack, conditions = [], 0, [], []
    for m in plain.finditer(text):
        if m.group().lstrip()[:1] not in ("#", "%"):
            continue
        out += [(text[pos : m.start()], tuple(stack)), ("\n" * m.group().count("\n"), ())]
        pos = m.end()
        word = (_DIRECTIVE.match(m.group()) or [None, ""])[1]
        if word in ("if", "ifdef", "ifndef"):
            zero = word == "if" and re.match(r"\s*(?:#|%:)\s*if\s+0\s*(?://.*|/\*.*)?$", m.group())
            stack.append((len(conditions), 0))
            conditions.append((f"0 {len(conditions)}", 1) if zero else (" ".join(m.group().split()), 0))
        elif word in ("elif", "else", "elifdef", "elifndef"):
            if not stack:
                return out, conditions, m.start()
            condition, branch = stack.pop()
            stack.append((condition, branch + 1))
        elif word == "endif":
            if not stack:
                return out, conditions, m.start()
            stack.pop()
        elif word and word not in ("include", "include_next", "define", "undef", "line", "error", "warning", "pragma", "import", "ident", "embed") and not word.isdigit():
            return out, conditions, m.start()
    out.append((text[pos:], tuple(stack)))
    return out, conditions, len(text) if stack else -1


def _readings(pieces: list[tuple[str, tuple]], conditions: list[tuple[str, int]]) -> Iterator[str]:
    """The text by the first branch of each condition, then by others until each branch has been read once. Conditions of one wording go the same way."""
    asked: dict[str, int] = {}
    left = dict.fromkeys(at for _, at in pieces if at)
    while True:
        way = [asked.get(wording, first) for wording, first in conditions]
        yield "".join(piece if all(way[c] == k for c, k in at) else re.sub(r"[^\n]", " ", piece) for piece, at in pieces)
        left = [at for at in left if not all(way[c] == k for c, k in at)]
        asked = {}
        for at in left:
            need = dict(asked)
            if all(need.setdefault(conditions[c][0], k) == k and (k or not conditions[c][1]) for c, k in at):
                asked = need
        if not asked:  # what is left stands below "#if 0" or contradicts itself
            return


def c(text: str) -> list[tuple]:
    return next(c_readings(text))


def c_readings(text: str) -> Iterator[list[tuple]]:
    """The tokens by each reading of the preprocessor's conditions."""
    text = normal(text)
    pieces, conditions, wrong = _directives(text)
    if wrong >= 0:
        yield [("ERROR", Lines(text).at(min(wrong, len(text) - 1)), True), (END, 1, True)]
        return
    for kept in _readings(pieces, conditions):
        yield _scan(kept, _C, _c_kind)


JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private "
    "protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
JAVA_SOFT = frozenset("record sealed permits yield var when module open opens exports requires uses provides with to transitive".split())
_JAVA = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/)"
    r"|(?P<string>\"\"\"[ \t\f]*\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n]|\\[^\n])*\"|\"\"(?!\"))|(?P<char>'(?:[^'\\\n]|\\[^\n]+?)')"
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w))"
    r"|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<op>\.\.\.|<<=|->|::|\+\+|--|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^~!<>()\[\]{},:.;=?@])|(?P<bad>[\s\S])"
)


def _java_kind(kind: str, value: str):
    if kind == "name":
        return value if value in JAVA_WORDS else ("NAME", value) if value in JAVA_SOFT else "NAME"
    if kind == "op":
        return "ASSIGN" if value in _C_ASSIGN else value
    return {"string": "STRING", "char": "CHAR", "num": "NUMBER"}.get(kind, "ERROR")


def java(text: str) -> list[tuple]:
    return _scan(normal(text).removesuffix("\x1a"), _JAVA, _java_kind)


GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO = re.compile(
    r"(?P<skip>[ \t\f]+|//[^\n]*|/\*[\s\S]*?\*/|\n)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`)|(?P<char>'(?:[^'\\\n]|\\[^\n]+?)')"
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)i?(?!\w))"
    r"|(?P<name>[^\W\d]\w*)|(?P<op>\.\.\.|<<=|>>=|&\^=|<-|:=|\+\+|--|<<|>>|&\^|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~!<>()\[\]{},:.;=])|(?P<bad>[\s\S])"
)
_GO_ENDS = frozenset(["NAME", "NUMBER", "CHAR", "STRING", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_GO_BINARY = frozenset("|| && == != < <= > >= + - | ^ / % << >> & &^".split())


def go(text: str) -> list[tuple]:
    text = normal(text)
    lines, out, pos, n = Lines(text), [], 0, len(text)
    match = _GO.match
    while pos < n:
        m = match(text, pos)
        kind, value = m.lastgroup, m.group()
        if kind == "skip":
            if ("\n" in value) and out and out[-1][0] in _GO_ENDS:
                out.append((";", lines.at(pos), False))
        elif kind == "bad":
            out.append(("ERROR", lines.at(pos), False))
            break
        else:
            if kind == "name":
                k = value if value in GO_WORDS else "NAME"
            elif kind == "op":
                k = "ASSIGN" if value in _C_ASSIGN or value == "&^=" else value
            else:
                k = {"string": "STRING", "char": "CHAR", "num": "NUMBER"}[kind]
            out.append((k, lines.at(pos), False))
        pos = m.end()
    if out and out[-1][0] in _GO_ENDS:
        out.append((";", lines.at(n), False))
    out.append((END, lines.at(max(n - 1, 0)), True))
    return out


RUST_WORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()
)
RUST_SOFT = frozenset(["union", "auto", "default", "macro_rules", "raw", "safe"])
_RUST = re.compile(
    r"(?P<skip>\s+|//[^\n]*)"
    r"|(?P<rawstring>(?:b|c)?r(?P<hashes>#*)\"[\s\S]*?\"(?P=hashes))"
    r"|(?P<string>[bc]?\"(?:[^\"\\]|\\[\s\S])*\")|(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[^\n]))')|(?P<life>'[^\W\d]\w*)"
    r"|(?P<num>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![._A-Za-z])[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?(?!\w))"
    r"|(?P<name>r#[^\W\d]\w*|[^\W\d]\w*)|(?P<op>\.\.\.|\.\.=|<<=|::|->|=>|\.\.|\+=|-=|\*=|/=|%=|&=|\|=|\^=|==|!=|<=|>=|&&|\|\||[-+*/%&|^!<>()\[\]{},:.;=?@#$~])|(?P<bad>[\s\S])"
)


def rust(text: str) -> list[tuple]:
    text = normal(text)
    if text.startswith("#!") and not text.lstrip("#! \n").startswith("["):
        text = "//" + text[2:]
    lines, out, pos, n = Lines(text), [], 0, len(text)
    while pos < n:
        if text.startswith("/*", pos):
            depth, at = 1, pos + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, at)
                if not m:
                    break
                depth, at = depth + (1 if m.group() == "/*" else -1), m.end()
            if depth:
                out.append(("ERROR", lines.at(pos), False))
                break
            pos = at
            continue
        m = _RUST.match(text, pos)
        kind, value = m.lastgroup, m.group()
        if kind == "hashes":
            kind = "rawstring"
        if kind == "bad":
            out.append(("ERROR", lines.at(pos), False))
            break
        if kind != "skip":
            if kind == "name":
                k = value if value in RUST_WORDS else ("NAME", value) if value in RUST_SOFT else "_" if value == "_" else "NAME"
            elif kind == "op":
                k = "ASSIGN" if value in _C_ASSIGN else value
            else:
                k = {"rawstring": "STRING", "string": "STRING", "char": "CHAR", "life": "LIFE", "num": "NUMBER"}[kind]
            out.append((k, lines.at(pos), False))
        pos = m.end()
    out.append((END, lines.at(max(n - 1, 0)), True))
    return out


JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
JS_SOFT = frozenset("async of get set static let from as await yield accessor target meta using".split())
TS_SOFT = JS_SOFT | frozenset(
    "type interface namespace module declare abstract readonly keyof infer is asserts unique public private protected override implements global satisfies any unknown never string number boolean symbol object bigint undefined out require constructor using".split()
)
_JS = re.compile(
    r"(?P<skip>[^\S\n]+|\n|//[^\n  ]*|/\*[\s\S]*?\*/|<!--[^\n]*)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)n?(?![\w$]))"
    r"|(?P<name>#?(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:[\w$‌‍]|\\u\{?[0-9a-fA-F]+\}?)*)"
    r"|(?P<op>\.\.\.|=>|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|\?\.(?!\d)|\?\?|\*\*|\+\+|--|<<|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~!<>()\[\]{},:.;=?@])|(?P<bad>[\s\S])"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_LINE_END = re.compile(r"[^\S\n]*(?://[^\n]*)?\n")
_JS_ASSIGN = frozenset("+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_JS_BINARY = frozenset("** % & | ^ << == != === !== && || ?? <= >=".split())
_JS_VALUE_ENDS = frozenset(["NAME", "NUMBER", "STRING", "TEMPLATE", "TEND", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false", "PRIVATE"])


def _js(text: str, soft: frozenset[str], typed: bool) -> list[tuple]:
    text = normal(text)
    if text.startswith("#!"):
        text = "//" + text[2:]
    lines, out, pos, n, fresh, nest = Lines(text), [], 0, len(text), True, []

    def template(at: int) -> tuple[int, bool]:
        """The end of the literal part from ``at`` on, and whether an expression follows."""
        while at < n:
            ch = text[at]
            if ch == "\\":
                at += 2
            elif ch == "`":
                return at + 1, False
            elif ch == "$" and text.startswith("${", at):
                return at + 2, True
            else:
                at += 1
        return -1, False

    while pos < n:
        ch = text[pos]
        if ch == "`" or (ch == "}" and nest and nest[-1] == "`"):
            end, more = template(pos + 1)
            if end < 0:
                out.append(("ERROR", lines.at(pos), fresh))
                break
            if ch == "`":
                out.append(("TSTART" if more else "TEMPLATE", lines.at(pos), fresh))
                if more:
                    nest.append("`")
            else:
                out.append(("TMID" if more else "TEND", lines.at(pos), fresh))
                if not more:
                    nest.pop()
            pos, fresh = end, False
            continue
        if ch == "/" and not text.startswith(("//", "/*"), pos):
            last = out[-1][0] if out else None
            last = last[0] if type(last) is tuple else last
            if last not in _JS_VALUE_ENDS and (m := _JS_REGEX.match(text, pos)):
                out.append(("REGEX", lines.at(pos), fresh))
                pos, fresh = m.end(), False
                continue
        m = _JS.match(text, pos)
        kind, value = m.lastgroup, m.group()
        if kind == "bad":
            out.append(("ERROR", lines.at(pos), fresh))
            break
        if kind == "skip":
            if "\n" in value:
                fresh = True
                if out and out[-1][0] in ("return", "break", "continue") and not (len(out) > 1 and out[-2][0] in (".", "?.")):
                    out.append((";", lines.at(pos), False))  # nothing after a line break belongs to these
        else:
            if kind == "name":
                k = "PRIVATE" if value[0] == "#" else value if value in JS_WORDS else ("NAME", value) if value in soft else "NAME"
                if value == "async" and _LINE_END.match(text, m.end()):
                    k = "NAME"  # what it would modify stands on its line
            elif kind == "op":
                k = "ASSIGN" if value in _JS_ASSIGN else "BINARY" if value in _JS_BINARY and value not in ("&", "|") else value
                if value in ("++", "--"):
                    k = "NLINC" if fresh else "INC"
                if typed and value == "[" and not fresh:
                    k = ("[", "SAMELINE")  # a type's brackets stand on its line
                if value == "{":
                    nest.append("{")
                elif value == "}" and nest:
                    nest.pop()
            else:
                k = {"string": "STRING", "num": "NUMBER"}[kind]
            out.append((k, lines.at(pos), fresh))
            fresh = False
        pos = m.end()
    out.append((END, lines.at(max(n - 1, 0)), True))
    return out


def javascript(text: str) -> list[tuple]:
    return _js(text, JS_SOFT, False)


def typescript(text: str) -> list[tuple]:
    return _js(text, TS_SOFT, True)
