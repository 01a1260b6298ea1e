import ast
import random
import sys
import time
from pathlib import Path

import pytest

from symgraph.llm.parsing import invalid_files, invalid_rates, parse_files
from symgraph.llm.syntax import parse
from symgraph.llm.syntax.tables import Parser, build

VALID = {
    "python": [
        "", "# only a comment", "x = 1\n", "def f(a, /, b: int = 2, *c, d, **e) -> int:\n\treturn a\n", "async def g():\n    async with a as b, c: pass\n    return [await x async for x in y if z]\n",
        "match x:\n    case {'a': [1, *_], **r} if y: pass\n    case A(b=1) | None as z: pass\n", "class A[T](B, metaclass=C):\n    x: int = 0\n    @p.q(1)\n    def f(self): ...\n", "f'{x!r:>{w}} {{}}' \"s\"\n", "'''\n<<<<<<< ours\n'''\n",
        "lambda *a, b=1: (yield)\n", "if a:\n  b\nelif c: d\nelse:\n  e", "x = [\n1,\n # c\n2]\n", "try: a\nexcept* (B, C) as d: e\nfinally: f\n", "with (a as b, c as d,): pass\n", "a, *b = c = d\ndel a[0], b.c\n", "print(*a, **b, c=1)\nx[1:2, ::3, ...]\n", "type X[T] = list[T]\nmatch = 1\n",
    ],
    "go": [
        "package a", "package a\nimport (\n\t\"fmt\"\n\tm \"x/y\"\n)\nvar x, y = 1, `a\nb`\nconst (\n A = iota\n B\n)\n", "package a\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range t.x { if v, ok := m[i]; ok { continue } }\n\treturn\n}\n",
        "package a\ntype S struct {\n A, B int `j:\"a\"`\n *T\n}\ntype I interface { F(int) error; ~int | ~string }\nfunc G[T any](x T) T { return x }\n", "package a\nfunc f() {\n switch x := y.(type) {\n case int, *T:\n  a()\n default:\n }\n select { case c <- 1: case v := <-d: _ = v }\n go func() { defer f() }()\nL:\n for ;; { break L }\n}\n",
        "package a\nvar m = map[string][]T{\"a\": {{1, 2}}, \"b\": nil}\nvar p = &T{X: 1}\nvar z = x[:2]\n/* <<<<<<< */\n",
    ],
    "java": [
        "", "package a.b;\nimport static c.D.*;\n@A(x = 1) public class B<T extends C & D> extends E<T> implements F { int x[] = {1, 2,}, y; B() { super(); } static { } }", "record P(int x, String... y) { P { } }\nsealed interface S permits A, B { default int f() { return 1; } }\nenum E { A(1) { }, B; int f() { return 0; } }",
        "class A { void f() { for (var x : y) { } int z = (int) a + (b) -c; Runnable r = () -> { }; List<Map<String, int[]>> m = new ArrayList<>(); String s = x instanceof T t && t.u() ? \"a\" : 'b' + \"\"; s::f; } }".replace("s::f;", "g(s::f);"),
        'class A { String t = """\n  <<<<<<< "x"\n  """; int f(int x) { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }', "class A { void f() throws B { try (C c = d(); e) { } catch (X | Y z) { throw z; } finally { } label: do { x >>>= 2; } while (a >> 1 > b); synchronized (this) { } } }",
    ],
    "c": [
        "", "#include <a.h>\n#define M(x) \\\n  x\nint f(void);\n", "typedef struct { int a : 3; union { float b; } c; } T;\nstatic const T x[] = { [0] = { .a = 1 }, {2} };\n", "unsigned long long *(*g(int n))(char, ...) { T *p = (T *)q; a * b; return sizeof(int) + sizeof x; }",
        "#if A\nint f(int a) {\n#else\nint f(void) {\n#endif\n for (int i = 0; i < 3; i++) if (x) y(); else { goto e; } do x--; while (x);\ne: ; switch (a) { case 1: default: break; } return a ? b : c; }", "enum E { A, B = 1 << 2, };\nextern int x; inline static void h() { char *s = \"a\" PRI \"b\"; foo(int, x); }", "/* <<<<<<< */ int x; // \"\n",
    ],
    "rust": [
        "", "#![allow(x)]\nuse a::{self, b::*, c as _};\npub(crate) fn f<'a, T: A + ?Sized>(x: &'a mut T, (y, _): (i32, [u8; 4])) -> impl Fn(i32) -> T where T: B<C = D> { x }", "struct A<T>(pub T, u8); enum E { A = 1, B { x: i32 }, C(T) } trait T: U { const N: usize = 1; type X<'a>; fn f(&self) {} }",
        "impl<T> A for B<T> { fn f(mut self: Box<Self>) -> Result<Vec<Vec<u8>>, ()> { let Some(x) = y else { return Err(()) }; match x { 0..=9 | 11 => a, A { b, .. } if c => { d } n @ _ => n? } } }",
        "fn m() { let v = vec![1; 2]; for i in 0..n { if let Some(x) = a && b { continue 'l; } } let c = move |x: i32| -> i32 { x + 1 }; println!(\"{}\", r#\"<<< \"x\" \"#); a.b::<C>(d).0.1.await; x as u8 < y; while x < 3 { x <<= 1; } }", "macro_rules! m { ($x:expr) => { $x }; }\n/* /* nested */ */\nstatic S: &[i32] = &[0x1, 'a' as i32];\nunion U { a: u8 }",
        "fn f() -> i64 { let x = S { a, b: 1, ..c }; if x == (S { a }) { 1 } else { -2 } }",
    ],
    "javascript": [
        "", "import a, { b as c } from './d';\nexport default class extends E { #x = 1; static async *f() { } get y() { return this.#x } }\nexport const { z, ...w } = q, [g = 1,, h] = i;", "a = b\nc()\nvar f = async (x, { y } = {}, ...z) => ({ ...x, [y]: 1, m() { }, 'k': /[/]re/g.test(s) })", "for (const x of y) if (x) continue; else break\nlabel: for (;;) { }\ndo x++; while (y) z",
        "let s = `a ${b + `c ${d}`} <<<<<<< e`; x ??= y?.z?.[0] ?? (1, 2) ** 3", "switch (a) { case 1: default: throw new B(c)() }\ntry { } catch { } finally { }\nif (a) { function g() { } }\nreturn_\n/ b / c", "!function(a){a.b=1}(this);var x={a:1,b:[1,!0,null]}", "/* \n=======\n*/ async\nf()\n", "export { default as a, b } from 'c'; export * as d from 'e'\nx => class A { }\n",
    ],
    "typescript": [
        "", "import type { A } from 'a'; import B = require('b');\nexport function f<T extends A = B>(this: X, a?: number, ...b: string[]): asserts a is number;\nexport abstract class C<T> extends D<T> implements E { private readonly x!: number; constructor(public y = 1) { super() } abstract z(): void; [k: string]: any }",
        "type M<T> = { readonly [K in keyof T]?: T[K] extends (infer U)[] ? U : never } & { a: 1 | 'b'; (x: number): string; new (): A; get c(): D }\ninterface I extends J<K> { a?: number\n b(): void, readonly c: [x: number, y?: string, ...z: A[]] }",
        "enum E { A = 1, B }\ndeclare module 'x' { export const y: typeof import('z').w; }\nnamespace N.M { }\nlet v = <const>['a'] as unknown as string[]; x!.y = z satisfies W; f<number>(1); a < b > (c)", "const g = <T,>(x: T): x is T => x\n@dec() class A { @inn p: string; m?(): Promise<Array<Array<number>>> { return null! } }", "export default { a: 1 }\nexport = x;",
    ],
}

INVALID = {
    "python": ["def f(:\n pass", "if x:\ny", "x = (1\n", "x = 'a\n", "a = 1\n  b = 2\n", "<<<<<<< ours\nx = 1\n", "def f():\n    return 1\n=======\nx = 2\n", "package a;\n", "print 'x'\n", "f() = 1\n", "x = 1 +\n", "else: pass", "class A:\n", "'''abc", "x = 5x\n", "if a:\n\tb\n        c\n"],
    "go": ["", "package", "package a\nfunc f() {\n", "package a\nfunc f() { x := }", "import \"a\"\npackage b", "package a\n<<<<<<< HEAD\nvar x int\n", "package a\nfunc f() { if x { } else y() }", "package a\nvar s = \"a\n", "def f(): pass", "package a\nfunc f()\n{\n return\n}"],
    "java": ["class A {", "class A { int f( { } }", "class A { void f() { x = ; } }", "fn main() {}", "class A { void f() { try { } } }", "class A { String s = \"a\n\"; }", "class A {\n<<<<<<< x\nint a;\n=======\n}\n", "package a\nclass B { }", "class A { } }"],
    "c": ["int f() {", "int x = ;", "int f() { return 1 }", "#if A\nint x;\n", "#endif\n", "package a.b;\nimport b;", "int f() {\n<<<<<<< a\nx();\n}", "{ \"a\": 1 }", "int x = \"a;\n", "int f(int a { }", "/* open"],
    "rust": ["fn f() {", "fn f( -> i32 { }", "let x = 1;", "fn f() { let x = ; }", "fn f() { x + }", "struct A { x i32 }", "def f(): pass", "fn f() {\n=======\n}", "fn f() { \"a }", "impl A { fn f() }", "fn f() { match x { 1 = 2 } }", "/* /* */"],
    "javascript": ["function f( {", "let x = ;", "{ \"a\": 1 }", "a b", "if (x", "class A { f( }", "let s = `a ${b`", "x = 'a\n'", "function f(a: number) { }", "<<<<<<< a\nx\n", "x\n=======\ny\n", "name: a\nsteps:\n  - run: b\n", "const a = { b: }", "return return", "}"],
    "typescript": ["function f(a: ) { }", "let x: = 1", "interface A { b: }", "type T = ;", "class A { private }}", "enum { A }", "let a = b as ;", "#include <a.h>\nint x;", "fn f(x: i64) -> i64 { x }", "function f() {\n>>>>>>> b\n}"],
}


@pytest.mark.parametrize("language", parse.LEXERS)
def test_valid_and_invalid(language):
    p = parse.parser(language)
    for text in VALID[language]:
        assert parse.first_error(text, language, p) == 0, text
        assert parse.first_error(text.replace("\n", "\r\n"), language, p) == 0, text
    for text in INVALID[language]:
        assert parse.first_error(text, language, p) > 0, text
    assert parse.first_error(None, language, p) == 1


def test_every_branch_of_c_is_parsed():
    p = parse.parser("c")
    bad = {"#if A\nint x;\n#else\nint y = ;\n#endif\n": 4, "#ifdef A\nint x;\n#elif B\nint y;\n#else\n<<<<<<< a\n#endif\n": 6, "#ifndef H\n#define H\n#if A\n#else\n#if B\nint f( {\n#else\nint y;\n#endif\n#endif\n#endif\n": 6, "#if 0\n?\n#elif A\nint x;\n#else\nint f() {\n#endif\n": 7}
    for text, line in bad.items():
        assert parse.first_error(text, "c", p) == line, text
    same = "int f() {\n#if A\nif (x) {\n#else\n{\n#endif\ny();\n#ifdef Q\nz();\n#endif\n#if A\n}\n#else\n}\n#endif\n}\n"
    for text in (same, "#if A\nint f(int a) {\n#endif\n#if A\n}\n#else\nint y;\n#endif\n", "#if 0\n? (\n#endif\nint x;\n", "#if A\nint x;\n#else\n#if A\n? (\n#endif\n#endif\n"):
        assert parse.first_error(text, "c", p) == 0, text


def test_line_of_error():
    assert parse.first_error("x = 1\n\ny = = 2\n", "python", parse.parser("python")) == 3
    assert parse.first_error("package a\nfunc f() {\n", "go", parse.parser("go")) == 2


def test_python_agrees_with_the_interpreter():
    """Whole and truncated files of the standard library, against the interpreter's own parser."""
    p, rng = parse.parser("python"), random.Random(1)
    files = sorted(Path(ast.__file__).parent.glob("*.py"))
    for f in rng.sample(files, 40):
        text = f.read_text(encoding="utf-8", errors="replace")
        for t in (text, text[: rng.randrange(len(text) + 1)], text.replace(rng.choice("():[]"), "", 1)):
            try:
                ast.parse(t)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert (parse.first_error(t, "python", p) == 0) == ok, f


@pytest.mark.parametrize("language,text", [("c", "int x = %s1%s;" % ("(" * 2000, ")" * 2000)), ("c", "int f() { return %s1; }" % ("(a)" * 300)), ("typescript", "x = %sa%s" % ("f<a>(" * 200, ")" * 200)), ("javascript", "x = %s%s" % ("[" * 2000, "]" * 2000)), ("java", "class A { int x = %s1%s; }" % ("(" * 300, ")" * 300)), ("rust", "fn f() { %s%s }" % ("{" * 500, "}" * 500)), ("python", "x = 1 + 2\n" * 30_000)])
def test_deep_and_long(language, text):
    parse.tables(language)
    began = time.time()
    assert parse.first_error(text, language, parse.parser(language)) == 0
    assert time.time() - began < 20


def test_ambiguous_grammar():
    """All actions of a conflict are followed; a palindrome grammar has no deterministic parser."""
    p = Parser(build("file: 'a' file 'a' | 'b' file 'b' | 'a' | 'b' ;", "file"))
    run = lambda s: p.run([*[(c, 1, False) for c in s], ("$end", 1, True)])
    assert run("abaabbaaaba"[:5]) != -1 and run("abbbba"[:0] + "abbabba") == -1 and run("ab") != -1


def test_files(spark):
    rows = [("a/x.py", "a", "PY", "x = 1", "z"), ("a/y.py", "a", "py", "x = (", None), ("a/y.py", "a", "py", "x = (", None), ("b/z.Rs", "b", None, "fn", "q"), ("b/__init__.py", "b", ".py", "", ""), ("b/n.go", "b", "go", None, ""), ("b/t.md", "b", "md", "(", ""), (None, None, "js", "f(", "")]
    df = spark.createDataFrame(rows, "path string, repo string, ext string, text string, error_line string")
    assert sorted((r.path or "", r.error_line) for r in invalid_files(df).collect()) == [("", 1), ("a/y.py", 1), ("b/n.go", 1), ("b/z.Rs", 1)]
    rates = {(r.repo, r.language): (r.files, r.invalid, r.rate) for r in invalid_rates(df).collect()}
    assert rates["a", "python"] == (2, 1, 0.5) and rates["b", "python"] == (1, 0, 0.0) and ("b", None) not in rates
    assert parse_files(df.limit(0)).collect() == []
    assert sys.getrecursionlimit() <= 10_000
