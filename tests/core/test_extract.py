from pyspark.sql import functions as F

from symgraph.extract.code import EXTRACTORS, extract_nodes, extract_text, register
from symgraph.extract.lines import scan_lines


def names(text, lang, *cols):
    rows, error = extract_text(text, lang, "x")
    assert error is None
    return [tuple(r[c] for c in cols or ("kind", "qualified_name")) for r in rows]


def scan(spark, text, lang):
    got = scan_lines(spark.createDataFrame([("f", lang, text)], "path string, language string, text string")).orderBy("pos").collect()
    return [(r.kind, r.name, r.line_start) for r in got]


def test_lines(spark):
    assert scan(spark, "fun main() {\n}\n  data class User(val a: Int)\n// fun no()\nobject One\ninterface I\nenum class E\n", "kotlin") == [("function", "main", 1), ("class", "User", 3), ("class", "One", 5), ("interface", "I", 6), ("enum", "E", 7)]
    assert scan(spark, "func a() {}\nprotocol P {}\nextension X {}\nstruct S {}", "swift") == [("function", "a", 1), ("interface", "P", 2), ("module", "X", 3), ("struct", "S", 4)]
    assert scan(spark, "class A\n  def self.build\n  def run\nmodule M", "ruby") == [("class", "A", 1), ("function", "build", 2), ("function", "run", 3), ("module", "M", 4)]
    assert scan(spark, "function f() {}\ntrait T {}\n$x = 1;", "php") == [("function", "f", 1), ("interface", "T", 2)]
    assert scan(spark, "function go {\ndeploy-all() {\n# comment()\necho x", "shell") == [("function", "go", 1), ("function", "deploy-all", 2)]
    assert scan(spark, "# Top\n\n## Next part\n#### Deep one\ntext", "markdown") == [("section", "Top", 1), ("section", "Next", 3), ("section", "Deep", 4)]
    assert scan(spark, "", "kotlin") == [] and scan(spark, None, "php") == []


def test_python():
    text = 'import os as o\nfrom a.b import c, d as e\nX = 1\nclass A(B):\n    """Doc."""\n    @staticmethod\n    async def _m(self, y: int) -> str:\n        self.z(); a.b.c()\n        return f()\ndef main(): pass\n'
    assert names(text, "python") == [("import", "os"), ("import", "a.b"), ("constant", "X"), ("class", "A"), ("method", "A._m"), ("function", "main")]
    m = extract_text(text, "python", "x")[0][4]
    assert (m["signature"], m["refs"], m["visibility"], m["is_async"], m["is_static"]) == ("def _m(self, y: int) -> str", ["a.b.c", "f", "self.z"], "protected", True, True)
    assert extract_text(text, "python", "x")[0][0]["refs"] == ["*as:o"] and extract_text(text, "python", "x")[0][1]["refs"] == ["c", "e"]


def test_braces():
    rust = "use a::b::{c, d as e};\npub struct S { x: i32 }\nimpl T for S {\n    pub fn go(&self, x: i32) -> i32 { helper(x); S::new(); self.y.z() }\n}\nfn helper(x: i32) {}\ntrait T { fn a(); }\nenum E { A }\nconst N: i32 = 1;\n"
    assert names(rust, "rust") == [("import", "a::b::{c, d as e}"), ("struct", "S"), ("method", "S.go"), ("function", "helper"), ("interface", "T"), ("method", "T.a"), ("enum", "E"), ("constant", "N")]
    assert extract_text(rust, "rust", "x")[0][2]["refs"] == ["S::new", "helper", "self.y.z"] and extract_text(rust, "rust", "x")[0][0]["refs"] == []
    ts = "import def, { validate, x as y } from './utils';\nimport * as types from '@t';\nexport class C extends D {\n  m(a: number): void { this.n(); validate(a); other.call(); }\n  n() {}\n}\nexport const arrow = (x: number) => { run(x); };\ninterface I { a: string }\ntype U = string;\nfunction f() {}\n"
    assert names(ts, "typescript") == [("import", "./utils"), ("import", "@t"), ("class", "C"), ("method", "C.m"), ("method", "C.n"), ("function", "arrow"), ("interface", "I"), ("type_alias", "U"), ("function", "f")]
    rows = extract_text(ts, "typescript", "x")[0]
    assert rows[0]["refs"] == ["def", "validate", "y"] and rows[1]["refs"] == ["*as:types"] and rows[3]["refs"] == ["n", "validate"] and rows[5]["refs"] == ["run"]
    go = 'package main\nimport (\n\t"fmt"\n\tq "a/b"\n)\ntype S struct { X int }\nfunc (s *S) Run(a int) int { return helper(a) + s.x() }\nfunc helper(a int) int { return fmt.Sum(a) }\n'
    assert names(go, "go") == [("module", "main"), ("import", "fmt"), ("import", "a/b"), ("struct", "S"), ("method", "S.Run"), ("function", "helper")]
    assert extract_text(go, "go", "x")[0][4]["refs"] == ["helper", "s.x"] and extract_text(go, "go", "x")[0][4]["visibility"] == "public"
    java = "package a.b;\nimport java.util.List;\npublic class Calc {\n  private int total;\n  public Calc(int x) { super(x); }\n  static int compute(int a) { return MathUtils.add(a, this.inc(a)); }\n}\ninterface I { int f(); }\nenum E { A }\n"
    assert names(java, "java") == [("module", "a.b"), ("import", "java.util.List"), ("class", "Calc"), ("field", "Calc.total"), ("constructor", "Calc.Calc"), ("method", "Calc.compute"), ("interface", "I"), ("method", "I.f"), ("enum", "E")]
    assert extract_text(java, "java", "x")[0][5]["refs"] == ["MathUtils.add", "inc"]
    c = "#include <stdio.h>\ntypedef struct { int a; } T;\nint add(int a, int b);\nstatic int run(int x) { return add(x, 1); }\nstruct P { int q; };\n"
    assert names(c, "c") == [("import", "stdio.h"), ("type_alias", "T"), ("function", "add"), ("function", "run"), ("struct", "P")]
    assert [k for k, _ in names("namespace N { class A { public: int f(int x) { return g(x); } }; }\nint A::h(int y) { return y; }\n", "cpp")][:2] == ["module", "class"]
    assert ("method", "A.F") in names("using System;\nnamespace N {\n  public class A {\n    public int F(int x) { return this.G(x); }\n  }\n}\n", "csharp")
    assert ("method", "A.run") in names("import 'dart:io';\nclass A {\n  int run(int x) { return this.go(x); }\n}\n", "dart")


def test_names_that_are_keywords_elsewhere():
    rust = "impl A { pub fn new() -> Self { Self::of() }\n fn lock(&self) -> [u8; 4] { self.size() }\n fn size(&self) {} }\nfn of() {}\nfn r#in() {}\n"
    assert names(rust, "rust") [:4] == [("method", "A.new"), ("method", "A.lock"), ("method", "A.size"), ("function", "of")]
    assert extract_text(rust, "rust", "x")[0][1]["refs"] == ["self.size"] and extract_text(rust, "rust", "x")[0][1]["visibility"] == "private"
    assert names("class A {\n  static A of(int x) { return new A(); }\n  void lock() {}\n  void match() { when(); }\n}\n", "java") == [("class", "A"), ("method", "A.of"), ("method", "A.lock"), ("method", "A.match")]
    assert names("class A {\n  static async of(x: number) { return 1; }\n  catch() {}\n}\n", "typescript") == [("class", "A"), ("method", "A.of"), ("method", "A.catch")]


def test_declarations_after_a_semicolon():
    assert names("typedef int T; int f(void) { return 1; }\ntypedef struct foo { union { int a; } u; } foo_t;\ntypedef int (*cb)(int);\nint g(void) { return f(); }\n", "c") == [("type_alias", "T"), ("function", "f"), ("struct", "foo"), ("type_alias", "foo_t"), ("type_alias", "cb"), ("function", "g")]
    cpp = "#include <iostream>\nclass A : public B {\npublic:\n  int v; void m() { n(); }\n  A(int x) : v(x) {}\nprivate:\n  int w = 3;\n  virtual int k() const;\n};\nstruct P { int q; };\nint A::h(int y) { return y; }\ntemplate <typename T> T top(T a) { return a; }\n"
    rows = extract_text(cpp, "cpp", "x")[0]
    assert [(r["kind"], r["qualified_name"], r["visibility"]) for r in rows] == [("import", "iostream", "private"), ("class", "A", "public"), ("field", "A::v", "public"), ("method", "A::m", "public"), ("method", "A::A", "public"), ("field", "A::w", "private"), ("method", "A::k", "private"), ("struct", "P", "public"), ("field", "P::q", "public"), ("method", "A::h", "public"), ("function", "top", "public")]
    assert [(r["line_start"], r["line_end"]) for r in rows[2:4]] == [(4, 4), (4, 4)]


def test_groups_and_expressions():
    go = "package p\n\nconst (\n\tA = iota\n\tb\n)\n\nvar (\n\tX, Y = 1, 2\n\tm = map[string]int{\n\t\t\"a\": 1,\n\t}\n)\n\ntype (\n\tS struct {\n\t\tn int\n\t}\n\tID string\n)\n\nvar one = 1\nfunc F() {}\n"
    assert names(go, "go") == [("module", "p"), ("constant", "A"), ("constant", "b"), ("variable", "X"), ("variable", "m"), ("struct", "S"), ("type_alias", "ID"), ("variable", "one"), ("function", "F")]
    ts = "export const g = (x: number) => h(x, i(x))\nconst k = async (x) => {\n  j(x);\n};\nconst f = function (a) { return l(a); };\nfunction last() {}\n"
    assert [(r["name"], r["refs"]) for r in extract_text(ts, "typescript", "x")[0]] == [("g", ["h", "i"]), ("k", ["j"]), ("f", ["l"]), ("last", [])]


def test_unclosed_bodies_hide_nothing():
    assert names("package p\n<<<<<<< a\nfunc f() int {\n=======\nfunc g() int {\n\treturn 1\n}\n>>>>>>> b\nfunc h() {}\n", "go") == [("module", "p"), ("function", "f"), ("function", "g"), ("function", "h")]


def test_imports_bind_only_what_is_named():
    assert names("#include <stdio.h>\n#include \"a/b.h\"\n", "c", "name", "refs") == [("stdio.h", []), ("a/b.h", [])]
    assert names("import 'src/a.dart' as q;\n", "dart", "name", "refs") == [("src/a.dart", [])]


def test_visibility_by_container():
    seen = lambda text, lang: {r["name"]: r["visibility"] for r in extract_text(text, lang, "x")[0]}
    assert seen("static void helper() {}\nvoid open_() {}\n", "c") == {"helper": "private", "open_": "public"}
    assert seen("interface I { void Save(string d); }\nclass A { int x; void M() {} public int P { get; set; } }\n", "csharp") == {"I": "internal", "Save": "public", "A": "internal", "x": "private", "M": "private", "P": "public"}
    assert seen("public class E {\n  public void a() {}\n  protected void b() {}\n  private void c() {}\n  void d() {}\n}\n", "java") == {"E": "public", "a": "public", "b": "protected", "c": "private", "d": "internal"}


def test_lines_are_found_in_linear_time():
    text = "class A {\n" + "".join(f"  void m{i}() {{ n(); }}\n" for i in range(20_000)) + "}\n"
    rows = extract_text(text, "java", "x")[0]
    assert len(rows) == 20_001 and rows[-1]["line_start"] == 20_001


def test_literals_and_comments_are_ignored():
    assert names('// fn no() {}\n/* struct No {} */\nfn yes() { let s = "fn no() {"; }\nfn more() {}\n', "rust") == [("function", "yes"), ("function", "more")]


def test_files(spark):
    rows = [("a.py", "PY", "def f(): pass"), ("bad.py", "py", "def ("), ("e/__init__.py", "py", ""), ("e/x.py", "py", ""), ("k.kt", "kt", "fun g() {}"), ("n.txt", "txt", "def x"), ("z.rs", "rs", None)]
    got = extract_nodes(spark.createDataFrame(rows, "path string, ext string, text string")).collect()
    assert sorted((r.file, r.name) for r in got if not r.error) == [("a.py", "f"), ("k.kt", "g")]
    assert sorted(r.file for r in got if r.error) == ["bad.py", "e/x.py", "z.rs"]


def test_register():
    old = EXTRACTORS["dart"]
    try:
        register("dart", lambda text: [])
        assert extract_text("class A {}", "dart", "x") == ([], None)
    finally:
        register("dart", old)
    assert F is not None
