"""Small sources and tables whose answers are known, with these answers as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.extract.code import extract_nodes
from symgraph.operators import build, lookup, stats
from symgraph.plans.adapters import vertices, with_graph
from symgraph.sources import files as S

Q, O = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return keep


def values(rows: list[tuple], columns: str) -> str:
    """A table of constants."""
    say = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({columns})"


#: A source in each language, by extension.
SOURCES = {
    "rs": r"""use std::fs;
pub struct Point { x: i32 }
pub enum Kind { A }
pub trait Shape {
    fn area(&self) -> f64;
}
impl Point {
    pub fn new(x: i32) -> Self { check(x); Self { x } }
    pub(crate) async fn of(&self) -> [u8; 2] { self.area() }
}
impl Shape for Point {
    fn area(&self) -> f64 { helper(1.0) }
}
mod inner {}
const MAX: i32 = 3;
type Id = u64;
fn helper(x: f64) -> f64 { x }
""",
    "ts": r"""import def, { a, b as c } from './mod';
import * as ns from 'lib';
export class Service extends Base {
  static async of(x: number) { return make(x); }
  catch(e: string): void { this.log(e); other.call(); }
}
export interface Shape { area: number }
enum Kind { A }
type Id = string;
export const twice = (x: number) => add(x, x);
const run = async (y) => {
  twice(y);
};
export async function main() { run(1); }
""",
    "py": r'''import os as o
from a.b import c, d as e
LIMIT = 3
class Base(Root):
    """Doc."""
    def _hook(self): return self.go()
    @staticmethod
    async def make(x: int) -> int: return helper(x)
def __secret(): pass
def helper(x): return c.f(x)
''',
    "go": r"""package main

import (
	"fmt"
	q "a/b"
)

const (
	A = iota
	b
)

var Total = 1

type User struct {
	Name string
}

type Shape interface {
	Area() int
}

type ID string

func (u *User) Greet(x int) string { return format(x) + u.Name }
func format(x int) string { return fmt.Sprint(x) }
""",
    "java": r"""package com.example;
import java.util.List;
public class Calc {
  private int total;
  public Calc(int x) { init(x); }
  static Calc of(int a) { return MathUtils.add(a, this.next(a)); }
  protected void lock() {}
}
interface Greeting {
  String greet(String name);
}
enum Color { RED }
""",
    "c": r"""#include <stdio.h>
typedef int T; int first(void) { return 1; }
typedef struct node { struct node *next; } node_t;
struct Point {
  int x;
};
enum Color { RED };
int add(int a, int b);
static int run(int x) { return add(x, first()); }
""",
    "cpp": r"""#include <iostream>
using std::string;
namespace lib {
class Box : public Base {
public:
  int v; void open() { check(v); }
private:
  int w = 3;
};
struct Point { int x; };
enum class Color { Red };
int Box::size(int y) { return y; }
template <typename T> T top(T a) { return first(a); }
}
""",
    "cs": r"""using System;
namespace MyApp
{
    public class UserService
    {
        private int count;
        public UserService(int x) { Init(x); }
        public string GetUser(int id) { return this.Find(id); }
        void Lock() {}
    }
    public interface IRepository
    {
        void Save(string data);
    }
    public struct Point { public int X; }
    public enum Color { Red }
}
""",
    "dart": r"""import 'src/a.dart';
library shapes;
class Example {
  void show() { this.draw(); print(1); }
  int _hidden(int x) => twice(x);
}
mixin Walker {}
extension Ext on Example {}
enum Color { red }
int twice(int x) { return x; }
""",
    "kt": r"""fun main() {
}
  data class User(val a: Int)
// fun no()
object One
interface Shape
enum class Kind
""",
    "swift": r"""func run() {}
protocol Shape {}
extension Point {}
struct Point {}
class Box {}
enum Kind {}
""",
    "rb": r"""class Box
  def self.build
  def run_it
end
module Tools
# def no
""",
    "php": r"""function run() {}
trait Walks {}
class Box {}
interface Shape {}
$x = 1;
""",
    "sh": r"""function go {
deploy-all() {
# comment()
echo x
""",
    "md": r"""# Top

## Next part
#### Deep one
text
""",
}

#: What they declare, read off by hand: extension, kind, qualified name, first and last line, visibility, references.
DECLARED = """
c import stdio.h 1 1 private
c type_alias T 2 2 public
c function first 2 2 public
c struct node 3 3 public
c type_alias node_t 3 3 public
c struct Point 4 6 public
c enum Color 7 7 public
c function add 8 8 public
c function run 9 9 private add first
cpp import iostream 1 1 private
cpp import std::string 2 2 private
cpp module lib 3 14 public
cpp class Box 4 9 public
cpp field Box::v 6 6 public
cpp method Box::open 6 6 public check
cpp field Box::w 8 8 private
cpp struct Point 10 10 public
cpp field Point::x 10 10 public
cpp enum Color 11 11 public
cpp method Box::size 12 12 public
cpp function top 13 13 public first
cs import System 1 1 private
cs module MyApp 2 17 internal
cs class UserService 4 10 public
cs field UserService.count 6 6 private
cs constructor UserService.UserService 7 7 public Init
cs method UserService.GetUser 8 8 public Find
cs method UserService.Lock 9 9 private
cs interface IRepository 11 14 public
cs method IRepository.Save 13 13 public
cs struct Point 15 15 public
cs field Point.X 15 15 public
cs enum Color 16 16 public
dart import src/a.dart 1 1 private
dart module shapes 2 2 public
dart class Example 3 6 public
dart method Example.show 4 4 public draw print
dart method Example._hidden 5 5 private
dart interface Walker 7 7 public
dart type_alias Ext 8 8 public
dart enum Color 9 9 public
dart function twice 10 10 public
go module main 1 1 private
go import fmt 4 4 private
go import a/b 5 5 private
go constant A 9 9 public
go constant b 10 10 private
go variable Total 13 13 public
go struct User 15 17 public
go interface Shape 19 21 public
go type_alias ID 23 23 public
go method User.Greet 25 25 public format
go function format 26 26 private fmt.Sprint
java module com.example 1 1 internal
java import java.util.List 2 2 private
java class Calc 3 8 public
java field Calc.total 4 4 private
java constructor Calc.Calc 5 5 public init
java method Calc.of 6 6 internal MathUtils.add next
java method Calc.lock 7 7 protected
java interface Greeting 9 11 internal
java method Greeting.greet 10 10 internal
java enum Color 12 12 internal
kt function main 1 1 private
kt class User 3 3 private
kt class One 5 5 private
kt interface Shape 6 6 private
kt enum Kind 7 7 private
md section Top 1 1 private
md section Next 3 3 private
md section Deep 4 4 private
php function run 1 1 private
php interface Walks 2 2 private
php class Box 3 3 private
php interface Shape 4 4 private
py import os 1 1 private *as:o
py import a.b 2 2 private c e
py constant LIMIT 3 3 public
py class Base 4 8 public Root
py method Base._hook 6 6 protected self.go
py method Base.make 8 8 public helper
py function __secret 9 9 private
py function helper 10 10 public c.f
rb class Box 1 1 private
rb function build 2 2 private
rb function run_it 3 3 private
rb module Tools 5 5 private
rs import std::fs 1 1 private
rs struct Point 2 2 public
rs enum Kind 3 3 public
rs interface Shape 4 6 public
rs method Shape.area 5 5 private
rs method Point.new 8 8 public check
rs method Point.of 9 9 internal self.area
rs method Point.area 12 12 private helper
rs module inner 14 14 private
rs constant MAX 15 15 private
rs type_alias Id 16 16 private
rs function helper 17 17 private
sh function go 1 1 private
sh function deploy-all 2 2 private
swift function run 1 1 private
swift interface Shape 2 2 private
swift module Point 3 3 private
swift struct Point 4 4 private
swift class Box 5 5 private
swift enum Kind 6 6 private
ts import ./mod 1 1 private a c def
ts import lib 2 2 private *as:ns
ts class Service 3 6 public
ts method Service.of 4 4 public make
ts method Service.catch 5 5 public log
ts interface Shape 7 7 public
ts enum Kind 8 8 public
ts type_alias Id 9 9 public
ts function twice 10 10 public add
ts function run 11 13 public twice
ts function main 14 14 public run
"""


def _declared() -> list[tuple]:
    rows = [x.split() for x in DECLARED.strip().splitlines()]
    return [(r[0], r[1], r[2], int(r[3]), int(r[4]), r[5], " ".join(r[6:])) for r in rows]


@query(values(_declared(), "ext, kind, qualified_name, line_start, line_end, visibility, refs"))
def extracted_declarations(spark, d):
    """What the extractors of all languages find in :data:`SOURCES`."""
    files = spark.createDataFrame([(f"x.{e}", e, t) for e, t in SOURCES.items()], "path string, ext string, text string")
    return extract_nodes(files).select(F.regexp_extract("file", r"([^.]+)$", 1).alias("ext"), "kind", "qualified_name", "line_start", "line_end", "visibility", F.array_join("refs", " ").alias("refs"))


@query(values([("a/bad.py", "SyntaxError"), ("a/empty.py", "empty file"), ("b/none.rs", "empty file")], "file, error"))
def extraction_failures(spark, d):
    """Files that cannot be read give an error each; an empty ``__init__.py`` and files of no language give nothing."""
    rows = [("a/bad.py", "py", "def ("), ("a/empty.py", "py", ""), ("a/__init__.py", "py", ""), ("b/none.rs", "rs", None), ("b/notes.txt", "txt", "x"), ("b/good.go", "go", "package a\n")]
    got = extract_nodes(spark.createDataFrame(rows, "path string, ext string, text string")).where("error IS NOT NULL")
    return got.select("file", F.regexp_extract("error", r"^(SyntaxError|empty file)", 1).alias("error"))


_NAMES = [(1, "LoginPage", "class", "a.dart"), (2, "onClick", "function", "a.ts"), (3, "save_callback", "method", "a.py"), (4, "Panel", "function", "p.tsx"), (5, "RepoFactory", "class", "r.java"), (6, "handle_job", "function", "b.py"), (7, "plain", "function", "b.py"), (8, "HomeView", "class", "h.dart")]


def _named(spark):
    return spark.createDataFrame([(o, f"id{o}", n, k, f) for o, n, k, f in _NAMES], "ord long, id string, name string, kind string, file string")


@query("SELECT source, target, kind, CAST(confidence AS DECIMAL(2, 1)) AS confidence FROM (" + values([("parent_widget", "id1", "widget_tree", "0.8"), ("event_source", "id2", "event_handler", "0.7"), ("event_source", "id3", "event_handler", "0.7"), ("caller", "id3", "callback", "0.6"), ("event_source", "id6", "event_handler", "0.7"), ("parent_widget", "id8", "widget_tree", "0.8")], "source, target, kind, confidence") + ")")
def uncertain_edges_named(spark, d):
    """The edges that names suggest, of names that do."""
    return stats.uncertain_edges(_named(spark)).withColumn("confidence", F.col("confidence").cast("decimal(2,1)"))


@query(values([("widget", 1), ("event_handler", 2), ("event_handler", 3), ("callback", 3), ("component", 4), ("injected", 5), ("widget", 8), ("event_handler", 6)], "class, ord"))
def name_sample(spark, d):
    """Up to three of each kind of name."""
    return stats.name_sample(_named(spark).unionAll(spark.createDataFrame([(9, "id9", "onLate", "function", "z.py")], "ord long, id string, name string, kind string, file string")))


_IMPORTS = [(1, "a.ts", "import", "lib", ["*as:ns", "x"]), (2, "a.ts", "import", "lib2", ["*as:ns", "x"]), (3, "b.ts", "import", "os", ["*as:o"]), (4, "b.ts", "function", "f", ["*as:no"])]


@query(values([("a.ts", "ns", "lib2", True), ("b.ts", "o", "os", True), ("a.ts", "x", "lib2", False)], "file, local_name, module, is_namespace"))
def import_tables(spark, d):
    """Names and namespaces that imports bind; the last import of a name counts."""
    n = spark.createDataFrame(_IMPORTS, "ord long, file string, kind string, name string, refs array<string>")
    return build.namespace_map(n).withColumn("is_namespace", F.lit(True)).unionAll(build.import_map(n).withColumn("is_namespace", F.lit(False)))


@query(with_graph("SELECT (SELECT count(*) FROM v WHERE kind <> 'import') AS nodes, 0 AS edges"))
def built_without_edges(spark, d):
    g = build.build_graph(vertices(spark, d), with_edges=False)
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes")).join(g.edges.agg(F.count(F.lit(1)).alias("edges")), how="cross")  # one row each


@query(
    with_graph(
        """SELECT 'file' AS what, f AS file, 1 AS line FROM (SELECT max(file) AS f FROM v) UNION ALL SELECT 'id', file, line_start FROM v WHERE ord = (SELECT max(ord) FROM v WHERE id = (SELECT min(id) FROM v))
        UNION ALL SELECT 'name', file, line_start FROM v WHERE ord = (SELECT min(ord) FROM v WHERE name = (SELECT max(name) FROM v)) UNION ALL SELECT 'none', NULL, NULL UNION ALL SELECT 'slashes', f, NULL FROM (SELECT max(file) AS f FROM v WHERE contains(file, '/') AND NOT contains(file, chr(92))) UNION ALL SELECT 'root', f, NULL FROM (SELECT max(file) AS f FROM v)"""
    )
)
def resolved_targets(spark, d):
    """A path, an id, a name and something unknown as targets; other spellings of a path."""
    n = vertices(spark, d)
    r = n.agg(F.max("file").alias("f"), F.min("id").alias("i"), F.max("name").alias("n"), F.max(F.when(F.contains("file", F.lit("/")) & ~F.contains("file", F.lit("\\")), F.col("file"))).alias("s")).first()
    rows = [(what, *(lookup.resolve_target(n, x) or (None, None))) for what, x in (("file", r.f), ("id", r.i), ("name", r.n), ("none", "?none"))]
    rows += [("slashes", lookup.resolve_file(n, r.s.replace("/", "\\")), None), ("root", lookup.resolve_file(n, f"/work/{r.f}", "/work"), None)]
    return spark.createDataFrame(rows, "what string, file string, line int")


_STATUS = "M\tsrc/a.rs\nA\tnew/b.py\nD\tgone.go\nR100\tsrc/old.rs\tsrc/new.rs\nC75\tx.ts\ty.ts\n"
_NUMBERS = "3\t1\tsrc/a.rs\n0\t0\tblank.rs\n-\t-\tpic.png\n2\t0\tsrc/{old => new}/c.rs\n1\t1\ta.ts => b.ts\n"


@query(values([("status", "src/a.rs"), ("status", "new/b.py"), ("status", "src/new.rs"), ("status", "y.ts"), ("deleted too", "src/a.rs"), ("deleted too", "new/b.py"), ("deleted too", "gone.go"), ("deleted too", "src/new.rs"), ("deleted too", "y.ts"), ("counted", "src/a.rs"), ("counted", "src/new/c.rs"), ("counted", "b.ts"), ("all", "src/a.rs"), ("all", "blank.rs"), ("all", "pic.png"), ("all", "src/new/c.rs"), ("all", "b.ts")], "list, file"))
def change_lists(spark, d):
    """The paths that the change lists of a version control system name."""
    lists = {"status": S.parse_name_status(_STATUS), "deleted too": S.parse_name_status(_STATUS, True), "counted": sorted(S.parse_numstat(_NUMBERS, True)), "all": sorted(S.parse_numstat(_NUMBERS))}
    return spark.createDataFrame([(k, f) for k, fs in lists.items() for f in fs], "list string, file string")


QUERIES, ORACLE = Q, O
