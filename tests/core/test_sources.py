import os
import subprocess

import pytest
from pyspark.sql import functions as F

from symgraph.operators.audit import audit_paths, named_paths
from symgraph.schema import CodeGraph, node_id
from symgraph.sources import files as S


@pytest.fixture
def tree(tmp_path):
    for name, text in {"src/main.rs": "fn main() {}", "src/lib.PY": "x = 1\r\n", "skip/a.rs": "", "b.txt": "no", ".hidden/c.rs": "", "docs/d.md": "# é"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    (tmp_path / ".gitignore").write_text("# x\nskip/\n*.log\n")
    return tmp_path


def test_scan(spark, tree):
    got = {r.path: (r.ext, r.text) for r in S.scan_files(spark, str(tree)).collect()}
    assert got == {"src/main.rs": ("rs", "fn main() {}"), "src/lib.PY": ("py", "x = 1\r\n"), "docs/d.md": ("md", "# é")}
    assert {p for p, _ in S.list_files(str(tree), exclude=["docs"])} == {"src/main.rs", "src/lib.PY"}
    os.symlink(tree / "src", tree / "link")
    assert not any(p.startswith("link") for p, _ in S.list_files(str(tree))) and any(p.startswith("link") for p, _ in S.list_files(str(tree), follow_symlinks=True))
    assert S.project_root(str(tree / "src")) == str(tree / "src") or S.project_root(str(tree / "src"))
    (tree / "empty").mkdir()
    assert S.scan_files(spark, str(tree / "empty")).collect() == []


def test_cache(spark, tmp_path):
    cols = "ord long, id string, name string, file string"
    st = S.Store(spark, f"file://{tmp_path}/store")
    assert st.nodes().count() == 0 and st.get_mtime("a") is None
    st.put(spark.createDataFrame([("a", 1000), ("b", 5)], "file string, mtime long"), spark.createDataFrame([(1, "1", "foo", "a"), (2, "2", "bar", "a"), (3, "3", "x", "b")], cols))
    st.put(spark.createDataFrame([("a", 2000)], "file string, mtime long"), spark.createDataFrame([(1, "1", "foo", "a")], cols))
    assert [r.name for r in st.file_nodes("a").collect()] == ["foo"] and st.get_mtime("a") == 2000 and st.files().count() == 2
    again = S.Store(spark, f"file://{tmp_path}/store")
    again.remove(spark.createDataFrame([("b",)], "file string"))
    assert [r.file for r in again.files().collect()] == ["a"]
    (tmp_path / "store/version").rename(tmp_path / "store/old")
    assert S.Store(spark, f"file://{tmp_path}/store").nodes().count() == 0


def test_split_and_deleted(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file string, mtime long")
    cached = spark.createDataFrame([("a", 1), ("b", 1), ("z", 1)], "file string, mtime long")
    hit, miss = S.split_cached(files, cached)
    assert [r.file for r in hit.collect()] == ["a"] and {r.file for r in miss.collect()} == {"b", "c"} and [r.file for r in S.deleted_files(cached, files).collect()] == ["z"]


def test_snapshots(spark, tmp_path):
    n = spark.createDataFrame([(1, "1", "f", "a.rs")], "ord long, id string, name string, file string")
    g = CodeGraph(n, spark.createDataFrame([(0, 1, 1, "calls")], "eord long, src long, dst long, kind string"))
    for form in ("parquet", "json"):
        S.save_snapshot(g, f"{tmp_path}/{form}", form)
        assert S.load_snapshot(spark, f"{tmp_path}/{form}", form).edges.count() == 1
    S.export_json(g, f"{tmp_path}/export")
    assert spark.read.json(f"{tmp_path}/export/stats").first()["nodes"] == 1
    ladder = [(f"{tmp_path}/none", "parquet"), (f"{tmp_path}/json", "json")]
    got, rung = S.load_or_build(spark, ladder, lambda: None)
    assert got.nodes.count() == 1 and rung.endswith("/json")
    new = spark.createDataFrame([("a.rs", 100)], "path string, mtime long")
    assert S.load_or_build(spark, ladder, lambda: None, files=new, written=50, kept_fresh=True)[1].endswith("/json")
    assert S.load_or_build(spark, [(f"{tmp_path}/made", "parquet")], lambda: g) == (g, "built") and S.load_snapshot(spark, f"{tmp_path}/made").nodes.count() == 1
    assert S.load_or_build(spark, [(f"{tmp_path}/made", "parquet")], lambda: g, files=new, written=50) == (g, "built")  # stale
    (tmp_path / "bad" / "nodes").mkdir(parents=True)
    (tmp_path / "bad" / "nodes" / "x.parquet").write_text("no parquet")
    with pytest.warns(UserWarning, match="cannot be read"):
        assert S.load_or_build(spark, [(f"{tmp_path}/bad", "parquet"), (f"{tmp_path}/json", "json")], lambda: None)[1].endswith("/json")
    files = spark.createDataFrame([("a.rs", 100), ("b.txt", 10**12)], "path string, mtime long")
    assert S.is_stale(files, 50) and not S.is_stale(files, 100)
    paths = named_paths(g, audit_paths(g, n.select("ord"), 3))
    S.write_audit_csv(paths, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["severity", "entry_point", "entry_file", "path_length", "trace"]
    S.write_json(f"{tmp_path}/x.json", {"a": 1})


def test_change_lists():
    assert S.parse_name_status("R100\tsrc/old.rs\tsrc/new.rs\nM\ta.rs\nD\tgone.rs\n") == ["src/new.rs", "a.rs"] and S.parse_name_status("D\tgone.rs", True) == ["gone.rs"]
    assert S.parse_numstat("1\t0\tsrc/{old.rs => new.rs}\n0\t0\tblank.rs\n2\t1\ta => b\n", True) == {"src/new.rs", "b"}


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    run("init", "-q")
    for name in ("a.rs", "space.rs", "old.rs", "gone.rs"):
        put(name, f"fn {name[0]}() {{\n    1\n}}\n// {name}\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    put("a.rs", "fn a() { 2 }\n")
    put("space.rs", "fn s() {\n        1\n}\n// space.rs\n")
    run("mv", "old.rs", "new.rs")
    put("new.rs", "fn o() {\n    1\n}\n// old.rs\nfn p() {}\n")
    (tmp_path / "gone.rs").unlink()
    put("extra.rs", "x")
    put("lib/models.g.dart", "x")
    run("add", "new.rs")
    got = {r.file for r in S.changed_files(spark, str(tmp_path)).collect()}
    assert got == {"a.rs", "new.rs", "extra.rs"}
    assert "gone.rs" in {r.file for r in S.changed_files(spark, str(tmp_path), tool=True).collect()}
    run("add", "-A")
    run("commit", "-qm", "two")
    assert "extra.rs" in {r.file for r in S.changed_files(spark, str(tmp_path), "HEAD~1", "HEAD").collect()}
    with pytest.raises(ValueError):
        S.changed_files(spark, str(tmp_path / "lib"), tool=True)


def test_ids(spark):
    df = spark.createDataFrame([("a", "q", "function"), ("b", "q", "function")], "f string, q string, k string")
    ids = [r[0] for r in df.select(node_id(F.col("f"), F.col("q"), F.col("k"))).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 16 for i in ids)


def test_store_writes_only_the_buckets_it_must(spark, tmp_path):
    schema = "file string, mtime long"
    names = [f"f{i}.rs" for i in range(300)]
    nodes = lambda fs, name: spark.createDataFrame([(f, name) for f in fs], "file string, name string")
    store = S.Store(spark, f"{tmp_path}/store")
    store.put(spark.createDataFrame([(f, 1) for f in names], schema), nodes(names, "a"))
    before = store._versions()
    store.put(spark.createDataFrame([("f7.rs", 2), ("none.rs", 3)], schema), nodes(["f7.rs"], "b"))
    changed = [b for b, v in store._versions().items() if before.get(b) != v]
    assert 1 <= len(changed) <= 2 and len(before) > 50
    again = S.Store(spark, f"{tmp_path}/store")
    assert sorted((r.file, r.name) for r in again.nodes().collect()) == sorted((f, "b" if f == "f7.rs" else "a") for f in names)
    assert again.get_mtime("f7.rs") == 2 and again.files().where("file = 'none.rs'").first()["n_nodes"] == 0 and again.files().count() == 301
    again.remove(spark.createDataFrame([(f,) for f in names[:299]], "file string"))
    assert {r.file for r in store.files().collect()} == {"f299.rs", "none.rs"} and store.nodes().count() == 1
    store.remove(spark.createDataFrame([("f299.rs",), ("none.rs",)], "file string"))
    assert store.nodes().count() == 0 and store.files().isEmpty()
