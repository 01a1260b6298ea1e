import datetime as dt

from pyspark.sql import functions as F

from symgraph.extract.code import extract_nodes
from symgraph.operators.build import assign_ord
from symgraph.schema import CodeGraph, node_id
from symgraph.streaming.changes import apply_patch, debounce, numbered, patch_sink, settled, snapshot_batches, update_message

T0 = dt.datetime(2024, 1, 1)
AT = lambda ms: T0 + dt.timedelta(milliseconds=ms)
EVENTS = [("a", "created", AT(0)), ("a", "modified", AT(100)), ("a", "deleted", AT(240)), ("b", "modified", AT(0)), ("b", "modified", AT(500))]
SCHEMA = "path string, change string, ts timestamp"


def rows(df):
    return sorted((r.path, r.n, r.change) for r in df.collect())


WANT = [("a", 3, "deleted"), ("b", 1, "modified"), ("b", 1, "modified")]


def test_debounce(spark):
    s = debounce(spark.createDataFrame(EVENTS, SCHEMA))
    assert rows(s) == WANT
    changed, gone = settled(s)
    assert {r.file for r in changed.collect()} == {"b"} and {r.file for r in gone.collect()} == {"a"}


def test_stream_equals_batch(spark, tmp_path):
    later = [("z", "modified", AT(60_000))]  # moves the watermark on, so that all sessions close
    for i, part in enumerate([EVENTS[:2], EVENTS[2:], later, later]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        del i
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = debounce(stream, late="1 second").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [r for r in rows(spark.table("sessions")) if r[0] != "z"] == WANT


def test_patch(spark):
    def extract(text):
        def of(files):
            src = files.join(spark.createDataFrame(list(text.items()), "file string, text string"), "file").select(F.col("file").alias("path"), F.lit("py").alias("ext"), "text")
            n = assign_ord(extract_nodes(src).where("error IS NULL")).withColumn("id", node_id(F.col("file"), F.col("qualified_name"), F.col("kind")))
            return n.withColumn("ord", F.col("ord") + F.lit(1000))

        return of

    first = extract({"a.py": "def f():\n    g()\n", "b.py": "def g(): pass\n", "c.py": "def h():\n    f()\n"})(spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "file string")).withColumn("ord", F.col("ord") - 1000)
    changes = debounce(spark.createDataFrame([("b.py", "modified", AT(0)), ("c.py", "deleted", AT(0))], SCHEMA))
    again = extract({"b.py": "def g():\n    k()\ndef k(): pass\n"})
    n, g, scores = apply_patch(first, changes, again)
    assert {r.name for r in n.collect()} == {"f", "g", "k"}
    names = {r.ord: r.name for r in n.collect()}
    assert {(names[r.src], names[r.dst]) for r in g.edges.collect()} == {("f", "g"), ("g", "k")} and scores.count() == 3
    assert update_message(g, changes).first().asDict() == {"nodes": 3, "edges": 2, "files": "b.py,c.py"}
    seen = []
    patch_sink(lambda: first, lambda *x: seen.append(x), again)(changes, 0)
    patch_sink(lambda: first, lambda *x: seen.append(x), again)(changes.limit(0), 1)
    assert len(seen) == 1 and seen[0][0].count() == 3


def test_batches(spark):
    n = spark.range(101).select(F.col("id").alias("ord"), F.lpad(F.col("id").cast("string"), 4, "0").alias("id"))
    g = CodeGraph(n, spark.createDataFrame([(0, 1, 2, "calls")], "eord long, src long, dst long, kind string"))
    a, b = snapshot_batches(g)
    assert {r.batch: r["count"] for r in a.groupBy("batch").count().collect()} == {0: 50, 1: 50, 2: 1} and b.count() == 1
    assert numbered(n.limit(0), ["id"], 5).collect() == []
