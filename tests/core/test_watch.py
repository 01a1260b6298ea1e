import os
import time

from symgraph.streaming.changes import debounce
from symgraph.streaming.watch import CHANGES, append_to, change_stream, look_again, persister, poll_watch, tree_changes

from tests.core.test_stream import EVENTS, rows


def seen(df):
    return sorted((r.path, r.change) for r in df.collect())


def test_listings(spark):
    listing = lambda *r: spark.createDataFrame(list(r), "path string, mtime long")
    assert seen(tree_changes(listing(("a", 1), ("b", 1), ("c", 1)), listing(("a", 1), ("b", 2), ("d", 1)))) == [("b", "modified"), ("c", "deleted"), ("d", "created")]
    assert seen(tree_changes(listing(), listing())) == []


def test_persister_drains_and_goes_on(spark, tmp_path):
    def arrive(part):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def drain():
        persister(change_stream(spark, f"{tmp_path}/in", files_each=1), append_to(f"{tmp_path}/out"), f"{tmp_path}/cp", drain=True).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    arrive(EVENTS[:2])
    assert drain().count() == 2
    arrive(EVENTS[2:])
    assert rows(debounce(drain())) == rows(debounce(spark.createDataFrame(EVENTS, CHANGES)))
    assert drain().count() == len(EVENTS)


def test_one_write_a_trigger(spark, tmp_path):
    written = []
    for i in range(4):
        spark.createDataFrame([EVENTS[i]], CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = persister(change_stream(spark, f"{tmp_path}/in"), lambda r: written.append(r.count()), f"{tmp_path}/cp", every="1 hour")
    try:
        for _ in range(100):
            if written:
                break
            time.sleep(0.2)
        assert written == [4]  # what else comes waits an hour
    finally:
        q.stop()


def test_polling(spark, tmp_path):
    tree, state, got = tmp_path / "tree", f"{tmp_path}/state", []
    tree.mkdir()
    (tree / "a.py").write_text("x = 1\n")
    assert seen(look_again(spark, str(tree), state)) == [("a.py", "created")] and seen(look_again(spark, str(tree), state)) == []
    os.utime(tree / "a.py", (1, 1))
    assert seen(look_again(spark, str(tree), state)) == [("a.py", "modified")]
    q = poll_watch(spark, str(tree), f"{tmp_path}/poll", lambda df: got.extend(seen(df)), every="100 milliseconds")
    try:
        for _ in range(100):
            if ("a.py", "created") in got and not (tree / "b.py").exists():
                (tree / "b.py").write_text("y = 1\n")
            if ("b.py", "created") in got:
                break
            time.sleep(0.2)
        assert got == [("a.py", "created"), ("b.py", "created")]
    finally:
        q.stop()
