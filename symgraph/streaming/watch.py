"""Sources and sinks of change streams: change tables, trees that are looked at again and again, and a writer of bounded pace.

A stream of changes has ``path, change, ts`` with ``change`` one of created,
modified and deleted. Everything runs on triggers of Structured Streaming; what
is known between two triggers lies in the shared folder, so a query that is
started again goes on where it stopped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgraph.sources.files import list_files

CHANGES = "path string, change string, ts timestamp"
LISTING = "path string, mtime long"


def change_stream(spark: SparkSession, path: str, form: str = "parquet", schema: str = CHANGES, files_each: int | None = None) -> DataFrame:
    """The rows of change tables that are dropped below ``path``, as a stream; ``files_each`` bounds a trigger."""
    reader = spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.format(form).load(path)


def tree_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, change`` between two listings (``path, mtime``) of a tree: another mtime is a modification."""
    b = before.select("path", F.col("mtime").alias("was"))
    both = b.join(now.select("path", "mtime"), "path", "full")
    change = F.when(F.col("was").isNull(), "created").when(F.col("mtime").isNull(), "deleted").when(F.col("was") != F.col("mtime"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def persister(stream: DataFrame, write: Callable[[DataFrame], None], checkpoints: str, every: str = "5 seconds", drain: bool = False) -> StreamingQuery:
    """Hand what has come to ``write``, at most once in ``every``; nothing is written while nothing changes. ``drain`` ends with what is there now."""
    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            write(rows)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoints)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)).start()


def append_to(folder: str) -> Callable[[DataFrame], None]:
    """A ``write`` that appends Parquet."""
    return lambda rows: rows.write.mode("append").parquet(folder)


def look_again(spark: SparkSession, root: str, state: str) -> DataFrame:
    """What changed below ``root`` since the last look, whose listing lies in ``state``; the listing is replaced."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{x}")
    at = max((int(f.getPath().getName()) for f in fs.listStatus(path("")) if f.getPath().getName().isdigit() and fs.exists(path(f"{f.getPath().getName()}/_SUCCESS"))), default=0) if fs.exists(path("")) else 0
    before = spark.read.schema(LISTING).parquet(f"{state}/{at}") if at else spark.createDataFrame([], LISTING)
    now = spark.createDataFrame(list_files(root), LISTING)
    seen = spark.createDataFrame(tree_changes(before, now).collect(), "path string, change string")  # of one look
    now.write.mode("overwrite").parquet(f"{state}/{at + 1}")
    if at:
        fs.delete(path(str(at)), True)
    return seen.withColumn("ts", F.lit(dt.datetime.now()).cast("timestamp"))


def poll_watch(spark: SparkSession, root: str, state: str, write: Callable[[DataFrame], None], every: str = "2 seconds") -> StreamingQuery:
    """Look at a tree every two seconds and hand its changes on, if there are any."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def look(_: DataFrame, __: int) -> None:
        seen = look_again(spark, root, f"{state}/listing")
        if not seen.isEmpty():
            write(seen)

    return clock.writeStream.foreachBatch(look).option("checkpointLocation", f"{state}/checkpoints").trigger(processingTime=every).start()
