"""Session helpers: tables, the shared checkpoint folder, and size-checked constants."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, so that it need not be installed on the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:  # the folder that all machines share
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{named.rstrip('/')}/symgraph-{sc.applicationId}.zip")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        name = at.toString()
    else:
        fd, name = tempfile.mkstemp(prefix="symgraph-", suffix=".zip")
        with os.fdopen(fd, "wb") as f:
            f.write(packed.getvalue())
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a session on this machine alone may do without and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="symgraph-checkpoint-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the folder in ``spark.checkpoint.dir``.

    The cluster names that folder and all executors share it, so the rows
    survive the loss of an executor. Only a session without the setting (tests)
    gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """For costly work by row on a plain scan: fewer partitions than the cluster has cores are dealt out anew.

    Large inputs have more partitions than that and are read where they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def micros(c: Column) -> Column:
    """A timestamp with or without zone as microseconds since 1970 (null stays null)."""
    return F.unix_micros(c.cast("timestamp"))
