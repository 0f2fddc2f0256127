"""The folder that the driver and all executors share: lineage cuts and tables in it, and their removal."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that stored() and cut() have made for the sessions of this driver.
_MADE: dict[str, SparkSession] = {}
#: For each thread, what its open scopes have made.
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return context.getCheckpointDir() if not spark.conf.get("spark.checkpoint.dir", None) else folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, so that lost executors lose nothing.

    They stay until release(), the end of the scope they are made in, or the end of the driver.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _note(df.sparkSession, file.get())
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet to the shared folder and read from there. It stays as long as what cut() keeps."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _note(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it: local, HDFS, object store or any other that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _note(spark: SparkSession, path: str) -> None:
    _MADE[path] = spark
    for made in getattr(_OPEN, "scopes", ()):
        made.append(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, if it is there."""
    _MADE.pop(path, None)
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def release(spark: SparkSession | None = None) -> int:
    """Removes what stored() and cut() have kept, of one session or all; DataFrames that still read it can no longer be used."""
    gone = [(s, p) for p, s in list(_MADE.items()) if spark is None or s is spark]
    for s, path in gone:
        remove(s, path)
    return len(gone)


@contextmanager
def scope():
    """Removes at its end what stored() and cut() have made within, in this thread; other threads' tables are left alone.

    What is to be read later has to be written to a folder of its own before that.
    """
    scopes = _OPEN.scopes = getattr(_OPEN, "scopes", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield
    finally:
        scopes.pop()
        for path in made:
            if path in _MADE:
                remove(_MADE[path], path)


@atexit.register
def _at_end() -> None:
    try:
        release()
    except Exception:  # the session has ended before
        _MADE.clear()


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` of narrow rows, broadcast if it has at most ``most`` of them and left to a shuffle otherwise."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most else df
