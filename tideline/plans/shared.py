"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_all: dict[str, SparkSession] = {}
_cleaning = 0


class _Own(threading.local):
    """Folders made by this thread: queries that run side by side never delete each other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_own = _Own()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder in local mode and an error on a cluster."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file:///tmp/checkpoints/tideline"
    return conf.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared one; removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with _lock:
        if not _all:
            atexit.register(release)
        _all[path] = spark
    _own.paths.append(path)
    return path


@contextlib.contextmanager
def _no_shuffle_files_left(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write that ends in here: its result is a table."""
    global _cleaning
    with _lock:
        _cleaning += 1
        if _cleaning == 1:
            spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _cleaning -= 1
            if _cleaning == 0:
                spark.conf.unset(CLEANUP)


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    with _no_shuffle_files_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point of time for settle(), in this thread."""
    return len(_own.paths)


def settle(since: int, df: DataFrame, what: str = "result") -> DataFrame:
    """df, written and read back; what this thread wrote since the mark goes."""
    out = cut(df, what)
    own = _own.paths.pop()
    discard(since)
    _own.paths.append(own)
    return out


def discard(since: int) -> None:
    """Delete the folders this thread made since the mark; only for tables that nothing reads any more."""
    while len(_own.paths) > since:
        _delete(_own.paths.pop())


def _delete(path: str) -> None:
    with _lock:
        spark = _all.pop(path, None)
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete all folders made here; results that still read them become invalid."""
    for path in list(_all):
        _delete(path)
    _own.paths.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int, most: int = 1_000_000) -> int:
    """Partitions of a shuffle of so many rows: `most` rows a task, or the session's number if that is more."""
    return max(partitions(spark), -(-rows // most))
