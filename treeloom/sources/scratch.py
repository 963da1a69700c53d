"""Folders that the driver and all executors share, for tables and files that serve one application."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a fresh local folder only where all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or _own_dir()).rstrip("/")


@lru_cache(1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="treeloom-")


_OWN: list[tuple[SparkSession, str]] = []


@atexit.register
def _release_all() -> None:
    for spark, path in _OWN:
        with contextlib.suppress(Exception):  # the session may be gone already
            remove(spark, path)


def own_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/treeloom-{label}-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _file_system(spark, path)
    return system.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    found, system = _file_system(spark, path)
    system.delete(found, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    found, system = _file_system(spark, path)
    if not system.rename(found, _file_system(spark, to)[0]):
        raise OSError(f"{path} could not be renamed to {to}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once in the shared folder and read back: its lineage ends there, and lost executors cost no work before it."""
    path = own_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files that a task holds open at most when it writes folders as rows come.
WRITERS = 256


@contextlib.contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Writes within that deal rows into folders by a column don't sort them for it: a task holds a file open for each folder.

    Rows of a folder stay in the task's order. A task that meets over WRITERS folders sorts what is left by folder, as Spark
    does else.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(WRITERS))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: What opening a file counts as in bytes, for folders of very many files: a task takes some hundreds.
OPEN = 64 << 10


@contextlib.contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """What is run within reads many small files in a task; a small file counts as 4 MB else, so that a task takes a few."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(OPEN))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def statuses(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(path, length, change time)`` of the file at ``path``, or of all files below it, by path, as the store has them now."""
    found, system = _file_system(spark, path)
    out, listed = [], system.listFiles(found, True)
    while listed.hasNext():
        x = listed.next()
        out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return sorted(out)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths of files and folders that a glob pattern names, in order."""
    found, system = _file_system(spark, pattern)
    return sorted(x.getPath().toString() for x in system.globStatus(found) or [])


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that appears whole or not at all; False if there is one already."""
    found, system = _file_system(spark, path)
    made, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = system.create(made, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.exists(found) and system.rename(made, found):
        return True
    system.delete(made, False)
    return False
