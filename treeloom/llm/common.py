"""Shared helpers of the training-data operators: table access, staged tables, skew-aware sizes."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import exists, own_folder, remove, shared_dir
from ..sources.tables import load

__all__ = ["WHITE", "Staged", "buckets", "exists", "free_shuffles", "lower_ascii", "own_folder", "partitions", "shared_dir", "stage", "staging", "table", "text_or_empty"]

#: The white space that separates words: space, tab, LF, VT, FF, CR.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


class Staged:
    """A DataFrame written once as Parquet in the shared folder and read back.

    The table cuts the lineage, survives lost executors and lets ``release`` free
    the disk as soon as later steps no longer need it.
    """

    def __init__(self, df: DataFrame, label: str, **options: str) -> None:
        self.spark = df.sparkSession
        self.path = own_folder(self.spark, label)
        df.write.options(compression="zstd", **options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def release(self) -> None:
        remove(self.spark, self.path)


_COLLECTORS: list[list[Staged]] = []


def stage(df: DataFrame, label: str, **options: str) -> Staged:
    made = Staged(df, label, **options)
    for held in _COLLECTORS:
        held.append(made)
    return made


@contextmanager
def staging() -> Iterator[list[Staged]]:
    """Gathers the tables that are staged within, for those of them to be released that nothing needs any more."""
    held: list[Staged] = []
    _COLLECTORS.append(held)
    try:
        yield held
    finally:
        _COLLECTORS[:] = [x for x in _COLLECTORS if x is not held]


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of input behind a routing bucket and behind a partition, and the most partitions that a plan without known sizes gets.
BUCKET_BYTES, PART_BYTES, MOST_PARTS = 2 << 20, 8 << 20, 100_000


def input_bytes(df: DataFrame) -> int:
    """The bytes of the files that ``df`` reads, as the planner has them; nought where it reads anything else, whose size is not known."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if any(leaves.apply(i).nodeName() != "LogicalRelation" for i in range(leaves.size())):
        return 0
    return int(str(plan.stats().sizeInBytes()))


def buckets(df: DataFrame) -> int:
    """How many routing buckets a payload made from ``df`` is dealt into: a few for each shuffle partition, or more where its bytes ask for more."""
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-input_bytes(df) // BUCKET_BYTES)))


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of ``df`` gets: as the session has it, or more where its bytes ask for more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-input_bytes(df) // PART_BYTES)))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(col):
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
