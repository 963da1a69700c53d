"""Tables in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of less than this is dealt out before it is worked on.
SMALL = 256 << 20


def dealt(df: DataFrame) -> DataFrame:
    """``df``, read from files, dealt out if it is small and has fewer files than there are cores.

    A small table is often one file of one row group and so one task, whatever the split size;
    dealing its rows out costs less than leaving cores idle. Large tables, and those of as many
    files as there are cores, are read as they lie. Both come from the file listing that planning
    makes anyway.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
        return df.repartition(cores)
    return df


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, dealt out."""
    return dealt(spark.read.parquet(f"{folder}/{name}.parquet"))
